"""Lines in blocks of any outline, by priority of the blocks' kinds, and blocks within blocks. Lines meet blocks in cells
of a grid; blocks meet those of their page by their boxes first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import row_type

#: Kinds of blocks in the order lines are given to them, the confidence lines need, and the margin in pixels
#: by which a block may stick out of the one it lies in.
KINDS, LEAST_CONFIDENCE, MARGIN = ("text_block", "block_ad", "block_table"), 0.1, 50
CELL = 256


def _edges(points: Column) -> Column:
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p["x"].cast("double").alias("x1"), p["y"].cast("double").alias("y1"), F.get(points, (i + 1) % n)["x"].cast("double").alias("x2"), F.get(points, (i + 1) % n)["y"].cast("double").alias("y2")))


def holds(points: Column, x: Column, y: Column) -> Column:
    """Whether a polygon (array<struct<x, y>>) holds a point: the edges right of it, their upper ends counted, are odd; a
    point on an upright or level edge is in as well."""
    edges = _edges(points)

    def right_of(e: Column) -> Column:
        beside = (F.least(e["y1"], e["y2"]) < y) & (y <= F.greatest(e["y1"], e["y2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        return beside & ((e["x1"] == e["x2"]) | (x <= F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]) + e["x1"]))

    def on(e: Column) -> Column:
        level = (e["y1"] == e["y2"]) & (e["y1"] == y) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        return level | ((e["x1"] == e["x2"]) & (e["x1"] == x) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    return (F.size(F.filter(edges, right_of)) % 2 == 1) | F.exists(edges, on)


def distance(points: Column, x: Column, y: Column) -> Column:
    """How far a point is from a polygon's outline."""

    def to(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - e["x1"] - t * dx, y - e["y1"] - t * dy)

    return F.array_min(F.transform(_edges(points), to))


def _cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: int) -> Column:
    """array<struct<cx, cy>> of the cells that a box lies in."""
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(span(x1, x2), lambda cx: F.transform(span(y1, y2), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def _in_cells(blocks: DataFrame, margin: float, cell: int) -> DataFrame:
    """blocks, a row for each cell that their box, and a margin around it, lies in."""
    side = lambda f, axis, m: f(F.transform("points", lambda p: p[axis])) + m
    box = (side(F.array_min, "x", -margin), side(F.array_min, "y", -margin), side(F.array_max, "x", margin), side(F.array_max, "y", margin))
    return blocks.withColumn("cell_", F.explode(_cells(*box, cell))).withColumns({"cx": F.col("cell_.cx"), "cy": F.col("cell_.cy")}).drop("cell_")


def assign_by_kind(lines: DataFrame, blocks: DataFrame, page: str, kinds: tuple[str, ...] = KINDS, least: float = LEAST_CONFIDENCE, cell: int = CELL) -> DataFrame:
    """page, id, kind, block of the lines (page, id, conf, box) with a confidence of `least`: the first block (page, kind,
    block, pos, points), by the order of kinds and pos, that holds the line's centre, in whole pixels. Blocks of the
    first kind are polygons; of the others their box counts. Kind and block are null where there is none."""
    centre = [F.floor((F.col(a) + F.col(b)) / 2) for a, b in (("x1", "x2"), ("y1", "y2"))]
    at = lines.where(F.col("conf") >= least).select(page, "id", *(c.alias(n) for c, n in zip(centre, ("px", "py"), strict=True)))
    at = at.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("kind"))
    inside = F.when(F.col("kind") == kinds[0], holds(F.col("points"), F.col("px").cast("double"), F.col("py").cast("double"))).otherwise(True)
    beside = lambda axis, p: F.col(p).between(F.array_min(F.transform("points", lambda q: q[axis])), F.array_max(F.transform("points", lambda q: q[axis])))
    met = at.join(_in_cells(blocks.where(rank > 0), 0, cell), [page, "cx", "cy"]).where(beside("x", "px") & beside("y", "py") & inside)
    first = met.groupBy(page, "id").agg(F.min(F.struct(rank.alias("rank"), "pos", "kind", "block")).alias("b"))
    return at.select(page, "id").join(first, [page, "id"], "left").select(page, "id", "b.kind", "b.block")


def blocks_within(blocks: DataFrame, page: str, margin: float = MARGIN) -> DataFrame:
    """page, inner, outer of the blocks (page, block, points) all whose corners another block of the page holds, give or
    take the margin.

    Blocks meet by their page alone, each once on either side: a row for each cell of a grid that a block covers was many
    times the blocks on disk. Blocks that lie together by page already are not shuffled again.
    """
    side = lambda f, axis: f(F.transform("points", lambda p: p[axis])).cast("double")
    edges = [(axis, f"{axis}{n}", f) for axis in ("x", "y") for n, f in ((1, F.array_min), (2, F.array_max))]
    inner = blocks.select(page, F.col("block").alias("inner"), F.col("points").alias("corners"), *(side(f, axis).alias(f"i_{name}") for axis, name, f in edges))
    outer = blocks.select(page, F.col("block").alias("outer"), "points", *(side(f, axis).alias(f"o_{name}") for axis, name, f in edges))
    near = lambda p: holds(F.col("points"), p["x"].cast("double"), p["y"].cast("double")) | (distance(F.col("points"), p["x"].cast("double"), p["y"].cast("double")) <= margin)
    # most pairs stick out by their boxes already; outlines are for the rest
    within = (F.col("inner") != F.col("outer")) & (F.col("i_x1") >= F.col("o_x1") - margin) & (F.col("i_x2") <= F.col("o_x2") + margin) & (F.col("i_y1") >= F.col("o_y1") - margin) & (F.col("i_y2") <= F.col("o_y2") + margin)
    return inner.join(outer, page).where(within & F.forall("corners", near)).select(page, "inner", "outer")


@F.pandas_udf(T.ArrayType(row_type(owner=T.LongType(), into=T.LongType())))
def _owners(blocks: pd.Series, pairs: pd.Series) -> pd.Series:
    out = []
    for names, within in zip(blocks, pairs, strict=True):
        around: dict[int, list[int]] = {}
        for p in within:
            around.setdefault(int(p["inner"]), []).append(int(p["outer"]))
        taken: dict[int, int] = {}
        for name in sorted(int(b) for b in names):
            left = [o for o in sorted(around.get(name, ())) if o not in taken]
            if left:
                taken[name] = left[0]
        owner = []
        for b in names:
            at = int(b)
            while at in taken:
                at = taken[at]
            owner.append((at, taken.get(int(b))))
        out.append(owner)
    return pd.Series(out)


def absorbed(blocks: DataFrame, page: str, margin: float = MARGIN) -> DataFrame:
    """page, block, owner, into of blocks (page, block: long, points): in order of their numbers a block goes into the first
    other one that it lies in and that has not gone itself (null: none); owner is where it ends up, or itself."""
    pairs = blocks_within(blocks, page, margin).groupBy(page).agg(F.collect_list(F.struct("inner", "outer")).alias("pairs"))
    every = blocks.groupBy(page).agg(F.collect_list("block").alias("blocks")).join(pairs, page, "left")
    none = F.expr("cast(array() as array<struct<inner: bigint, outer: bigint>>)")
    owned = every.withColumn("owners", _owners(F.col("blocks"), F.coalesce("pairs", none)))
    return owned.select(page, F.inline(F.arrays_zip("blocks", "owners"))).select(page, F.col("blocks").alias("block"), "owners.owner", "owners.into")


def nested_page(lines: DataFrame, blocks: DataFrame, page: str, margin: float = MARGIN, least: float = LEAST_CONFIDENCE, size: float = 5.0) -> DataFrame:
    """page, kind, block, inner, lines: what each block of a page holds, of lines and blocks with sides of `size` at least;
    a row with null kind and block has the loose lines. A text block in another one gives what it holds to that one, or
    itself (inner) where it holds nothing; a block that holds blocks alone counts as empty."""
    big = lambda a, b: F.col(b) - F.col(a) >= size
    placed = assign_by_kind(lines.where(big("x1", "x2") & big("y1", "y2")), blocks, page, least=least)
    owner = absorbed(blocks.where(F.col("kind") == KINDS[0]), page, margin)
    own = placed.join(owner.drop("into").withColumn("kind", F.lit(KINDS[0])), [page, "kind", "block"], "left").withColumn("block", F.coalesce("owner", "block"))
    held = own.groupBy(page, "kind", "block").agg(F.sort_array(F.collect_list("id")).alias("lines"))
    full_ones = placed.where(F.col("kind") == KINDS[0]).select(page, "block").unionByName(owner.where("into is not null").select(page, F.col("into").alias("block"))).distinct()
    empty = owner.where("into is not null").join(full_ones, [page, "block"], "left_anti")
    inner = empty.groupBy(page, F.col("owner").alias("block")).agg(F.sort_array(F.collect_list("block")).alias("inner")).withColumn("kind", F.lit(KINDS[0]))
    there = blocks.select(page, "kind", "block").join(owner.where("owner <> block").select(page, "block").withColumn("kind", F.lit(KINDS[0])), [page, "kind", "block"], "left_anti")
    none = F.expr("cast(array() as array<bigint>)")
    full = there.join(held.where("block is not null"), [page, "kind", "block"], "left").join(inner, [page, "kind", "block"], "left")
    full = full.select(page, "kind", "block", F.when(F.col("lines").isNull(), none).otherwise(F.coalesce("inner", none)).alias("inner"), F.coalesce("lines", none).alias("lines"))
    return full.unionByName(held.where("block is null").select(page, "kind", "block", none.alias("inner"), "lines"))

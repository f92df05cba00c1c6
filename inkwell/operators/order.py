"""Exact reading order of a page's lines: mesh cuts, the comparator of columns, inline notes and containers. The islands
of layout.reading_order and layout.column_islands are the fast form, in built-ins alone."""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mesh
from . import layout as la

SIDES = ("x1", "y1", "x2", "y2")
#: The share of the median width (or height) within which lines are of one column (or row), the share by
#: which inline notes grow across, and pixels within which groups are of one column.
SAME_COLUMN, GROW, SAME_GROUP_COLUMN = 0.3, 0.1, 50.0


def _boxes(lines) -> np.ndarray:
    return lines if isinstance(lines, np.ndarray) and lines.ndim == 2 else np.array([[float(r[c]) for c in SIDES] for r in lines]).reshape(-1, 4)


def in_bands(first: np.ndarray, second: np.ndarray, margin: float) -> list[int]:
    """Places in order of `first`, but of `second` where first differs by no more than the margin. That is no order: of
    three, each may be as far on as the next. The result is that of a stable merge sort of the places as they come."""

    def compare(i: int, j: int) -> float:
        apart = first[i] - first[j]
        return apart if abs(apart) > margin else second[i] - second[j]

    return sorted(range(len(first)), key=cmp_to_key(compare))


def _line_orders(b: np.ndarray) -> np.ndarray:
    """in_bands of the lines of pages (boxes by page, line and side): columns, or rows. Where lines part into bands of
    no more than the margin, with more than it between them, the comparator is an order and all pages are sorted at
    once."""
    width, height = b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
    x, y = b[..., 0] + width / 2, b[..., 1] + height / 2
    upright = (b.shape[1] < 2 * (width < height).sum(axis=1))[:, None]
    first, second = np.where(upright, -x, y), np.where(upright, y, x)
    margin = np.where(upright, np.median(width, axis=1, keepdims=True), np.median(height, axis=1, keepdims=True)) * SAME_COLUMN
    by_first = np.argsort(first, axis=1, kind="stable")
    placed = np.take_along_axis(first, by_first, axis=1)
    begins = np.concatenate((np.ones((len(b), 1), bool), np.diff(placed, axis=1) > margin), axis=1)
    start = np.take_along_axis(placed, np.maximum.accumulate(np.where(begins, np.arange(b.shape[1]), 0), axis=1), axis=1)
    band = np.empty(first.shape, np.int64)
    np.put_along_axis(band, by_first, np.cumsum(begins, axis=1), axis=1)
    out = np.lexsort((second, band), axis=1)
    for i in np.flatnonzero(~(placed - start <= margin).all(axis=1)):
        out[i] = in_bands(first[i], second[i], float(margin[i, 0]))
    return out


def _line_order(lines) -> list[int]:
    return _line_orders(_boxes(lines)[None])[0].tolist() if len(lines) else []


def _group_order(groups) -> list[int]:
    b = _boxes(groups)
    # nearer than the margin, not as near
    return in_bands(-(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, float(np.nextafter(SAME_GROUP_COLUMN, 0)))


def _mesh_order(lines) -> list[int]:
    return np.argsort(mesh.mesh_ranks(_boxes(lines).astype(np.int64))).tolist()


def _seeds(b: np.ndarray) -> np.ndarray:
    """For each inline note of pages (boxes by page, note and side), the note its group began with: one that no earlier
    group took. A group takes all notes left that meet its first, both grown across."""
    size = b[..., 2:] - b[..., :2]
    across = size[..., 0] < size[..., 1]
    more = np.where(np.stack((across, ~across), axis=-1), size, 0.0) * GROW / 2
    low, high = b[..., :2] - more, b[..., 2:] + more
    seed = np.full(b.shape[:2], -1)
    for i in range(b.shape[1]):
        meets = (np.minimum(high[:, i : i + 1], high) > np.maximum(low[:, i : i + 1], low)).all(axis=2)
        begins = seed[:, i] < 0
        seed[begins[:, None] & (seed < 0) & meets] = i
        seed[begins, i] = i
    return seed


#: Boxes that are worked out at once, at least those of one page.
BOXES_AT_ONCE = 100_000


def _by_size(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, kernel) -> pa.Array:
    """kernel over the boxes of pages (lists of their sides) that have as many, as arrays by page, box and side."""
    sides = [a.flatten() for a in (x1, y1, x2, y2)]
    if any(a.null_count for a in sides):
        raise ValueError("boxes without a side have no place")
    boxes = np.stack([a.to_numpy() for a in sides], axis=1)
    sizes = pc.fill_null(pc.list_value_length(x1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros(len(boxes), np.int32)
    for n in np.unique(sizes[sizes > 0]):
        begins = (ends - n)[sizes == n]
        for some in np.array_split(begins, -(-len(begins) * n // BOXES_AT_ONCE)):
            if len(some):
                at = some[:, None] + np.arange(n)
                out[at] = kernel(boxes[at])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))


def _all_pages(kernel):
    """The column of kernel's places for a column of pages' lines; kernel takes all pages of a size together."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
        return _by_size(x1, y1, x2, y2, kernel)

    return lambda lines: places(*(F.col(lines)[c] for c in SIDES))


def _per_page(kernel):
    """kernel over the boxes of each page; pages of a batch that have the same boxes are worked out once."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(pages: pd.Series) -> pd.Series:
        known: dict[bytes, list[int]] = {}
        out = []
        for page in pages:
            boxes = _boxes(page)
            key = boxes.tobytes()
            if key not in known:
                known[key] = kernel(boxes)
            out.append(known[key])
        return pd.Series(out)

    return places


def _gathered(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """keys and lines: the rows of a page (or of a container of it), in order of pos. Pages are small and their kernels
    are not, so they are dealt out for the work that they are, not for their bytes."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    row = F.struct(F.col(pos).alias("pos"), F.col("id").alias("id"), *(F.col(c).cast("double").alias(c) for c in SIDES))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("lines"))


def _ranked(rows: DataFrame, keys: list[str], pos: str, kernel) -> DataFrame:
    found = _gathered(rows, keys, pos).select(*keys, "lines", F.posexplode(kernel("lines")).alias("nth", "at"))
    return found.select(*keys, F.get("lines", F.col("at"))["id"].alias("id"), (F.col("nth") + 1).alias("rank"))


def line_order(lines: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, id, rank of lines (keys, id, pos, box): columns from the right, each from the top, where most lines are
    taller than wide; else rows from the top, each from the left. Lines are of one column or row if their centres
    differ by at most a share of the median; the sort is that of a comparator, of lines in the order of pos."""
    return _ranked(lines, keys, pos, _all_pages(_line_orders))


def group_order(groups: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, id, rank of groups (keys, id, pos, box): from the right, but from the top where centres are nearer than
    SAME_GROUP_COLUMN, by a comparator as in line_order."""
    return _ranked(groups, keys, pos, _per_page(_group_order))


def mesh_order(lines: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, id, rank of lines (keys, id, pos, box in pixels) by recursive cuts of the page's mesh (mesh.mesh_ranks)."""
    return _ranked(lines, keys, pos, _per_page(_mesh_order))


def deepest_gaps(counts: DataFrame, keys: list[str], pos: str, n: str) -> DataFrame:
    """keys, begin, end, depth: the run of a histogram (keys, pos without gaps, n) below the median of its positive
    counts that lacks most of it in sum; without one, the whole with a depth of 0. Runs are islands of a window."""
    every = Window.partitionBy(*keys)
    rows = counts.withColumn("middle_", F.median(F.when(F.col(n) > 0, F.col(n))).over(every)).withColumn("low_", F.coalesce(F.col(n) < F.col("middle_"), F.lit(False)))
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*keys, "low_").orderBy(pos))
    runs = rows.withColumn("island_", island).groupBy(*keys, "low_", "island_").agg(F.min(pos).alias("begin"), (F.max(pos) + 1).alias("end"), F.sum(F.col("middle_") - F.col(n)).alias("depth"))
    best = runs.groupBy(*keys).agg(F.min("begin").alias("first"), F.max("end").alias("last"), F.max(F.when(F.col("low_"), F.struct("depth", (-F.col("begin")).alias("back"), "end"))).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.back"), "first").alias("begin"), F.coalesce("b.end", "last").alias("end"), F.coalesce("b.depth", F.lit(0.0)).alias("depth"))


def inline_groups(notes: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, id, seed, nth: inline notes (keys, id, pos, box) with the id their group began with, and their place in it."""
    seeds = _gathered(notes, keys, pos).withColumn("seeds", _all_pages(_seeds)("lines")).select(*keys, "lines", F.posexplode("seeds").alias("i", "s"))
    found = seeds.select(*keys, F.get("lines", F.col("i"))["id"].alias("id"), F.get("lines", F.col("s"))["id"].alias("seed"), "i")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "seed").orderBy("i"))).drop("i")


def upper_middle(x: Column) -> Column:
    """Of the values in order the one behind the middle; null without any."""
    return F.get(F.sort_array(F.collect_list(x)), F.expr("0") + F.floor(F.count(x) / 2).cast("int"))


def page_order(lines: DataFrame, page: str) -> DataFrame:
    """page, id, rank of lines (page, id, pos, container, ord, inline, conf, box) as they are read.

    Inline notes are put together first (inline_groups); a group is one line with the union of the boxes and the median
    of ord, in the container of its first note that has one. The lines of a container are in line_order, without those
    that repeat their neighbour (layout.drop_adjacent); so are the notes of a group. Containers, by the upper median of
    their lines' ord, and loose lines by ord make the page; what has no ord comes last, and loose lines that repeat
    their neighbour go. Groups then give way to their notes.
    """
    lines = lines.withColumn("conf", F.coalesce("conf", F.lit(-1.0)))
    notes = inline_groups(lines.where("inline"), [page])
    members = lines.where("inline").join(notes, [page, "id"])
    place = F.min(F.when(F.col("container").isNotNull(), F.struct("nth", "pos", "container")))
    first = F.min(F.struct("nth", "pos"))
    box = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    groups = members.groupBy(page, "seed").agg(place.alias("p"), first.alias("f"), F.median("ord").alias("ord"), upper_middle(F.col("ord")).alias("loose_ord"), *box)
    element = ["id", "seed", "pos", "container", "ord", "loose_ord", "conf", *SIDES]
    groups = groups.select(page, F.col("seed").alias("id"), "seed", F.coalesce("p.pos", "f.pos").alias("pos"), "p.container", "ord", "loose_ord", F.lit(-1.0).alias("conf"), *SIDES)
    single = lines.where("not coalesce(inline, false)").withColumns({"seed": F.lit(None).cast(dict(lines.dtypes)["id"]), "loose_ord": F.col("ord")})
    elements = single.select(page, *element).unionByName(groups.select(page, *element))

    def sorted_within(rows: DataFrame, key: str) -> DataFrame:
        keyed = rows.withColumn("key_", F.struct(page, key))
        ranks = line_order(keyed, ["key_"]).withColumnRenamed("id", "id_")
        placed = keyed.join(ranks.withColumnRenamed("key_", "of_"), (F.col("key_") == F.col("of_")) & (F.col("id") == F.col("id_"))).drop("of_", "id_")
        return la.drop_adjacent(placed, "key_").drop("key_")

    inside = sorted_within(elements.where("container is not null"), "container").withColumnRenamed("rank", "inner")
    within = sorted_within(members.withColumn("loose_ord", F.col("ord")).select(page, *element), "seed").select(page, "seed", F.col("id").alias("note"), F.col("rank").alias("note_rank"))
    blocks = elements.where("container is not null").groupBy(page, "container").agg(upper_middle(F.col("ord")).alias("ord"), F.min("pos").alias("pos"))
    none = F.lit(None)
    blocks = blocks.select(page, none.cast(dict(lines.dtypes)["id"]).alias("id"), none.cast(dict(lines.dtypes)["id"]).alias("seed"), "container", "ord", "pos", F.lit(-1.0).alias("conf"), *(F.lit(0.0).alias(c) for c in SIDES))  # no box: like nothing beside it
    loose = elements.where("container is null").select(page, "id", "seed", "container", F.col("loose_ord").alias("ord"), "pos", "conf", *(F.col(c).cast("double").alias(c) for c in SIDES))
    top = blocks.unionByName(loose).withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.col("ord").asc_nulls_last(), "pos")))
    top = la.drop_adjacent(top, page).withColumnRenamed("rank", "outer")
    body = top.where("container is not null").select(page, "container", "outer").join(inside.select(page, "container", "id", "seed", "inner"), [page, "container"])
    every = body.select(page, "outer", "inner", "id", "seed").unionByName(top.where("container is null").select(page, "outer", F.lit(0).alias("inner"), "id", "seed"))
    full = every.join(within, [page, "seed"], "left").select(page, F.coalesce("note", "id").alias("id"), "outer", "inner", "note_rank")
    return full.select(page, "id", F.row_number().over(Window.partitionBy(page).orderBy("outer", "inner", "note_rank")).alias("rank"))

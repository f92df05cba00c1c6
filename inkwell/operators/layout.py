"""Boxes on pages: overlaps, assignment, islands and reading order. Boxes are x1, y1, x2, y2."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def overlap_area(a: tuple, b: tuple) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: tuple, b: tuple) -> Column:
    both = overlap_area(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def place_lines(lines: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """line, block, how of every row of lines: the block that holds the line's centre with the most overlap (by the line's
    area), else the nearest block by the distance of centres; ties go to the earlier block; `unmatched` where a page has none.

    lines: page, line, box; blocks: page, block, pos, box. A page's blocks are gathered and each line looks through them,
    so pairs are neither rows nor sorted.
    """
    return _told(_best(lines, blocks, page), page)


def assign_lines(lines: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """place_lines with a row for each number of a page's lines: of lines of equal number (one of many boxes) the best pair
    counts."""
    return _told(_best(lines, blocks, page).groupBy(page, "line").agg(F.max("b").alias("b")), page)


def _best(lines: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """page, line, b: for every row of lines its best block and how well that fits; null where the page has none."""
    gathered = blocks.groupBy(page).agg(F.collect_list(F.struct("block", "pos", "x1", "y1", "x2", "y2")).alias("blocks_"))
    la = box()
    cx, cy = (la[0] + la[2]) / 2, (la[1] + la[3]) / 2

    def fit(x: Column) -> Column:
        ba = _box_struct(x)
        inside = (cx >= ba[0]) & (cx <= ba[2]) & (cy >= ba[1]) & (cy <= ba[3])
        share = overlap_area(la, ba) / F.greatest(area(la), F.lit(1.0))
        far = F.pow(cx - (ba[0] + ba[2]) / 2, F.lit(2)) + F.pow(cy - (ba[1] + ba[3]) / 2, F.lit(2))
        return F.struct(F.coalesce(inside, F.lit(False)).alias("held"), F.when(inside, share).otherwise(-far).alias("fit"), (-x["pos"]).alias("back"), x["block"].alias("block"), inside.alias("inside"))

    return lines.join(gathered, page, "left").select(page, "line", F.array_max(F.transform("blocks_", fit)).alias("b"))


def _told(met: DataFrame, page: str) -> DataFrame:
    return met.select(page, "line", F.coalesce("b.block", F.lit("unmatched")).alias("block"), F.when(F.col("b.block").isNull(), "none").when(F.col("b.inside"), "inside").otherwise("nearest").alias("how"))


def nested(boxes: DataFrame, page: str, id_: str, margin: float) -> DataFrame:
    """page, inner, outer of the boxes that lie in another of their page, give or take a margin."""
    o = boxes.select(F.col(page).alias("o_page"), F.col(id_).alias("outer"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    a, b = box(), box("o_")
    test = (F.col(page) == F.col("o_page")) & (F.col(id_) != F.col("outer")) & (a[0] >= b[0] - margin) & (a[1] >= b[1] - margin) & (a[2] <= b[2] + margin) & (a[3] <= b[3] + margin)
    return boxes.join(o, test).select(page, F.col(id_).alias("inner"), "outer")


def column_islands(boxes: DataFrame, page: str, gap: Column) -> DataFrame:
    """page, island, n, union box: boxes in order of x1; a new island begins where the gap to the box before exceeds
    `gap`."""
    w = Window.partitionBy(page).orderBy("x1", "y1", "x2", "y2")
    rows = boxes.withColumn("new", F.when(F.col("x1") - F.lag("x1").over(w) >= gap, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(page, "island").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def midpoint_boundaries(anchors: DataFrame, doc: str) -> DataFrame:
    """doc, page, start: page starts halfway between the anchors (doc, page, at) around them; missing anchors are
    interpolated linearly between their neighbours, and the first start is 0."""
    w = Window.partitionBy(doc).orderBy("page")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("at").isNotNull(), F.struct("page", "at"))
    rows = anchors.withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("n", F.first(known, ignorenulls=True).over(ahead))
    between = F.floor(F.col("p.at") + (F.col("n.at") - F.col("p.at")) * (F.col("page") - F.col("p.page")) / (F.col("n.page") - F.col("p.page")))
    rows = rows.withColumn("est", F.coalesce("at", between.cast("long"), F.col("p.at"), F.col("n.at")))
    start = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.floor((F.col("est") + F.lag("est").over(w)) / 2))
    return rows.select(doc, "page", start.cast("long").alias("start"))


def normalized_box(a: tuple, width: Column, height: Column, grid: int = 1000) -> Column:
    """The box on a grid of 0 to grid - 1."""
    on = lambda v, size: F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(v * grid / size)))
    return F.struct(on(a[0], width).alias("x1"), on(a[1], height).alias("y1"), on(a[2], width).alias("x2"), on(a[3], height).alias("y2"))


def _box_struct(x: Column) -> tuple[Column, Column, Column, Column]:
    return x["x1"], x["y1"], x["x2"], x["y2"]


def _folded(boxes: DataFrame, keys: list[str], order: list[Column], step, schema_of: DataFrame) -> DataFrame:
    """Rows of each group that a fold over them, in order, keeps. The fold runs in the JVM, a page at a time."""
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(F.col(c) for c in schema_of.columns)).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])
    grouped = boxes.groupBy(*keys).agg(rows.alias("rows"))
    none = F.slice(F.col("rows"), 1, 0)
    return grouped.select(F.inline(F.aggregate("rows", none, step)))


def non_max_suppression(boxes: DataFrame, keys: list[str], least_iou: float = 0.45) -> DataFrame:
    """Rows of boxes (keys, id, conf, box) that stay: by falling confidence, a box goes if it overlaps one that stays.
    A group holds the boxes of one page and class."""
    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: iou(_box_struct(k), _box_struct(x)) >= least_iou)
        return F.when(hit, kept).otherwise(F.array_append(kept, x))

    return _folded(boxes, keys, [-F.col("conf"), F.col("id")], step, boxes)


def reading_order(lines: DataFrame, page: str, tolerance: float, right_to_left: bool = True) -> DataFrame:
    """page, id, rank: lines in columns of like x centre, the columns from the right (or left), each from the top.

    A column goes on while the next centre is within the tolerance of the last one, which no sort key can say, so
    columns are found as islands of a running sum.
    """
    cx = (F.col("x1") + F.col("x2")) / 2
    x = -cx if right_to_left else cx
    w = Window.partitionBy(page).orderBy("x", "y1", "id")
    rows = lines.withColumn("x", x)
    rows = rows.withColumn("new", F.when(F.col("x") - F.lag("x").over(w) > tolerance, 1).otherwise(0))
    rows = rows.withColumn("column", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(page, "id", F.row_number().over(Window.partitionBy(page).orderBy("column", "y1", "id")).alias("rank"))


def _widest(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """(width, beginning) of the widest gap that no interval covers."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    gaps = low[order][1:] - reach[:-1]
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    i = int(gaps.argmax())
    return float(gaps[i]), float(reach[i])


def _cut_order(lines: list[dict]) -> list[int]:
    b = np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in lines], float)
    ids, out, todo = [r["id"] for r in lines], [], [np.arange(len(lines))]
    while todo:
        part = todo.pop()
        (gx, cx), (gy, cy) = _widest(b[part, 0], b[part, 2]), _widest(b[part, 1], b[part, 3])
        if max(gx, gy) <= 0:
            out += sorted(part, key=lambda i: (b[i, 1], -b[i, 0], ids[i]))
        elif gx >= gy:
            todo += [part[b[part, 0] < cx], part[b[part, 0] >= cx]]
        else:
            todo += [part[b[part, 1] >= cy], part[b[part, 1] < cy]]
    return [ids[i] for i in out]


@F.pandas_udf(T.ArrayType(T.LongType()))
def cut_order(pages: pd.Series) -> pd.Series:
    return pd.Series([_cut_order(list(p)) for p in pages])


def xy_cut(lines: DataFrame, page: str) -> DataFrame:
    """page, id, rank by recursive cuts of the page at its widest empty gap, across x or y: the parts right of a gap,
    or above it, come first. A kernel over whole pages, many to a batch."""
    pages = lines.groupBy(page).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "x1", "y1", "x2", "y2")).alias("lines"))
    return pages.select(page, F.posexplode(cut_order("lines")).alias("pos", "id")).select(page, "id", (F.col("pos") + 1).alias("rank"))


def char_boxes(lines: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, i, char, x1, y1, x2, y2: a line's box cut evenly among its characters, along its longer side."""
    n = F.char_length(text)
    rows = lines.where(n > 0).select(key, "x1", "y1", "x2", "y2", n.alias("n"), F.posexplode(F.filter(F.split(text, "", -1), lambda c: c != "")).alias("i", "char"))
    tall = (F.col("y2") - F.col("y1")) > (F.col("x2") - F.col("x1"))
    cut = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") + k) / F.col("n")
    return rows.select(
        key, "i", "char", F.when(tall, F.col("x1")).otherwise(cut("x1", "x2", 0)).alias("x1"), F.when(tall, cut("y1", "y2", 0)).otherwise(F.col("y1")).alias("y1"),
        F.when(tall, F.col("x2")).otherwise(cut("x1", "x2", 1)).alias("x2"), F.when(tall, cut("y1", "y2", 1)).otherwise(F.col("y2")).alias("y2"),
    )


def polygon_box(points: Column) -> Column:
    """The box of array<struct<x, y>>."""
    return F.struct(F.array_min(points["x"]).alias("x1"), F.array_min(points["y"]).alias("y1"), F.array_max(points["x"]).alias("x2"), F.array_max(points["y"]).alias("y2"))


def crop_box(b: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """Pixel box of four numbers: shares (x, y, w, h) if all lie in 0 to 1, else pixels (x1, y1, x2, y2); padded, kept
    inside the image, and null if nothing is left."""
    share = F.forall(b, lambda v: (v >= 0) & (v <= 1))
    g = lambda i: F.element_at(b, i)
    x1, y1 = F.when(share, g(1) * width).otherwise(g(1)) - pad, F.when(share, g(2) * height).otherwise(g(2)) - pad
    x2, y2 = F.when(share, (g(1) + g(3)) * width).otherwise(g(3)) + pad, F.when(share, (g(2) + g(4)) * height).otherwise(g(4)) + pad
    inside = lambda v, top: F.least(F.greatest(F.floor(v), F.lit(0)), top.cast("bigint"))
    c = F.struct(inside(x1, width).alias("x1"), inside(y1, height).alias("y1"), inside(x2, width).alias("x2"), inside(y2, height).alias("y2"))
    return F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), c)


def drop_adjacent(lines: DataFrame, page: str, least: float = 0.8) -> DataFrame:
    """Lines in reading order (page, rank, conf, box) without those that overlap the last line kept by more than
    `least` of the smaller box; of the two the more confident stays."""
    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        small = F.least(area(_box_struct(last)), area(_box_struct(x)))
        hit = last.isNotNull() & F.coalesce((small > 0) & (overlap_area(_box_struct(last), _box_struct(x)) > least * small), F.lit(False))
        swapped = F.array_append(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), x)
        return F.when(~hit, F.array_append(kept, x)).when(x["conf"] > last["conf"], swapped).otherwise(kept)

    return _folded(lines, [page], [F.col("rank")], step, lines)


def touching_groups(boxes: DataFrame, page: str, dilate: float = 0.1) -> DataFrame:
    """page, id, seed: boxes joined to the earliest box of their page (by id) that meets them when both grow by a share
    of their sides, else to themselves. One round of a self-join by page: groups are stars around their seed."""
    grown = [F.col("x1") - (F.col("x2") - F.col("x1")) * dilate, F.col("y1") - (F.col("y2") - F.col("y1")) * dilate, F.col("x2") + (F.col("x2") - F.col("x1")) * dilate, F.col("y2") + (F.col("y2") - F.col("y1")) * dilate]
    g = boxes.select(F.col(page), "id", *(c.alias(n) for c, n in zip(grown, ("x1", "y1", "x2", "y2"), strict=True)))
    o = g.withColumnsRenamed({page: "o_page", "id": "o_id", "x1": "o_x1", "y1": "o_y1", "x2": "o_x2", "y2": "o_y2"})
    meet = (F.col(page) == F.col("o_page")) & (F.col("o_id") <= F.col("id")) & (F.col("x1") <= F.col("o_x2")) & (F.col("x2") >= F.col("o_x1")) & (F.col("y1") <= F.col("o_y2")) & (F.col("y2") >= F.col("o_y1"))
    return g.join(o, meet).groupBy(page, "id").agg(F.min("o_id").alias("seed"))


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a polygon (array<struct<x, y>>): the crossings to its right are odd."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(points, i).alias("a"), F.element_at(points, F.when(i == n, 1).otherwise(i + 1)).alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], 1.0).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1

"""Whole flows put together from the operators: recognition runs, imports, drafts and layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout as la
from . import reports as rp
from . import selection as se
from . import spans as sp
from .alignment import salvage_json


def column_groups(detections: DataFrame, page: str) -> DataFrame:
    """page, group, n, cx, cy and union box: text columns from the right, grouped while the next one is nearer than twice
    the median gap of the page and begins on the same level, within 0.15 of the median height. Both are tested between
    neighbours only, so groups are islands of a running sum."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    w = Window.partitionBy(page).orderBy(F.desc("cx"), "id")
    rows = detections.withColumns({"cx": cx, "cy": cy, "high": F.col("y2") - F.col("y1")})
    rows = rows.withColumns({"gap": F.abs(F.lag("cx").over(w) - F.col("cx")), "step": F.abs(F.lag("y1").over(w) - F.col("y1"))})
    typical = rows.groupBy(page).agg(F.percentile("gap", 0.5).alias("mid_gap"), F.percentile("high", 0.5).alias("mid_high"))
    rows = rows.join(typical, page)
    goes_on = (F.col("gap") < 2 * F.col("mid_gap")) & (F.col("step") < 0.15 * F.col("mid_high"))
    rows = rows.withColumn("new", F.when(F.col("gap").isNotNull() & ~goes_on, 1).otherwise(0))
    rows = rows.withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(page, "group").agg(F.count(F.lit(1)).alias("n"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def layout_blocks(detections: DataFrame, page: str, types: dict[int, str], width: float, height: float) -> DataFrame:
    """page, block_id, block_type, reading_order, skip and box of the blocks that detections (id, cls, box) make: text
    columns in groups, all others one by one, in columns from the right; seals are skipped. Classes without a type are
    left out."""
    kind = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    rows = detections.withColumn("block_type", kind[F.col("cls")]).where("block_type is not null")
    box = ["x1", "y1", "x2", "y2"]
    text = column_groups(rows.where("block_type = 'main_text'"), page).select(page, F.col("group").cast("bigint").alias("key"), F.lit("main_text").alias("block_type"), "cx", "cy", *box)
    others = rows.where("block_type <> 'main_text'").select(page, (F.col("id") + (1 << 32)).alias("key"), "block_type", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), *box)
    placed = se.groups_in_columns(text.unionByName(others), page, "key")
    inside = lambda c, top: F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(top)))
    return placed.select(page, F.format_string("b%02d", "rank").alias("block_id"), "block_type", (F.col("rank") - 1).alias("reading_order"), (F.col("block_type") == "seal").alias("skip"), *(inside(c, top).alias(c) for c, top in zip(box, (width, height, width, height), strict=True)))


def recognise_page(blocks: DataFrame, lines: DataFrame, old: DataFrame, page: str) -> DataFrame:
    """page, block, text, origin after a page was recognised: blocks in reading order without those to be skipped, lines
    (id, text, box) put into the blocks that hold them, from the top, and the results put over what there was (page,
    block, text)."""
    run = se.by_reading_order(se.blocks_to_run(blocks), page)
    placed = la.assign_lines(lines.withColumnRenamed("id", "line"), run.select(page, "block", F.col("rank").alias("pos"), "x1", "y1", "x2", "y2"), page)
    texts = placed.where("how <> 'none'").join(lines.select(page, F.col("id").alias("line"), "y1", "text"), [page, "line"])
    new = se.joined_in_order(texts.withColumn("key", F.struct(page, "block")), "key", ["y1", "line"], "text", "\n")
    both = old.select(F.struct(page, "block").alias("key"), F.col("text").alias("was")).join(new, "key", "full_outer")
    origin = F.when(F.col("text").isNull(), "kept").when(F.col("was").isNull(), "added").otherwise("replaced")
    return both.select(f"key.{page}", "key.block", F.coalesce("text", "was").alias("text"), origin.alias("origin"))


def draft_requests(texts: DataFrame, notes: DataFrame, key: str, enders: str = "。？！", text_col: str = "text") -> DataFrame:
    """key, sentence, request: what a model is asked for each sentence of a text: the sentence, then a line for each note
    (id, start, end, note) that overlaps it, in order of their starts. A sentence without notes stands alone."""
    sentences = texts.select(key, text_col, F.inline(sp.split_sentences(F.col(text_col), enders)))
    sentences = sentences.select(key, F.col("id").alias("sentence"), "start", "end", F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start") + 1).alias("body"))
    found = sp.overlap_join(sentences, notes.select(key, "start", "end", "id", "note"), key, "left")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("r_start", "id", "note")))), lambda x: x["note"])
    return found.groupBy(key, "sentence").agg(F.array_join(F.concat(F.array(F.trim(F.first("body"))), lines), "\n").alias("request"))


def staged_entries(answers: DataFrame, block: str, raw: str, size: Column) -> DataFrame:
    """block, headword, meaning, start, end of a model's answers (JSON, as models give it): spans are put in order and
    moved into the text of `size` characters; entries without a headword are left out."""
    parsed = F.from_json(salvage_json(raw), "array<struct<headword: string, meaning: string, start: int, end: int>>")
    rows = answers.select(block, size.alias("n"), F.inline(parsed)).where(F.coalesce("headword", F.lit("")) != "")
    a, b = sp.clamp_span(F.coalesce("start", F.lit(0)), F.coalesce("end", "start", F.lit(0)), F.col("n"))
    return rows.select(block, "headword", "meaning", a.alias("start"), b.alias("end"))


def container_order(lines: DataFrame, page: str) -> DataFrame:
    """page, id, rank: the containers of a page (and lines without one) by the upper median of their lines' ord, lines
    by ord within; lines without an ord come last, by id."""
    own = F.coalesce(F.concat(F.lit("c"), F.col("container").cast("string")), F.concat(F.lit("l"), F.col("id").cast("string")))
    rows = lines.withColumn("own", own)
    ords = F.sort_array(F.collect_list("ord"))
    middle = rows.groupBy(page, "own").agg(F.get(ords, F.expr("size(collect_list(ord)) div 2")).alias("middle"))
    rows = rows.join(middle, [page, "own"])
    order = Window.partitionBy(page).orderBy(F.col("middle").asc_nulls_last(), "own", F.col("ord").asc_nulls_last(), "id")
    return rows.select(page, "id", F.row_number().over(order).alias("rank"))


def _smoothed(orders: list[float], begins: list, ends: list, diagonal: float) -> list[int]:
    """The cheapest path from the first to the last place that visits every place, by steps of at most two places (one
    from 20 places on), as indexes."""
    n = len(orders)
    spread = max(orders) - min(orders) if n else 0.0
    if n < 3 or n >= 20 or not spread:
        return list(range(n))

    def cost(i: int, j: int) -> float:
        return float(np.hypot(begins[j][0] - ends[i][0], begins[j][1] - ends[i][1])) / diagonal + abs(orders[i] - orders[j]) / spread

    # With steps of two at most, a path that leaves a gap has to step back into it at once: i, i + 2, i + 1, i + 3.
    best: list[tuple[float, list[int]] | None] = [None] * n
    best[0] = (0.0, [0])
    for i in range(n - 1):
        if best[i] is None:
            continue
        total, path = best[i]
        moves = [[i + 1]] + ([[i + 2, i + 1, i + 3]] if i + 3 < n else [])
        for m in moves:
            c, at = total, i
            for j in m:
                c, at = c + cost(at, j), j
            if best[at] is None or c < best[at][0]:
                best[at] = (c, path + m)
    return best[n - 1][1]


@F.pandas_udf(T.ArrayType(T.LongType()))
def smooth_places(places: pd.Series, diagonal: pd.Series) -> pd.Series:
    """Ids of a page's places (array of structs id, ord, bx, by, ex, ey, in order) after smoothing."""
    return pd.Series([[int(p[i]["id"]) for i in _smoothed([r["ord"] for r in p], [(r["bx"], r["by"]) for r in p], [(r["ex"], r["ey"]) for r in p], d)] for p, d in zip(places, diagonal, strict=True)])


def smooth_order(lines: DataFrame, page: str, diagonal: float) -> DataFrame:
    """page, id, rank: lines in the cheapest order that differs from that of ord by swaps of neighbours: what a step costs
    is the way from a line's bottom to the next one's top by the page's diagonal, and the difference of ord by the
    page's range. The first and the last line stay; pages with fewer than 3 or more than 19 lines stay as they are."""
    middle = (F.col("x1") + F.col("x2")) / 2
    row = F.struct("ord", "id", middle.alias("bx"), F.col("y1").alias("by"), middle.alias("ex"), F.col("y2").alias("ey"))
    pages = lines.groupBy(page).agg(F.array_sort(F.collect_list(row)).alias("places"))
    return pages.select(page, F.posexplode(smooth_places("places", F.lit(float(diagonal)))).alias("pos", "id")).select(page, "id", (F.col("pos") + 1).alias("rank"))


def page_tree(blocks: DataFrame, lines: DataFrame, page: str, least: float = 0.1, size: float = 5.0) -> DataFrame:
    """page, blocks (array of block, lines) and loose lines of detections: boxes below a side of `size` or a confidence
    of `least` are left out, and lines lie in the block that holds their centre, or are loose."""
    big = (F.col("x2") - F.col("x1") >= size) & (F.col("y2") - F.col("y1") >= size)
    b, ls = blocks.where(big), lines.where(big & (F.col("conf") >= least))
    placed = la.assign_lines(ls.withColumnRenamed("id", "line"), b, page)
    block = F.when(F.col("how") == "inside", F.col("block"))
    grouped = placed.groupBy(page, block.alias("block")).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    every = b.select(page, "block").unionByName(placed.select(page, F.lit(None).cast("string").alias("block"))).distinct()
    full = every.join(grouped.withColumnsRenamed({page: "page_", "block": "block_"}), (F.col(page) == F.col("page_")) & F.col("block").eqNullSafe(F.col("block_")), "left")
    none = F.expr("cast(array() as array<bigint>)")
    return full.groupBy(page).agg(
        F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", F.coalesce("lines", none).alias("lines"))))).alias("blocks"),
        F.coalesce(F.first(F.when(F.col("block").isNull(), F.col("lines")), ignorenulls=True), none).alias("loose"),
    )


def import_pages(lines: DataFrame, document: str) -> DataFrame:
    """document, kind, content: the files that importing a text of two scripts writes for a document: its original, and
    its translation as a sidecar. lines have class."""
    from . import texts as tx

    split = tx.split_by_class(lines, document)
    rows = split.select(document, F.col("original_text").alias("text"), F.expr("cast(array() as array<int>)").alias("marks"), F.expr("cast(array() as array<int>)").alias("formatting"), F.col("translation_text").alias("translation"))
    return rp.sidecars(rows, document)

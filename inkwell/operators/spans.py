"""Stand-off spans over texts: 0-based, inclusive end, counted in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import letters, once, piece, running, starts_of


def valid_span(start: Column, end: Column, n: Column) -> Column:
    """Spans inside a text of n characters, not reversed."""
    return (start >= 0) & (end < n) & (start <= end)


def clamp_span(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Swap reversed bounds and move both into the text."""
    low, high = F.least(start, end), F.greatest(start, end)
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), n - 1)
    return inside(low), inside(high)


def shift_spans(spans: DataFrame, by: Column, start: str = "start", end: str = "end") -> DataFrame:
    return spans.withColumn(start, F.col(start) - by).withColumn(end, F.col(end) - by)


def overlap_join(left: DataFrame, right: DataFrame, block: str, how: str = "inner", contained: bool = False) -> DataFrame:
    """Join spans of the same block that overlap (or right inside left). The block keeps it an equi-join.

    Both sides have block, start and end; right's span columns come out as r_start and r_end.
    """
    r = right.withColumnsRenamed({block: "r_block", "start": "r_start", "end": "r_end"})
    if contained:
        test = (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end"))
    else:
        test = (F.col("r_start") <= F.col("end")) & (F.col("r_end") >= F.col("start"))
    return left.join(r, (F.col(block) == F.col("r_block")) & test, how).drop("r_block")


def overlap_join_long(left: DataFrame, right: DataFrame, block: str, width: int) -> DataFrame:
    """overlap_join for blocks with very many spans: spans meet in the buckets of `width` characters they touch, and a
    pair is kept in the first bucket they share."""
    buckets = lambda: F.explode(F.expr(f"sequence(start div {width}, end div {width})"))
    a = left.withColumn("bucket", buckets())
    b = right.withColumn("bucket", buckets()).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    both = a.join(b, [block, "bucket"]).where("r_start <= end and r_end >= start")
    return both.where(F.expr(f"bucket = greatest(start div {width}, r_start div {width})")).drop("bucket")


def split_sentences(text: Column, enders: str = "。？！") -> Column:
    """array<struct<id, start, end>>: a sentence ends with an ender; what follows the last one is a sentence too."""
    lengths = F.filter(F.transform(F.split(text, f"(?<=[{enders}])"), lambda s: F.char_length(s)), lambda n: n > 0)
    placed = lambda n: F.transform(F.arrays_zip(n.alias("n"), running(n).alias("to")), lambda x, i: F.struct(i.alias("id"), (x["to"] - x["n"]).alias("start"), (x["to"] - 1).alias("end")))
    return F.when(text.isNotNull(), once(lengths, placed))


def render_marks(texts: DataFrame, marks: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, rendered: each mark's `before` goes before its first character and `after` behind its last, in the order of
    seq; marks outside the text are dropped. marks: key, seq, start, end, before, after (either may be null)."""
    gap = F.explode(F.array(
        F.struct((F.col("end") + 1).alias("gap"), F.lit(0).alias("side"), F.col("seq"), F.coalesce("after", F.lit("")).alias("put"), "start", "end"),
        F.struct(F.col("start").alias("gap"), F.lit(1).alias("side"), F.col("seq"), F.coalesce("before", F.lit("")).alias("put"), "start", "end"),
    )).alias("g")
    puts = marks.select(key, gap).groupBy(key).agg(F.array_sort(F.collect_list("g")).alias("puts"))
    n = F.char_length(text_col)
    valid = F.filter(F.coalesce("puts", F.expr("cast(array() as array<struct<gap: int, side: int, seq: int, put: string, start: int, end: int>>)")), lambda g: valid_span(g["start"], g["end"], n))
    rows = texts.join(puts, key, "left").withColumn("puts", valid).withColumn("chars", F.when(F.size("puts") > 0, letters(F.col(text_col))))
    # what lies between neighbouring gaps, each followed by what is put there
    before = F.concat(F.array(F.lit(0)), F.transform("puts", lambda g: g["gap"].cast("int")))
    parts = F.zip_with("puts", F.slice(before, F.lit(1), F.size("puts")), lambda g, at: F.concat(piece(F.col("chars"), at, g["gap"].cast("int") - at), g["put"]))
    end = F.try_element_at(before, F.lit(-1))
    done = F.concat(F.array_join(parts, ""), piece(F.col("chars"), end, F.size("chars") - end))
    return rows.select(key, F.when(F.size("puts") == 0, F.col(text_col)).otherwise(done).alias("rendered"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order (dropDuplicates does not keep an order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def replace_overlapping(marks: DataFrame, selection: DataFrame, block: str) -> DataFrame:
    """Marks of a block that overlap a selection give way to the selections' marks. Both: block, start, end, put."""
    s = selection.select(F.col(block).alias("s_block"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    kept = marks.join(s, (F.col(block) == F.col("s_block")) & (F.col("start") <= F.col("s_end")) & (F.col("end") >= F.col("s_start")), "left_anti")
    return kept.unionByName(selection)


def contiguous(rows: DataFrame, group: str, index: str) -> DataFrame:
    """group, n, contiguous: whether the selected indexes have no holes."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.max(index) - F.min(index) + 1 == F.count(F.lit(1))).alias("contiguous"))


def renumber_after_split(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    """A block of a work split into k >= 2 pieces takes the numbers from its own; later active blocks move by k - 1.

    blocks: work, block, seq, status; splits: work, seq, pieces (array). Returns work, seq, block, piece.
    """
    s = splits.where("size(filter(pieces, p -> trim(p) <> '')) >= 2").selectExpr("work", "seq as base", "filter(pieces, p -> trim(p) <> '') as pieces")
    active = blocks.where("not coalesce(status, '') in ('deprecated', 'archived')")
    moved = active.join(s, "work", "left").where("base is null or seq <> base")
    moved = moved.selectExpr("work", "if(seq > base, seq + size(pieces) - 1, seq) as seq", "block", "cast(null as string) as piece")
    made = active.join(s, "work").where("seq = base").selectExpr("work", "base", "block", "posexplode(pieces) as (i, piece)")
    return moved.unionByName(made.selectExpr("work", "base + i as seq", "block", "piece"))


def nearest_occurrence(texts: DataFrame, needle: Column, hint: Column, text_col: str = "text") -> Column:
    """Start of the occurrence of needle closest to hint (the earlier of two as close); null if there is none."""
    starts = starts_of(F.col(text_col), needle)
    return F.array_min(F.transform(starts, lambda s: F.struct(F.abs(s - hint).alias("far"), s.alias("start"))))["start"]

"""Cleaning, classifying and correcting texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import starts_of

HALF_WIDTH, FULL_WIDTH = ".,;:?!", "。，；：？！"


def lines_of(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, line_no, line."""
    return texts.select(key, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def script_counts(text: Column, first: str = r"\p{IsHan}", second: str = r"\p{IsHangul}") -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(first)), F.regexp_count(text, F.lit(second))


def classify_lines(lines: DataFrame, key: str, first: str = r"\p{IsHan}", second: str = r"\p{IsHangul}", share: float = 0.8, initial: str = "original") -> DataFrame:
    """lines with class: `original` if at least `share` of the characters of both scripts are of the first, else
    `translation`; a line of neither script has the class of the line before it, the first such `initial`."""
    a, b = script_counts(F.col("line"), first, second)
    own = F.when(a + b == 0, None).when(a >= share * (a + b), "original").otherwise("translation")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("own", own).withColumn("class", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(initial))).drop("own")


def split_by_class(classified: DataFrame, key: str) -> DataFrame:
    """key, original_text, translation_text: the lines of each class joined by line breaks."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("class") == c) & (F.trim("line") != ""), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return classified.groupBy(key).agg(joined("original").alias("original_text"), joined("translation").alias("translation_text"))


def normalize_punctuation(text: Column) -> Column:
    return F.translate(text, HALF_WIDTH, FULL_WIDTH)


def leading_spaces(texts: DataFrame, key: str, follow: str = r"[\x{4E00}-\x{9FFF}]", most: int = 3, text_col: str = "text") -> DataFrame:
    """key, line_no, raise_count, raw_pos of the lines with 1 to `most` spaces before a character of `follow`; raw_pos
    is where the line begins in the text."""
    lines = lines_of(texts, key, text_col)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("raw_pos", F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0)))
    n = F.char_length(F.regexp_extract("line", f"^( {{1,{most}}}){follow}", 1))
    return placed.withColumn("raise_count", n).where("raise_count > 0").select(key, "line_no", "raise_count", "raw_pos")


def apply_corrections(texts: DataFrame, corrections: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, corrected, n_applied: patches replace `original` at char_index by `corrected` where the text still has it
    there; from the last index to the first, so that earlier offsets stand. A null index is skipped."""
    patches = corrections.where("char_index is not null").groupBy(key).agg(F.collect_list(F.struct("char_index", "original", "corrected")).alias("patches"))
    ordered = F.reverse(F.array_sort(F.coalesce("patches", F.expr("cast(array() as array<struct<char_index: int, original: string, corrected: string>>)"))))
    there = lambda t, p: F.substring(t, p["char_index"] + 1, F.char_length(p["original"])) == p["original"]
    folded = F.aggregate(
        ordered, F.struct(F.col(text_col).alias("t"), F.lit(0).alias("n")),
        lambda acc, p: F.when(there(acc["t"], p), F.struct(F.concat(F.substring(acc["t"], F.lit(1), p["char_index"]), p["corrected"], F.substring(acc["t"], p["char_index"] + F.char_length(p["original"]) + 1, F.char_length(acc["t"]))).alias("t"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    return texts.join(patches, key, "left").select(key, folded["t"].alias("corrected"), folded["n"].alias("n_applied"))


def occurrences(text: Column, needle: str) -> Column:
    """array<int>: starts of the non-overlapping occurrences of needle."""
    return starts_of(text, F.lit(needle))


def search_char(texts: DataFrame, char: str, key: str, corrected: DataFrame | None = None, width: int = 5, text_col: str = "text") -> DataFrame:
    """key, char_index, context of each occurrence, without the places that corrected (key, char_index) already has."""
    found = texts.select(key, text_col, F.explode(occurrences(F.col(text_col), char)).alias("char_index"))
    left = F.greatest(F.col("char_index") - width, F.lit(0))
    found = found.select(key, "char_index", F.substring(F.col(text_col), left + 1, F.col("char_index") + len(char) + width - left).alias("context"))
    return found if corrected is None else found.join(corrected, [key, "char_index"], "left_anti")


def split_by_markers(texts: DataFrame, markers: str, key: str, text_col: str = "text") -> DataFrame:
    """key, ordinal, marker, segment: what follows each match of the pattern, trimmed; all text, with a null marker,
    where there is none."""
    hits, parts = F.regexp_extract_all(text_col, F.lit(markers), 0), F.split(text_col, markers, -1)
    pairs = F.when(F.size(hits) == 0, F.array(F.struct(F.lit(None).cast("string").alias("marker"), F.trim(text_col).alias("segment")))).otherwise(
        F.transform(hits, lambda h, i: F.struct(h.alias("marker"), F.trim(F.element_at(parts, i + 2)).alias("segment")))
    )
    return texts.select(key, F.posexplode(pairs).alias("ordinal", "p")).select(key, "ordinal", "p.marker", "p.segment")


def reclean_shift(edits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Spans after edits (key, type, pos): each insert at or before a bound moves it by one, each delete before it back."""
    moves = edits.groupBy(key).agg(F.collect_list(F.struct("pos", F.when(F.col("type") == "insert", 1).when(F.col("type") == "delete", -1).otherwise(0).alias("by"))).alias("moves"))
    moved = lambda c: F.col(c) + F.aggregate(F.filter(F.coalesce("moves", F.expr("cast(array() as array<struct<pos: int, by: int>>)")), lambda m: F.when(m["by"] > 0, m["pos"] <= F.col(c)).otherwise(m["pos"] < F.col(c))), F.lit(0), lambda acc, m: acc + m["by"])
    return spans.join(moves, key, "left").withColumn("start", moved("start")).withColumn("end", moved("end")).drop("moves")

"""Everything there is about a citation mark: its text, the text with marks, translations, notes and the book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import letters, piece
from . import spans as sp

#: What a translation has where it says nothing.
LANGUAGE, STATUS = "ko", "draft"


def _listed(found: DataFrame, *fields: Column) -> DataFrame:
    """mark and rows: the rows met by each mark, in order of seq and id."""
    row = F.struct("seq", "id", *fields)
    return found.groupBy("mark").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("seq")).alias("rows"))


def resolve(marks: DataFrame, blocks: DataFrame, pages: DataFrame, punctuation: DataFrame, translations: DataFrame, annotations: DataFrame, bibliography: DataFrame, width: int = 256) -> DataFrame:
    """mark, original, punctuated, block_text, translations, annotations, bibliography, text_changed for each mark.

    marks: mark (unique), doc, page, block, start, end, snapshot; blocks: block, text; pages: doc, page, text;
    punctuation: block, seq, start, end, before, after; translations: doc, page, block, seq, id, start, end, source_text,
    translation, language, status; annotations: doc, page, block, seq, id, start, end, type, label, description;
    bibliography: doc, any columns.

    The text of a block that isn't known is that of its page. A span that ends beyond the text ends with it; one that
    begins there is empty. Marks of the punctuation that lie in the span are put into it. Translations and annotations of
    the block that overlap the span are listed in order. The text has changed if both it and the snapshot are there and
    differ. Spans meet in buckets of `width` letters, so a block may have any number of them.
    """
    text = F.coalesce("block_text_", "page_text_", F.lit(""))
    placed = marks.join(blocks.select("block", F.col("text").alias("block_text_")), "block", "left")
    placed = placed.join(pages.select("doc", "page", F.col("text").alias("page_text_")), ["doc", "page"], "left").withColumn("block_text", text).drop("block_text_", "page_text_")
    n = F.char_length("block_text")
    size = F.when(F.col("start") >= n, 0).when((F.col("start") <= F.col("end")) & (F.col("end") < n), F.col("end") - F.col("start") + 1).otherwise(n - F.col("start"))
    placed = placed.withColumn("original", piece(letters(F.col("block_text")), F.col("start"), size.cast("int")))

    spans = marks.select("mark", "doc", "page", "block", "start", "end").where("start <= end")
    inner = sp.overlap_join_long(spans.select("mark", "block", "start", "end"), punctuation.select("block", "seq", "start", "end", "before", "after"), "block", width).where("r_start >= start and r_end <= end")
    inner = inner.select("mark", "seq", (F.col("r_start") - F.col("start")).cast("int").alias("start"), (F.col("r_end") - F.col("start")).cast("int").alias("end"), "before", "after")
    rendered = sp.render_marks(placed.select("mark", F.col("original").alias("text")), inner, "mark").withColumnRenamed("rendered", "punctuated")

    def met(rows: DataFrame) -> DataFrame:
        keyed = lambda df: df.withColumn("place", F.struct("doc", "page", "block")).drop("doc", "page", "block")
        return sp.overlap_join_long(keyed(spans), keyed(rows), "place", width)

    said = _listed(met(translations), F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("language", F.lit(LANGUAGE)).alias("language"), F.coalesce("status", F.lit(STATUS)).alias("status"))
    noted = _listed(met(annotations), *(F.coalesce(c, F.lit("")).alias(c) for c in ("type", "label", "description")))
    books = bibliography.select("doc", F.struct(*(c for c in bibliography.columns if c != "doc")).alias("bibliography"))
    out = placed.join(rendered, "mark").join(said.withColumnRenamed("rows", "translations"), "mark", "left").join(noted.withColumnRenamed("rows", "annotations"), "mark", "left").join(books, "doc", "left")
    none = lambda c: F.slice(F.array(F.get(F.col(c), F.lit(0))), 1, 0)
    changed = F.coalesce((F.col("snapshot") != "") & (F.col("original") != "") & (F.col("snapshot") != F.col("original")), F.lit(False))
    return out.select("mark", "original", "punctuated", "block_text", F.coalesce("translations", none("translations")).alias("translations"), F.coalesce("annotations", none("annotations")).alias("annotations"), "bibliography", changed.alias("text_changed"))

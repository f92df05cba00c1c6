"""From documents to token ids: quality, near duplicates, contamination, mixing, tokens.

Each stage takes what its predecessor kept, as it was written and read again. Decisions are made for rows, named by
doc_id (which may be null or shared) and a hash of the text: rows of one id with different texts stay or go by
themselves, and rows that repeat both go together, but for the near-duplicate stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm._shared import _STAGED, id_in, join_skewed, keep_rows, remove_staged, staged, text_key
from inkwell.llm.decontaminate import found_items
from inkwell.llm.jaccard_join import linked_rows
from inkwell.llm.mixing import mix
from inkwell.llm.quality import quality
from inkwell.llm.queries import MIX_PARTS, table
from inkwell.llm.token_output import token_output

#: Names a row within this module.
KEY = ["row_id_", "text_key_"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row_id_": id_in("doc_id"), "text_key_": text_key("text")})


def _keys(rows: DataFrame) -> DataFrame:
    """The distinct keys of rows (doc_id, text_key), written."""
    return staged(rows.select(id_in("doc_id").alias("row_id_"), F.col("text_key").alias("text_key_")).distinct(), "row-keys")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, text_key)."""
    return keep_rows(_keyed(docs), _keys(gone), KEY, "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile of trusted text. Null and empty texts, and languages
    without trusted text, stay; without labels all stay."""
    return _without(docs, quality(docs, table(spark, sf_dir, "labels")).where("not keep"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of smallest id (of
    smallest text hash among rows of that id; null ids after all others). Rows without words stay."""
    rows = staged(linked_rows(docs, width=5, percent=80).where("component is not null").select("doc_id", "text_key", "component"), "linked-rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    rows = join_skewed(rows, first, "component", rows.count(), "text_key").withColumn("stays", place.eqNullSafe(F.col("first")))
    out = _without(docs, rows.where("not stays"))
    again = rows.where("stays").groupBy("doc_id", "text_key").count().where("count > 1")
    again = _keys(again)
    if again.isEmpty():
        return out
    keyed = _keyed(out)
    once = keep_rows(keyed, again, KEY).dropDuplicates(KEY)
    return keep_rows(keyed, again, KEY, "left_anti").unionByName(once).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark. Null and empty texts stay; without items all stay."""
    return _without(docs, found_items(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the rows of the files follow the schedule. Rows of equal slot and start
    follow each other by id, null ids first; a null source is the empty one."""
    placed = mix(docs, MIX_PARTS, carry=True)
    return placed.repartitionByRange("slot", "start", "doc_id").sortWithinPartitions("slot", "start", "doc_id").select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files, which hold the documents in the order of docs' files.

    docs that do not come from files are taken in the order of their ids, null ids first and equal ones by text. Null
    and empty texts have the end id alone.
    """
    order = ["doc_id"]
    if docs.inputFiles():
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        docs = docs.select("doc_id", "text", part.alias("file_part"), F.col("_metadata.row_index").alias("file_row"))
        order = ["file_part", "file_row"]
    return token_output(docs, order)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mix_sources", mixing_stage),
    ("token_output", token_stage),
]

#: Neither the language model nor the tokenizer can be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. What a stage staged goes once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(_STAGED)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        remove_staged(spark, since, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)

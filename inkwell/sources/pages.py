"""Readers and writers of the page tree: folder per document, file per page, JSON for what is laid over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_NAME = r"([^/]+)_page_(\d+)(?:_[^/]*)?\.[a-z]+$"
USAGE = "ts string, type string, provider string, model string, tokens_in bigint, tokens_out bigint, cost_usd double, elapsed_sec double, purpose string"


def page_key(path: Column) -> Column:
    """struct<part_id, page_num> of a page file's path; nulls if it is not one."""
    part = F.nullif(F.regexp_extract(path, PAGE_NAME, 1), F.lit(""))
    return F.struct(part.alias("part_id"), F.try_to_number(F.nullif(F.regexp_extract(path, PAGE_NAME, 2), F.lit("")), F.lit("999999999")).cast("int").alias("page_num"))


def page_path(folder: Column, part: Column, page: Column, suffix: str) -> Column:
    return F.concat(folder, F.lit("/"), F.format_string("%s_page_%03d", part, page), F.lit(suffix))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, part_id, page_num, text of root/<doc_id>/**/<part>_page_<n>.txt."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_page_*.txt")
    path = F.col("_metadata.file_path")
    rows = rows.select(F.regexp_extract(path, r"([^/]+)/(?:[^/]+/)*[^/]+$", 1).alias("folder"), page_key(path).alias("k"), F.col("value").alias("text"), path.alias("path"))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return rows.select(F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("doc_id"), "k.part_id", "k.page_num", "text")


def page_text(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, part_id, page_num) with text and exists: a page that is missing has the text ''."""
    found = pages.withColumn("exists", F.lit(True))
    return wanted.join(found, ["doc_id", "part_id", "page_num"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("exists", F.coalesce("exists", F.lit(False)))


def read_json_layer(spark: SparkSession, root: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Rows of a layer's JSON files with path; files that cannot be read as the schema are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", "_corrupt").json(root)
    return rows.where("_corrupt is null").drop("_corrupt").withColumn("path", F.col("_metadata.file_path"))


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines log; malformed lines are skipped."""
    rows = spark.read.schema(f"{USAGE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def append_usage_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def prefer(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of several layers of one shape, each key's row of the first that has it, with its place as `priority`."""
    out = None
    for i, df in enumerate(layers):
        df = df.withColumn("priority", F.lit(i))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy(*keys).orderBy("priority")
    return out.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def sniff_format(content: Column) -> Column:
    """hwp, hwpx, pdf or other, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "hwp").when(head.startswith("504B0304"), "hwpx").when(head.startswith("25504446"), "pdf").otherwise("other")


def write_pages(pages: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Pages as Parquet by key; only the keys that are written are replaced."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

"""Readers and writers of a library: a folder of documents and one of interpretations, each entry a folder with its
manifest, its layers of page files and its records, all JSON or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pages as pg

DOCUMENT = "document_id string, title string, parts array<struct<part_id: string, label: string, page_count: int>>"
INTERPRETATION = "interpretation_id string, title string, source_document_id string, interpreter struct<type: string, name: string>"
LIBRARY = "name string, documents array<struct<document_id: string, title: string, path: string>>, interpretations array<struct<interpretation_id: string, title: string>>"
LAYOUT = "part_id string, page_number int, blocks array<struct<block_id: string, block_type: string, reading_order: int, bbox: array<double>, skip: boolean>>"
CORRECTIONS = "part_id string, corrections array<struct<line: int, char_index: int, type: string, original_ocr: string, corrected: string, block_id: string>>"
MARKS = "block_id string, marks array<struct<id: string, target: struct<start: int, end: int>, before: string, after: string>>"
TRANSLATIONS = "part_id string, page_number int, translations array<struct<id: string, source: struct<block_id: string, start: int, end: int>, translation: string, status: string>>"
CITATIONS = "part_id string, page_number int, marks array<struct<id: string, status: string, label: string>>"
ENTITY = "id string, type string, name string, status string, metadata map<string, string>"
#: Suffixes of source files that are pages.
PAGE_SUFFIXES = ["pdf", "jpg", "jpeg", "png", "tif", "tiff"]


def _file(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    """Whole-file JSON of a schema with path; broken files are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)
    return rows.where("_corrupt is null").select("*", F.col("_metadata.file_path").alias("path")).drop("_corrupt")


def _folder(path: Column, above: int) -> Column:
    """The name of the folder `above` levels over a file."""
    return F.element_at(F.split(path, "/"), -1 - above)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """folder and manifest of each document that has one; rows have the order of the folders' names in `folder`."""
    return _file(spark, f"{root}/documents/*/", DOCUMENT, "manifest.json").withColumn("folder", _folder(F.col("path"), 1)).drop("path")


def interpretations(spark: SparkSession, root: str) -> DataFrame:
    return _file(spark, f"{root}/interpretations/*/", INTERPRETATION, "manifest.json").withColumn("folder", _folder(F.col("path"), 1)).drop("path")


def library(spark: SparkSession, root: str) -> DataFrame:
    """The library's own manifest, with empty lists where it has none."""
    rows = _file(spark, root, LIBRARY, "library_manifest.json").drop("path")
    return rows.withColumns({c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), rows.schema[c].dataType.simpleString())) for c in ("documents", "interpretations")})


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, name, size, suffix, layer of the documents' page files: those of the source layer, and where none of them
    is a page, the text layer's."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/documents").select("path", F.col("length").alias("size"))
    layer = F.regexp_extract("path", r"/documents/[^/]+/(L1_source/|L4_text/pages/)[^/]+$", 1)
    rows = rows.withColumns({"folder": F.regexp_extract("path", "/documents/([^/]+)/", 1), "layer": F.regexp_replace(layer, "/.*$", ""), "name": _folder(F.col("path"), 0)})
    rows = rows.where("layer <> '' and not startswith(name, '.')").withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    rows = rows.where("layer = 'L1_source' or suffix = 'txt'")
    w = Window.partitionBy("folder")
    has_pages, has_texts = F.coalesce(F.max((F.col("layer") == "L1_source") & F.col("suffix").isin(PAGE_SUFFIXES)).over(w), F.lit(False)), F.max(F.col("layer") == "L4_text").over(w)
    rows = rows.withColumns({"pages_": has_pages, "texts_": has_texts})
    wanted = F.when(~F.col("pages_") & F.col("texts_"), "L4_text").otherwise("L1_source")
    return rows.where(F.col("layer") == wanted).select("folder", "name", "size", "suffix", "layer")


def _page_layer(spark: SparkSession, root: str, schema: str, glob: str, wanted: DataFrame, lists: dict[str, str]) -> DataFrame:
    """wanted (part_id, page_num) with the columns of a layer's page files; lists that are missing are empty."""
    rows = _file(spark, root, schema, glob).withColumn("k", pg.page_key(F.col("path")))
    drop = [c for c in ("part_id", "page_number") if c in rows.columns]
    rows = rows.drop(*drop).select("k.part_id", "k.page_num", *[c for c in rows.columns if c not in (*drop, "k", "path")])
    out = wanted.join(rows, ["part_id", "page_num"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), kind)) for c, kind in lists.items()})


def page_layouts(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    return _page_layer(spark, root, LAYOUT, "*_page_*.json", wanted, {"blocks": LAYOUT.split("blocks ")[1]})


def page_corrections(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    return _page_layer(spark, root, CORRECTIONS, "*_page_*.json", wanted, {"corrections": CORRECTIONS.split("corrections ")[1]})


def translations(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    return _page_layer(spark, root, TRANSLATIONS, "*_page_*_translation.json", wanted, {"translations": TRANSLATIONS.split("translations ")[1]})


def citation_marks(spark: SparkSession, root: str) -> DataFrame:
    """path, pos, page_number (0 if missing) and fields of the citation marks of all pages."""
    rows = _file(spark, root, CITATIONS, "*_page_*_citation_marks.json")
    return rows.select("path", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.posexplode("marks").alias("pos", "m")).select("path", "pos", "page_number", "m.*")


def block_marks(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted (part_id, page_num, block_id) with marks: of the block's own file (`<part>_page_<n>_blk_<block>.json`), else
    of the page's file if that is for this block, else none."""
    rows = _file(spark, root, MARKS, "*_page_*.json").withColumns({"k": pg.page_key(F.col("path")), "own": F.regexp_extract(_folder(F.col("path"), 0), r"_page_\d+_blk_(.+)\.json$", 1)})
    rows = rows.select("k.part_id", "k.page_num", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("block_id")).alias("block_id"), "marks", (F.col("own") == "").cast("int").alias("rank"))
    first = rows.groupBy("part_id", "page_num", "block_id").agg(F.min_by("marks", "rank").alias("marks"))
    out = wanted.join(first, ["part_id", "page_num", "block_id"], "left")
    return out.withColumn("marks", F.coalesce("marks", F.from_json(F.lit("[]"), MARKS.split("marks ")[1])))


def entities(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Entities of a kind: a JSON file each; broken files are left out."""
    return _file(spark, f"{root}/core_entities/{kind}", ENTITY, "*.json").drop("path")


def layer_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all JSON files under a folder, with _source_path counted from it."""
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return pg.read_json_layer(spark, root, schema).withColumn("_source_path", F.regexp_extract("path", rf"/{base}/(.*)$", 1)).drop("path")


def write_json_pages(rows: DataFrame, path: str, part: str = "part_id", page: str = "page_num") -> None:
    """Page records as JSON lines in a folder per part and page; only the pages that are written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part, page).json(path)

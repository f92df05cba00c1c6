"""Whole works as one JSON value: original and interpretation with all layers, checked, and back to files.

Works are tables of files: work, area (original or interpretation), path, content (text, or JSON), size. JSON is kept as
it is (as variants), whatever fields it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form's version, and layers of the interpretation with their folders and file names.
VERSION = "1.0"
LAYERS = {"L5_punctuation": ("L5_reading", "_punctuation.json"), "L5_hyeonto": ("L5_reading", "_hyeonto.json"), "L6_translation": ("L6_translation", "_translation.json"), "L7_annotation": ("L7_annotation", "_annotation.json")}
TEXTS, CORRECTIONS = "L4_text/pages/", "L4_text/corrections/"


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", "")


def _joined(rows: DataFrame, item: Column, order: Column, name: str) -> DataFrame:
    """work and name: a JSON array of the rows' items."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item")))), lambda x: x["item"])
    return rows.groupBy("work").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias(name))


def _objects(files: DataFrame, test: Column) -> DataFrame:
    """Files with JSON objects that are not empty; broken files are left out."""
    kind = F.schema_of_variant(F.try_parse_json("content"))
    return files.where(test).where(F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False)))


def build(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """work, snapshot (JSON) of each work. Images are named, not included; corrections go with their page's text; items of
    the interpretation carry the path they came from. library: key, content of what all works share
    (variant_characters, annotation_types)."""
    original, other = F.col("area") == "original", F.col("area") == "interpretation"
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    one = lambda test, column: _objects(files, test).groupBy("work").agg(F.min("content").alias(column))
    images = files.where(original & F.col("path").rlike(r"^L1_source/[^/.][^/]*$"))
    images = _joined(images, F.to_json(F.struct("path", name.alias("name"), F.col("size").alias("size_bytes"))), F.col("path"), "images")
    layouts = _joined(_objects(files, original & F.col("path").rlike(r"^L3_layout/[^/]*\.json$")), F.col("content"), F.col("path"), "layouts")
    fixes = _objects(files, original & F.col("path").startswith(CORRECTIONS)).select("work", F.regexp_extract("path", r"([^/]*)_corrections\.json$", 1).alias("stem"), F.col("content").alias("fixes"))
    texts = files.where(original & F.col("path").rlike(rf"^{TEXTS}[^/]*\.txt$")).select("work", "path", name.alias("file"), stem.alias("stem"), "content").join(fixes, ["work", "stem"], "left")
    page = F.concat(F.lit('{"file_name":'), _quoted(F.col("file")), F.lit(',"text":'), _quoted(F.coalesce("content", F.lit(""))), F.coalesce(F.concat(F.lit(',"corrections":'), "fixes"), F.lit("")), F.lit("}"))
    parts = [one(original & (F.col("path") == "manifest.json"), "doc"), one(original & (F.col("path") == "bibliography.json"), "book"), one(other & (F.col("path") == "manifest.json"), "reading"), one(other & (F.col("path") == "dependency.json"), "base"), images, layouts, _joined(texts, page, F.col("path"), "texts")]
    for layer, (folder, end) in LAYERS.items():
        rows = _objects(files, other & F.col("path").startswith(f"{folder}/") & F.col("path").endswith(end))
        parts.append(_joined(rows, F.concat(F.lit('{"_source_path":'), _quoted(F.col("path")), F.lit(","), F.regexp_replace("content", r"^\s*\{", "")), F.col("path"), layer))
    entities = _objects(files, other & F.col("path").rlike(r"^core_entities/[^/]+/[^/]+\.json$")).withColumn("kind", F.regexp_extract("path", "^core_entities/([^/]+)/", 1))
    kinds = entities.groupBy("work", "kind").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), ","), F.lit("]")).alias("items"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kind", "items"))), lambda x: F.concat(_quoted(x["kind"]), F.lit(":"), x["items"]))
    parts.append(kinds.groupBy("work").agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("entities")))
    rows = reduce(lambda a, b: a.join(b, "work", "left"), parts, files.select("work").distinct())

    get = lambda column, path, kind="variant": F.try_variant_get(F.try_parse_json(column), path, kind)
    work = [("document_id", "doc", "$.document_id"), ("title", "doc", "$.title"), ("title_ko", "doc", "$.title_ko"), ("parts", "doc", "$.parts"), ("created_at", "doc", "$.created_at"), ("notes", "doc", "$.notes"), ("interpretation_id", "reading", "$.interpretation_id"), ("interpretation_title", "reading", "$.title"), ("interpreter", "reading", "$.interpreter"), ("bibliography", "book", "$")]
    fields = F.array_join(F.array(*(F.concat(F.lit(f'"{k}":'), F.to_json(get(c, p))) for k, c, p in work)), ",")
    or_empty = lambda c, empty="[]": F.coalesce(F.col(c), F.lit(empty))
    texts_of = [F.lit('"L4_text":{"type":"inline","pages":'), or_empty("texts"), F.lit("}")]
    images_of = F.when(F.col("images").isNotNull(), F.concat(F.lit('"L1_source":{"type":"reference","files":'), "images", F.lit("},"))).otherwise("")
    layouts_of = F.when(F.col("layouts").isNotNull(), F.concat(F.lit('"L3_layout":{"type":"inline","pages":'), "layouts", F.lit("},"))).otherwise("")
    layers_of = [x for i, layer in enumerate(LAYERS) for x in (F.lit(("," if i else "") + f'"{layer}":'), or_empty(layer))]
    base_of = F.coalesce(F.concat(F.lit(',"base_original_hash":'), F.coalesce(F.to_json(get("base", "$.source.base_commit")), F.lit("null")), F.lit(',"dependency":'), "base"), F.lit(""))
    shared = F.lit("")
    if library is not None:
        both = {r["key"]: r["content"] for r in library.select("key", "content").collect()}  # two short files of the library
        shared = F.lit("".join(f',"{k}":{v}' for k, v in sorted(both.items())))
    return rows.select("work", F.concat(
        F.lit(f'{{"schema_version":"{VERSION}","work":{{'), fields, F.lit('},"original":{"layers":{'), images_of, layouts_of, *texts_of, F.lit('}},"interpretation":{"layers":{'), *layers_of, F.lit("}"), base_of, F.lit(',"core_entities":'), or_empty("entities", "{}"), F.lit("}"), shared, F.lit("}"),
    ).alias("snapshot"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def validate(snapshots: DataFrame) -> DataFrame:
    """work, level (error or warning), what: what is wrong with snapshots (work, snapshot). Errors forbid an import: no
    JSON, no or another version (nothing else is looked at then), no title, no original. Warnings: images that are only
    named, no texts, no interpretation, blocks that the layout doesn't have (if it has any), and annotation types that
    are not defined (if any are)."""
    rows = snapshots.select("work", F.try_parse_json("snapshot").alias("v"))
    text = lambda path, v="v": F.try_variant_get(F.col(v), path, "string")
    there = lambda path: F.try_variant_get(F.col("v"), path, "variant").isNotNull()
    version = text("$.schema_version")
    bad = rows.select("work", F.lit("error").alias("level"), F.when(F.col("v").isNull(), "not JSON").when(version.isNull(), "no schema_version").when(version != VERSION, F.concat(F.lit("schema_version "), version)).alias("what")).where("what is not null")
    good = rows.where(version == VERSION)
    images = F.size(_items(F.col("v"), "$.original.layers.L1_source.files"))
    named = (text("$.original.layers.L1_source.type") == "reference") & (images > 0)
    found = [
        ("error", F.when(F.coalesce(text("$.work.title"), F.lit("")) == "", "no title")), ("error", F.when(~there("$.original"), "no original")), ("warning", F.when(named, F.concat(images.cast("string"), F.lit(" images are only named")))),
        ("warning", F.when(there("$.original") & (F.size(_items(F.col("v"), "$.original.layers.L4_text.pages")) == 0), "no texts")), ("warning", F.when(~there("$.interpretation"), "no interpretation")),
    ]
    told = good.select("work", F.inline(F.array(*(F.struct(F.lit(level).alias("level"), what.alias("what")) for level, what in found)))).where("what is not null")
    each = lambda df, path, v="v": df.withColumn("x", F.explode(_items(F.col(v), path)))
    blocks = each(each(good, "$.original.layers.L3_layout.pages"), "$.blocks", "x").select("work", text("$.block_id", "x").alias("id")).where("id <> ''").distinct()
    named_in = [each(good, f"$.interpretation.layers.{k}").select("work", F.lit(k).alias("layer"), text("$.block_id", "x").alias("id")) for k in ("L5_punctuation", "L5_hyeonto")]
    named_in.append(each(each(good, "$.interpretation.layers.L6_translation"), "$.translations", "x").select("work", F.lit("L6_translation").alias("layer"), text("$.source.block_id", "x").alias("id")))
    noted = each(each(good, "$.interpretation.layers.L7_annotation"), "$.blocks", "x")
    named_in.append(noted.select("work", F.lit("L7_annotation").alias("layer"), text("$.block_id", "x").alias("id")))
    refs = reduce(DataFrame.unionByName, named_in).where("id <> ''")
    lost = refs.join(blocks.select("work").distinct(), "work", "left_semi").join(blocks, ["work", "id"], "left_anti").select("work", F.lit("warning").alias("level"), F.concat("layer", F.lit(": no block "), "id").alias("what"))
    types = each(good, "$.annotation_types").select("work", text("$.id", "x").alias("id")).where("id <> ''").distinct()
    used = each(noted, "$.annotations", "x").select("work", text("$.type", "x").alias("id")).where("id <> ''")
    unknown = used.join(types.select("work").distinct(), "work", "left_semi").join(types, ["work", "id"], "left_anti").select("work", F.lit("warning").alias("level"), F.concat(F.lit("L7_annotation: no type "), "id").alias("what"))
    return bad.unionByName(told).unionByName(lost).unionByName(unknown)


def restore(snapshots: DataFrame, suffix: str) -> DataFrame:
    """work (the old name and the suffix), area, path, content: the files of snapshots (work, snapshot) without errors.
    Manifests are not among them: a restored work gets its own. Items of the interpretation without their path are left
    out, and a dependency names the new work."""
    wrong = validate(snapshots).where("level = 'error'").select("work").distinct()
    rows = snapshots.join(wrong, "work", "left_anti").select(F.concat("work", F.lit(suffix)).alias("work"), F.try_parse_json("snapshot").alias("v"))
    each = lambda path: rows.select("work", F.explode(_items(F.col("v"), path)).alias("x"))
    text = lambda path, v="x": F.try_variant_get(F.col(v), path, "string")
    of = lambda df, area, path, content: df.select("work", F.lit(area).alias("area"), path.alias("path"), content.alias("content")).where("path is not null and content is not null")
    number = F.lpad(F.coalesce(text("$.page_number"), F.lit("0")), 3, "0")
    number = F.when(F.char_length(F.coalesce(text("$.page_number"), F.lit("0"))) > 3, text("$.page_number")).otherwise(number)
    pages, file = each("$.original.layers.L4_text.pages"), F.coalesce(text("$.file_name"), F.lit("page.txt"))
    out = [
        of(rows, "original", F.lit("bibliography.json"), F.to_json(F.try_variant_get("v", "$.work.bibliography", "variant"))),
        of(rows, "original", F.lit("L1_source/_imported_file_list.json"), F.to_json(F.try_variant_get("v", "$.original.layers.L1_source.files", "variant"))),
        of(each("$.original.layers.L3_layout.pages"), "original", F.concat(F.lit("L3_layout/"), F.coalesce(text("$.part_id"), F.lit("vol1")), F.lit("_page_"), number, F.lit(".json")), F.to_json("x")),
        of(pages, "original", F.concat(F.lit(TEXTS), file), F.coalesce(text("$.text"), F.lit(""))),
        of(pages, "original", F.concat(F.lit(CORRECTIONS), F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_corrections.json")), F.to_json(F.try_variant_get("x", "$.corrections", "variant"))),
    ]
    for layer in LAYERS:
        item = F.map_filter(F.col("x").cast("map<string, variant>"), lambda k, _: k != "_source_path")
        out.append(of(each(f"$.interpretation.layers.{layer}"), "interpretation", text("$._source_path"), F.to_json(item)))
    kinds = rows.select("work", F.explode(F.try_variant_get("v", "$.interpretation.core_entities", "map<string, array<variant>>")).alias("kind", "items")).select("work", "kind", F.explode("items").alias("x"))
    out.append(of(kinds, "interpretation", F.concat(F.lit("core_entities/"), "kind", F.lit("/"), F.coalesce(text("$.id"), F.lit("unknown")), F.lit(".json")), F.to_json("x")))
    source = F.try_variant_get("v", "$.interpretation.dependency.source", "map<string, variant>")
    renamed = F.map_concat(F.map_filter(source, lambda k, _: k != "document_id"), F.create_map(F.lit("document_id"), F.parse_json(_quoted(F.col("work")))))
    whole = F.try_variant_get("v", "$.interpretation.dependency", "map<string, variant>")
    kept = F.when(source.isNotNull(), F.map_concat(F.map_filter(whole, lambda k, _: k != "source"), F.create_map(F.lit("source"), F.parse_json(F.to_json(renamed))))).otherwise(whole)
    out.append(of(rows, "interpretation", F.lit("dependency.json"), F.to_json(kept)))
    return reduce(DataFrame.unionByName, out)

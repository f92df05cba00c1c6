"""Defaults, registration, dependencies and routing of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a record has where it says nothing, by kind.
DEFAULTS = {
    "translation": {"target_language": "'ko'", "status": "'draft'", "translator": "named_struct('type', 'human', 'model', cast(null as string), 'draft_id', cast(null as string))"},
    "annotation": {"status": "'draft'", "current_stage": "'none'", "annotator": "named_struct('type', 'human', 'model', cast(null as string), 'draft_id', cast(null as string))"},
    "citation": {"status": "'active'"},
}
#: Recognisers by the predicted size class, and the length of a result from which the next one takes over.
RECOGNISERS = [(30, 3, 25), (50, 2, 45), (100, None, None)]
#: Image extensions in order of preference.
IMAGES = ["png", "jpg", "jpeg", "tiff", "tif"]


def with_defaults(rows: DataFrame, kind: str) -> DataFrame:
    """rows with every default of their kind filled in where the column is null or missing."""
    for name, value in DEFAULTS[kind].items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.expr(value)) if name in rows.columns else F.expr(value))
    return rows


def migrate_annotations(rows: DataFrame) -> DataFrame:
    """Annotation rows of version 1 (schema_version other than 2.0) with version 2's fields; version 2 stays as it is."""
    old = ~F.coalesce(F.col("schema_version") == "2.0", F.lit(False))
    return rows.withColumns({
        "current_stage": F.when(old, F.coalesce("current_stage", F.lit("none"))).otherwise(F.col("current_stage")),
        "generation_history": F.when(old, F.coalesce("generation_history", F.expr("cast(array() as array<string>)"))).otherwise(F.col("generation_history")),
        "schema_version": F.lit("2.0"),
    })


def register(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows and the new ones whose key is not known yet; of new rows of one key the first (by pos) counts."""
    first = new.withColumn("nth_", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("nth_ = 1").drop("nth_", "pos")
    return known.unionByName(first.join(known.select(key), key, "left_anti"))


def dependency_status(files: DataFrame, base: str) -> DataFrame:
    """base, status, n_changed of tracked files (status unchanged, changed, acknowledged or updated)."""
    every = lambda *s: F.bool_and(F.col("status").isin(*s))
    some = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(every("unchanged", "updated"), "current").when(every("unchanged", "updated", "acknowledged"), "acknowledged")
    return files.groupBy(base).agg(status.when(some("acknowledged") & some("changed"), "partially_acknowledged").otherwise("outdated").alias("status"), F.count_if(F.col("status") == "changed").alias("n_changed"))


def acknowledge(files: DataFrame, chosen: DataFrame | None, keys: list[str]) -> DataFrame:
    """files after acknowledging the changed ones that are chosen (all of them if none are given)."""
    if chosen is None:
        return files.withColumn("status", F.when(F.col("status") == "changed", "acknowledged").otherwise(F.col("status")))
    picked = chosen.select(*keys).distinct().withColumn("picked_", F.lit(True))
    new = F.when((F.col("status") == "changed") & F.col("picked_"), "acknowledged").otherwise(F.col("status"))
    return files.join(picked, keys, "left").withColumn("status", new).drop("picked_")


def rebase(current: DataFrame, keys: list[str]) -> DataFrame:
    """Tracked files after moving to a new base: what is there now, unchanged."""
    return current.select(*keys, F.col("hash").alias("hash_at_base"), F.lit("unchanged").alias("status"))


def tracked_files(paths: DataFrame, path: str, content: str, layer: str = "L4_text") -> DataFrame:
    """paths (any columns) of .txt and .json files under the layer's folder, with hash and status unchanged."""
    inside = F.col(path).rlike(rf"(^|/){layer}/.*\.(txt|json)$")
    return paths.where(inside).withColumns({"hash": F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)), "status": F.lit("unchanged")}).drop(content)


def with_trailer(message: Column, head: Column) -> Column:
    """A commit message that names the original's commit it is based on; without one, the message as it is."""
    return F.when(head.isNull(), message).otherwise(F.concat(F.regexp_replace(message, r"\s+$", ""), F.lit("\n\nBased-On-Original: "), head))


def auto_pages(documents: DataFrame, key: str, sections: str, start: Column, part: Column) -> DataFrame:
    """key, section_index, page_num, part_id: section i goes to page start + i."""
    rows = documents.select(key, start.alias("s"), part.alias("part_id"), F.explode(F.expr(f"if({sections} > 0, sequence(0, {sections} - 1), array())")).alias("section_index"))
    return rows.select(key, "section_index", (F.col("s") + F.col("section_index")).alias("page_num"), "part_id")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def recogniser(size_class: Column, length_at: dict[int, Column]) -> Column:
    """The recogniser whose result stands: the one of the predicted size class, or a larger one where the results so
    far (their lengths by recogniser) are too long for theirs."""
    stands, chosen = F.lit(RECOGNISERS[-1][0]), F.lit(RECOGNISERS[-1][0])
    for size, kind, limit in reversed(RECOGNISERS[:-1]):
        stands = F.when(length_at[size] >= limit, stands).otherwise(size)
        chosen = F.when(size_class == kind, stands).otherwise(chosen)
    return chosen


def layer_flags(present: dict[str, Column]) -> Column:
    """array of the names of layers that have anything, in order."""
    return F.filter(F.array(*(F.when(c > 0, F.lit(name)) for name, c in present.items())), lambda x: x.isNotNull())


def trash_entry(name: Column) -> Column:
    """struct<original_id, trashed_at> of a folder `yyyyMMddTHHmmss_id`; null without an underscore, trashed_at null if
    the time cannot be read."""
    stamp = F.regexp_extract(name, "^([^_]*)_", 1)
    at = F.when(stamp.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")))
    return F.when(F.contains(name, F.lit("_")), F.struct(F.regexp_replace(name, "^[^_]*_", "").alias("original_id"), iso_time(at).alias("trashed_at")))


def page_image(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (doc, part_id, page_num) with name: the file of the page by `part_page_NNN.ext`, else `page_NNN.ext`, else
    any `*_pNNN.ext` or `*_pNNNN.ext` (the first by name; extensions in either case); null if there is none. files:
    doc, name. Joins are merged: Spark takes wanted pages, which come of an explode, for as few as what they came of."""
    stem = F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1)
    ext = F.array_position(F.array(*(F.lit(e) for e in IMAGES)), F.lower(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2)))
    known = files.select("doc", "name", stem.alias("stem"), ext.alias("ext"), F.col("name").rlike(r"\.[a-z]+$").alias("lower")).where("ext > 0")
    page, low = F.format_string("page_%03d", "page_num"), F.format_string("_p%03d", "page_num")
    named = [(0, F.concat("part_id", F.lit("_"), page)), (1, page)]
    asked = wanted.select("doc", "part_id", "page_num", F.inline(F.array(*(F.struct(F.lit(i).alias("rank"), n.alias("stem")) for i, n in named))))
    exact = asked.join(known.where("lower").hint("merge"), ["doc", "stem"]).select("doc", "part_id", "page_num", "rank", "ext", "name")
    tails = known.select("doc", "ext", "name", F.regexp_extract("stem", r"(_p\d{3,4})$", 1).alias("tail")).where("tail <> ''")
    by_tail = wanted.select("doc", "part_id", "page_num", F.explode(F.array_distinct(F.array(low, F.format_string("_p%04d", "page_num")))).alias("tail")).join(tails.hint("merge"), ["doc", "tail"])
    rank = F.when(F.char_length("tail") == 5, 2).otherwise(3)
    found = exact.unionByName(by_tail.select("doc", "part_id", "page_num", rank.alias("rank"), F.lit(0).cast("bigint").alias("ext"), "name"))
    best = found.groupBy("doc", "part_id", "page_num").agg(F.min(F.struct("rank", "ext", "name")).alias("best"))
    return wanted.join(best.hint("merge"), ["doc", "part_id", "page_num"], "left").select("doc", "part_id", "page_num", F.col("best.name").alias("name"))


def first_given(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return reduce(lambda out, c: F.coalesce(out, F.nullif(c, F.lit(""))), choices, F.lit(None).cast("string"))

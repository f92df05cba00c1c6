"""Filters, merges, validation and graphs of records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tasks import dealt


def where_equal(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns equal all wanted values; a wanted null equals a null."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()), F.lit(True)))


def refers_to(refs: Column, single: Column, document: object, page: object) -> Column:
    """Whether any of the references, or the single one, is to this document and page."""
    is_it = lambda r: r["document_id"].eqNullSafe(F.lit(document)) & r["page"].eqNullSafe(F.lit(page))
    return F.coalesce(F.exists(refs, is_it), F.lit(False)) | F.coalesce(is_it(single), F.lit(False))


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str], protect: Column | None = None) -> DataFrame:
    """Rows of both by key: new values replace old ones, except where `protect` (over o_ and n_ columns) holds; new
    rows without a key are left out. Adds origin: kept, replaced, protected or added."""
    o = old.select(F.col(key).alias("o_key"), *(F.col(v).alias(f"o_{v}") for v in values))
    n = new.where(F.col(key).isNotNull()).select(F.col(key).alias("n_key"), *(F.col(v).alias(f"n_{v}") for v in values))
    both = o.join(n, F.col("o_key") == F.col("n_key"), "full_outer")
    safe = F.coalesce(protect, F.lit(False)) if protect is not None else F.lit(False)
    take_old = F.col("n_key").isNull() | (F.col("o_key").isNotNull() & safe)
    origin = F.when(F.col("o_key").isNull(), "added").when(F.col("n_key").isNull(), "kept").when(safe, "protected").otherwise("replaced")
    return both.select(F.coalesce("o_key", "n_key").alias(key), *(F.when(take_old, F.col(f"o_{v}")).otherwise(F.col(f"n_{v}")).alias(v) for v in values), origin.alias("origin"))


def dangling(rows: DataFrame, key: str, known: DataFrame, layer: str) -> DataFrame:
    """layer, key, n of rows that refer to nothing known; none at all if nothing is known."""
    some = known.limit(1).select(F.lit(1).alias("some"))
    lost = rows.join(known.select(F.col(key)).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return lost.withColumn("one", F.lit(1)).join(F.broadcast(some), F.col("one") == F.col("some"), "left_semi").select(F.lit(layer).alias("layer"), key, "n")


def drifted(annotations: DataFrame, translations: DataFrame, block: str) -> DataFrame:
    """Annotations whose snapshot of the translation is not what their block's translations now say, joined by one
    space in order of seq. annotations: block, id, snapshot; translations: block, seq, text."""
    now = translations.groupBy(block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("now"))
    rows = annotations.join(now, block, "left")
    return rows.where(F.col("snapshot").isNotNull() & (F.col("snapshot") != F.coalesce("now", F.lit("")))).select(block, "id")


def one_hop(blocks: DataFrame, tags: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id reached from blocks (id): the blocks, their tags (id, block_id), relations (id, subject_id, object_id,
    evidence) that touch a block or tag or have a block as evidence, and those relations' other ends. One hop from the
    first set, whatever the order of rows."""
    b = blocks.select(F.col("id").alias("block_id")).distinct()
    t = tags.join(b, "block_id", "left_semi")
    ends = b.select(F.col("block_id").alias("end")).unionByName(t.select(F.col("id").alias("end"))).distinct()
    by_subject = relations.join(ends, F.col("subject_id") == F.col("end"), "left_semi")
    by_object = relations.join(ends, F.col("object_id") == F.col("end"), "left_semi")
    by_evidence = relations.select("*", F.explode("evidence").alias("block_id")).join(b, "block_id", "left_semi").drop("block_id")
    found = by_subject.unionByName(by_object).unionByName(by_evidence).dropDuplicates(["id", "subject_id", "object_id"])
    others = found.select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id is not null").distinct()
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "id").distinct()
    return kind(b.withColumnRenamed("block_id", "id"), "block").unionByName(kind(t, "tag")).unionByName(kind(found, "relation")).unionByName(kind(others, "entity"))


def check_transitions(changes: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """changes (id, old, new) with ok: whether the state may change so; staying is always allowed."""
    table = F.create_map(*(F.lit(x) for a, b in allowed for x in (f"{a}>{b}", True)))
    return changes.withColumn("ok", (F.col("old") == F.col("new")) | F.coalesce(table[F.concat_ws(">", "old", "new")], F.lit(False)))


def drop_null_values(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def visible_types(presets: DataFrame, custom: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Presets and custom types without hidden ones; a custom type that repeats a preset's key is left out."""
    own = custom.join(presets.select(key), key, "left_anti")
    return presets.withColumn("origin", F.lit("preset")).unionByName(own.withColumn("origin", F.lit("custom"))).join(hidden.select(key), key, "left_anti")


def variant_pairs(groups: DataFrame, chars: str, existing: DataFrame) -> DataFrame:
    """a, b (a < b) of all pairs of different characters in each group's array, without pairs that exist already."""
    c = F.array_distinct(F.col(chars))
    pairs = F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    n = F.size(c).cast("bigint")
    total = groups.agg(F.sum(F.when(n > 1, n * (n - 1) / 2))).first()[0] or 0
    known = existing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("old"))
    both = groups.select(F.inline(pairs)).withColumn("old", F.lit(False)).unionByName(known)
    return dealt(both, int(total), "a", "b").groupBy("a", "b").agg(F.bool_or("old").alias("old")).where("not old").select("a", "b")


def lookup_in_order(wanted: DataFrame, rows: DataFrame, key: str, list_col: str, group: str) -> DataFrame:
    """group, pos, key and rows' columns for each id of a list, in its order; found tells misses."""
    asked = wanted.select(group, F.posexplode(list_col).alias("pos", key))
    return asked.join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_or_identity(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """page, target: the first target (by pos) a page maps to, or itself."""
    first = mapping.groupBy("page").agg(F.min_by("target", "pos").alias("target"))
    return pages.join(first, "page", "left").select("page", F.coalesce("target", "page").alias("target"))


def cascade(keys: DataFrame, key: str, sources: list[DataFrame], value: str = "text") -> DataFrame:
    """key, value, source: the first source that has a value that is not empty for the key."""
    out = keys.select(key)
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{i}")), key, "left")
    full = [F.nullif(F.col(f"v{i}"), F.lit("")) for i in range(len(sources))]
    which = F.lit(None).cast("int")
    for i in reversed(range(len(sources))):
        which = F.when(full[i].isNotNull(), F.lit(i)).otherwise(which)
    return out.select(key, F.coalesce(*full, F.lit("")).alias(value), which.alias("source"))


def accept_drafts(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """rows (key, status) after accepting the chosen drafts; only drafts change."""
    picked = chosen.select(key).distinct().withColumn("picked_", F.lit(True))
    return rows.join(picked, key, "left").withColumn("status", F.when(F.col("picked_") & (F.col("status") == "draft"), "accepted").otherwise(F.col("status"))).drop("picked_")


def delete_at(rows: DataFrame, items: str, index: Column, guard: Callable[[Column], Column]) -> DataFrame:
    """rows without the item at an index (0-based) of their array, where the guard holds for it."""
    return rows.withColumn(items, F.filter(items, lambda x, i: ~((i == index) & guard(x))))


def collapse_empty(value: Column, leaves: list[str]) -> Column:
    """A struct, or null if all of its leaves are null."""
    return F.when(F.coalesce(*(value[x].cast("string") for x in leaves)).isNull(), F.lit(None)).otherwise(value)


def collapse_nested(value: Column | str, kind: T.DataType) -> Column:
    """A value of a type with every struct in it null whose fields are all null, from the innermost on."""
    value = F.col(value) if isinstance(value, str) else value
    if not isinstance(kind, T.StructType) or not kind.fields:
        return value
    fields = [collapse_nested(value[f.name], f.dataType) for f in kind.fields]
    some = reduce(lambda a, b: a | b, (f.isNotNull() for f in fields))
    return F.when(some, F.struct(*(f.alias(k.name) for f, k in zip(fields, kind.fields, strict=True))))

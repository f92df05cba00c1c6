"""Commit logs, dependencies and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailer(message: Column, name: str) -> Column:
    """The value of the last line `name: value` of a message; null if there is none."""
    return F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(message, F.lit(rf"(?m)^\s*{name}:[^\S\n]*(\S[^\n]*)$"), 1), F.lit(-1))), F.lit(""))


#: Words of a message's first line that name a part of a layer.
SUB_LAYERS = ("punctuation", "hyeonto", "reading", "translation", "annotation")


def layers_of(message: Column, words: tuple[str, ...] = SUB_LAYERS) -> Column:
    """Layers named in a message's first line: L and a digit, then each of them with each of the words found there;
    ['unknown'] if there is none."""
    subject = F.split(F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+", ""), "\n")[0]
    base = F.array_distinct(F.regexp_extract_all(subject, F.lit(r"(?<![\p{L}\p{N}_])(L\d)(?![\p{L}\p{N}_])"), 1))
    found = F.filter(F.array(*(F.when(F.contains(F.lower(subject), F.lit(w)), F.lit(w)) for w in words)), lambda x: x.isNotNull())
    parts = F.flatten(F.transform(found, lambda w: F.transform(base, lambda b: F.concat(b, F.lit("_"), w))))
    return F.when(F.size(base) == 0, F.array(F.lit("unknown"))).otherwise(F.concat(base, parts))


def as_of_link(later: DataFrame, earlier: DataFrame, group: str, ts: str, id_: str) -> DataFrame:
    """later with linked: the id of the last earlier row of the group at or before its time, else of the first of all.

    One sort of the union by group and time; no range join. Ties of time take the larger id.
    """
    both = later.select(group, ts, F.col(id_).alias("id"), F.lit(1).alias("side")).unionByName(earlier.select(group, ts, F.col(id_).alias("id"), F.lit(0).alias("side")))
    by_time = Window.partitionBy(group).orderBy(ts, "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    source = F.when(F.col("side") == 0, F.col("id"))
    seen = both.withColumn("before", F.last(source, ignorenulls=True).over(by_time)).where("side = 1")
    oldest = earlier.groupBy(group).agg(F.min_by(id_, F.struct(ts, id_)).alias("oldest"))
    return seen.join(oldest, group, "left").select(group, F.col("id").alias(id_), ts, F.coalesce("before", "oldest").alias("linked"), F.col("before").isNotNull().alias("preceded"))


def ladder(commits: DataFrame, ts: str, id_: str, lane: str, step: int = 48, offset: int = 50) -> DataFrame:
    """Rows newest first within each lane, with y = position * step + offset.

    A lane may hold a large part of all rows, so rows are numbered within an hour, and the hours' counts add up to what
    comes before: no window holds more than an hour's rows or a lane's hours.
    """
    rows = commits.select(lane, id_, ts, F.date_trunc("hour", ts).alias("hour"))
    newer = Window.partitionBy(lane).orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(lane, "hour").agg(F.count(F.lit(1)).alias("n")).select(F.col(lane).alias("lane_"), F.col("hour").alias("hour_"), F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(lane, "hour").orderBy(F.desc(ts), F.desc(id_)))
    rows = rows.withColumn("nth", inside).join(before, F.col(lane).eqNullSafe(F.col("lane_")) & F.col("hour").eqNullSafe(F.col("hour_")))
    return rows.select(lane, id_, ((F.col("before") + F.col("nth") - 1) * step + offset).cast("long").alias("y"))


def page_of(commits: DataFrame, group: str, ts: str, id_: str, offset: int, limit: int) -> DataFrame:
    """The rows of one page per group, newest first, with the group's total and whether more follow."""
    w = Window.partitionBy(group)
    rows = commits.withColumn("rn", F.row_number().over(w.orderBy(F.desc(ts), F.desc(id_)))).withColumn("total", F.count(F.lit(1)).over(w))
    return rows.where((F.col("rn") > offset) & (F.col("rn") <= offset + limit)).select(group, id_, "rn", "total", (F.col("total") > offset + limit).alias("has_more"))


def milestones(commits: DataFrame, group: str, ts: str, id_: str, is_push: Column) -> DataFrame:
    """group, segment, n, last_id: commits between consecutive push points; each segment ends with its push."""
    w = Window.partitionBy(group).orderBy(ts, id_).rowsBetween(Window.unboundedPreceding, -1)
    rows = commits.withColumn("segment", F.coalesce(F.sum(F.when(is_push, 1).otherwise(0)).over(w), F.lit(0)))
    return rows.groupBy(group, "segment").agg(F.count(F.lit(1)).alias("n"), F.max_by(id_, F.struct(ts, id_)).alias("last_id"))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256))


def check_dependencies(tracked: DataFrame, current: DataFrame, path: str) -> DataFrame:
    """Per row of tracked (path, hash_at_base, status): its new status. Acknowledged and updated files keep theirs;
    others are `changed` if their content differs or is gone, and stay so once changed."""
    rows = tracked.join(current, path, "left")
    differs = F.col("hash_now").isNull() | (F.col("hash_now") != F.col("hash_at_base"))
    settled = F.col("status").isin("acknowledged", "updated")
    return rows.select(path, F.when(settled, F.col("status")).when(differs | (F.col("status") == "changed"), "changed").otherwise("unchanged").alias("status"))


def as_of_version(versions: DataFrame, paths: DataFrame, at: int, key: str) -> DataFrame:
    """key, path, content as of version `at`: of each key's candidate paths (key, path, priority) the first that has a
    version then. versions: path, seq, content."""
    then = versions.where(F.col("seq") <= at).groupBy("path").agg(F.max_by("content", "seq").alias("content"))
    return paths.join(then, "path").groupBy(key).agg(F.min_by(F.struct("path", "content"), F.struct("priority", "path")).alias("b")).select(key, "b.path", "b.content")


def paths_to_remove(now: DataFrame, then: DataFrame, path: str) -> DataFrame:
    """What going back to an earlier state removes: paths that are there now and were not then."""
    return now.select(path).distinct().join(then.select(path).distinct(), path, "left_anti")


def blob_guards(size: Column, content: Column, most: int, binary: str) -> tuple[Column, Column]:
    """Whether a file is too large to show, and whether it holds what text does not."""
    return size > most, F.contains(content, F.lit(binary))

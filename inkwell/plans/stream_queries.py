"""Queries of the streaming operators, run to the end of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import caches, usage
from .registry import QUERIES, SQL


def stream_usage_rollup(spark, sf_dir):
    out = usage.run_to_end(usage.daily_usage(usage.event_stream(spark, f"{sf_dir}/events.parquet")), "complete")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("cost", 4).alias("cost"))


def stream_priced_events(spark, sf_dir):
    events = usage.event_stream(spark, f"{sf_dir}/events.parquet")
    prices = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg((F.max("event_id") % 7).cast("double").alias("price"))
    return usage.run_to_end(usage.priced(events, prices).select("event_id", "event_type", F.round("cost", 4).alias("cost")), "append")


QUERIES |= {"stream_usage_rollup": stream_usage_rollup, "stream_priced_events": stream_priced_events}
SQL |= {
    "stream_usage_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY ALL",
    "stream_priced_events": "WITH p AS (SELECT event_type, max(event_id) % 7 AS price FROM events GROUP BY 1) SELECT event_id, event_type, round(value * price, 4) AS cost FROM events JOIN p USING (event_type)",
}


def cached_result_stream(spark, sf_dir):
    """Events as requests of their user for what their type and value name: which ones a cache of three results would have
    answered, and with whose result."""
    events = usage.event_stream(spark, f"{sf_dir}/events.parquet").where("user_id is not null")
    requests = events.selectExpr("user_id", "ts", "event_id as id", "concat(event_type, cast(value as bigint) % 2) as entry", "cast(event_id as string) as value")
    out = usage.run_to_end(caches.cached_results(requests, "user_id", 4 * 86_400, 3, "60 days"), "append")
    return out.select("user_id", F.col("id").alias("event_id"), "hit", F.col("answer").cast("long").alias("answer"))


def cached_check_stream(spark, sf_dir):
    """Events as checks of their type for each user: a success (value of at most 60) stands four times as long as a
    failure."""
    events = usage.event_stream(spark, f"{sf_dir}/events.parquet").where("user_id is not null")
    checks = events.selectExpr("user_id", "ts", "event_id as id", "event_type as entry", "value <= 60 as ok")
    out = usage.run_to_end(caches.cached_checks(checks, "user_id", "ok", 8 * 86_400, 2 * 86_400, "60 days"), "append")
    return out.select("user_id", F.col("id").alias("event_id"), "hit", F.col("answer").cast("boolean").alias("ok"))


QUERIES |= {"cached_result_stream": cached_result_stream, "cached_check_stream": cached_check_stream}
SQL |= {
    "cached_result_stream": """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type || value::BIGINT % 2 AS entry, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT * REPLACE (trunc(value) AS value) FROM events) WHERE user_id IS NOT NULL),
c(user_id, nth, event_id, hit, answer, held) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, false, NULL::BIGINT, []::STRUCT(k VARCHAR, t BIGINT, id BIGINT)[] FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, nth, event_id, found IS NOT NULL, coalesce(found.id, event_id), CASE WHEN found IS NOT NULL THEN held ELSE list_append(list_filter(held, lambda x: x.k <> entry), {'k': entry, 't': us, 'id': event_id})[-3:] END FROM (
    SELECT e.user_id, e.nth, e.event_id, e.entry, e.us, c.held, list_filter(c.held, lambda x: x.k = e.entry AND e.us - x.t <= 345600000000)[1] AS found FROM c JOIN e ON e.user_id = c.user_id AND e.nth = c.nth + 1))
SELECT user_id, event_id, hit, answer FROM c WHERE nth > 0
""",
    "cached_check_stream": """
WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, value <= 60 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events WHERE user_id IS NOT NULL),
c(user_id, event_type, nth, event_id, hit, ok, until) AS (
  SELECT user_id, event_type, nth, event_id, false, ok, us + CASE WHEN ok THEN 8 ELSE 2 END * 86400000000 FROM e WHERE nth = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.nth, e.event_id, e.us < c.until, CASE WHEN e.us < c.until THEN c.ok ELSE e.ok END, CASE WHEN e.us < c.until THEN c.until ELSE e.us + CASE WHEN e.ok THEN 8 ELSE 2 END * 86400000000 END
  FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.nth = c.nth + 1)
SELECT user_id, event_id, hit, ok FROM c
""",
}

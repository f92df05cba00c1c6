"""Usage logs, budgets and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_usage(log: DataFrame, month: str, budget: float) -> DataFrame:
    """dimension, name, calls, cost, remaining of one month (yyyy-MM): in all, by provider and by purpose in one pass.

    log: ts, type, provider, purpose, cost; rows of another type than `call` don't count, a null cost is 0.
    """
    rows = log.where((F.col("type") == "call") & (F.date_format("ts", "yyyy-MM") == month))
    sets = rows.groupingSets([[F.col("provider")], [F.col("purpose")], []], "provider", "purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 1, "provider").when(F.col("g") == 2, "purpose").otherwise("all")
    return sets.select(dimension.alias("dimension"), F.when(F.col("g") == 1, F.col("provider")).when(F.col("g") == 2, F.col("purpose")).alias("name"), "calls", F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), F.when(F.col("g") == 3, F.round(budget - F.col("cost"), 4)).alias("remaining"))


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, name, n for each of the columns, and in all, in one pass."""
    sets = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    bit = lambda i: full - (1 << (len(columns) - 1 - i))
    dimension, name = F.lit("all"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        dimension, name = F.when(F.col("g") == bit(i), c).otherwise(dimension), F.when(F.col("g") == bit(i), F.col(c).cast("string")).otherwise(name)
    return sets.select(dimension.alias("dimension"), name.alias("name"), "n")


def status_counts(rows: DataFrame, group: str, status: str, known: list[str]) -> DataFrame:
    """group, total and a count per known status; others count in the total only."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in known))


def cost_estimate(tokens_in: Column, tokens_out: Column, model: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """Cost of a call by prices per thousand tokens; tokens that are not known count as none."""
    price = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in prices.items() for x in (k, v[i])))[model], F.lit(default[i]))
    known = lambda n: F.coalesce(n, F.lit(0))
    return F.round(known(tokens_in) / 1000 * price(0) + known(tokens_out) / 1000 * price(1), 6)


def cache_key(purpose: Column, provider: Column, model: Column, prompt: Column) -> Column:
    """purpose|provider|model|length|hash of a request; a provider or model that is not asked for is `auto`."""
    asked = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("auto"))
    return F.concat_ws("|", purpose, asked(provider), asked(model), F.char_length(prompt).cast("string"), F.sha2(prompt, 256))


def prune_cache(entries: DataFrame, group: str, now: Column, ttl_s: int = 600, most: int = 256) -> DataFrame:
    """Entries of each group no older than the time to live, at most `most` of the latest. entries: group, id, ts."""
    w = Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("id"))
    fresh = entries.where(F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(now) - ttl_s * 1_000_000)
    return fresh.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


#: What messages of errors have that may pass when tried again.
RETRY_SIGNS = ("503", "unavailable", "timeout", "temporarily", "rate limit", "429", "connection reset", "json", "parse", "truncated", "empty response", "빈 응답")
#: Fixed values, by purpose: tokens of an answer (a base, a share of the text's length, least, most), and those of the
#: next try (a factor, least, most). None stands for all other purposes.
BUDGETS = {"punctuation": (768, 0.35, 768, 2048), "translation": (1400, 0.8, 1400, 4096), "annotation": (2800, 1.6, 4096, 16384), None: (4096, 0.0, 1024, 8192)}
RETRY_BUDGETS = {"annotation": (1.5, 4096, 24576), "translation": (1.35, 1400, 8192), None: (1.25, 768, 4096)}


def retryable(message: Column, signs: tuple[str, ...] = RETRY_SIGNS) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*(F.lit(s) for s in signs)), lambda s: F.contains(low, s))


def _within(value: Column, least: Column | int, most: Column | int) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(least)), F.lit(most)).cast("long")


def _by_purpose(purpose: Column, values: dict, of) -> Column:
    out = of(*values[None])
    for name, v in values.items():
        if name is not None:
            out = F.when(purpose == name, of(*v)).otherwise(out)
    return out


def token_budget(purpose: Column, length: Column) -> Column:
    """Tokens that an answer to a text of `length` characters may take."""
    n = F.greatest(length, F.lit(0)).cast("double")
    return _by_purpose(purpose, BUDGETS, lambda base, share, least, most: _within(base + F.floor(n * share), least, most))


def next_budget(purpose: Column, budget: Column) -> Column:
    """Tokens of the next try after one of `budget` tokens fell short."""
    return _by_purpose(purpose, RETRY_BUDGETS, lambda factor, least, most: _within(budget.cast("double") * factor, least, most))


def most_items(length: Column) -> Column:
    """Annotations that are asked for at most in a text of `length` characters."""
    return F.least(F.greatest(F.floor(F.greatest(length, F.lit(0)) / 8), F.lit(6)), F.lit(24)).cast("long")


def upper_median(x: Column) -> Column:
    """Of an even number of values the upper one of the middle two."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)


#: Ranks around the middle, as a share, between which the median is looked for; sketches are twice as exact.
NEAR = 0.0002


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: exact, without gathering a key's values. A sketch, which merges across tasks, gives two values with the
    middle surely between them; what is below them is counted, and only distinct values between them are put in order."""
    known = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    bounds = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR)), F.lit(int(2 / NEAR))).alias("p"))
    near = known.join(bounds.select(F.col(key).alias("k_"), F.col("p")[0].alias("low"), F.col("p")[1].alias("high")), F.col(key).eqNullSafe(F.col("k_"))).where("v <= high")
    counted = near.groupBy(key, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    lists = counted.groupBy(F.col(key).alias("k_")).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "c")))).alias("mid"))
    both = bounds.join(lists, F.col(key).eqNullSafe(F.col("k_")))
    # the value with so many rows before it, by a fold that counts up to it
    at = lambda rank: F.aggregate("mid", F.struct(F.col("below").alias("upto"), F.lit(None).cast("double").alias("v")), lambda acc, x: F.struct((acc["upto"] + x["c"]).alias("upto"), F.when(acc["v"].isNull() & (acc["upto"] + x["c"] > rank), x["v"]).otherwise(acc["v"]).alias("v")))["v"]
    return both.select(key, ((at(F.expr("(n - 1) div 2")) + at(F.expr("n div 2"))) / 2).alias("median"))


def timing_stats(rows: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, num, total, mean, median of the seconds that are known; a key may have any number of rows."""
    stats = rows.groupBy(key).agg(F.count(seconds).alias("num"), F.round(F.sum(seconds), 4).alias("total"), F.round(F.avg(seconds), 4).alias("mean"))
    middle = medians(rows, key, seconds).withColumnRenamed(key, "of_")
    return stats.join(middle, F.col(key).eqNullSafe(F.col("of_")), "left").select(key, "num", "total", "mean", F.round("median", 4).alias("median"))


def recent(rows: DataFrame, group: str, item: str, ts: str, id_: str, most: int) -> DataFrame:
    """group, item, rank: the most recently used distinct items of each group."""
    last = rows.groupBy(group, item).agg(F.max(F.struct(ts, id_)).alias("last"))
    w = Window.partitionBy(group).orderBy(F.desc("last"))
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(group, item, "rank")

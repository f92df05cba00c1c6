"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

The documents of a source, in id order, are cut into blocks of `block_chars` characters. With integer target parts the
weights are slots per period: a source of w slots in a period of Q gives its j-th block the release time floor(jQ/w)
and the deadline ceil((j+1)Q/w). Earliest deadline first, one block a slot, then keeps each source within less than
one block of its target at every slot. Windows repeat with the period, so the schedule of one period (Q slots, bounded
by the parameters) is folded once in SQL and serves all blocks: block j of a source is in period j div w.

A source that has run out leaves its slots empty; the order of all other blocks stands. Nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

#: Ids to a bucket and to a chunk of the running sums: no window holds more than a chunk's buckets or a bucket's ids.
BUCKET_IDS, CHUNK_IDS = 256, 1 << 20
#: Buckets that rows without an id are dealt over.
NULL_BUCKETS = 1 << 20
#: Sources that are mixed at most: they are parts of a target, such as data sets, not hosts.
MOST_SOURCES = 1000


def target_slots(sources: DataFrame, parts: dict[str, int], period: int) -> DataFrame:
    """source, w (slots in a period), q (the period): parts of the period by largest remainder; unnamed sources have 1.

    The period grows to four slots a part where the sources' parts would not fit it.
    """
    part = F.lit(1)
    for name, n in parts.items():
        part = F.when(F.col("source") == name, F.lit(n)).otherwise(part)
    rows = sources.select("source", part.cast("long").alias("part"))
    sums = rows.agg(F.sum("part").alias("parts")).withColumn("q", F.greatest(F.lit(period), 4 * F.col("parts")))
    gathered = rows.agg(F.sort_array(F.collect_list(F.struct("source", "part"))).alias("all")).withColumn("one", F.lit(1))
    both = gathered.join(sums.withColumn("one", F.lit(1)), "one")
    each = both.selectExpr("q", "parts", "inline(transform(all, x -> struct(x.source as source, x.part * q div parts as least, x.part * q % parts as rest)))")
    ranked = each.selectExpr("q", "source", "least", "q - sum(least) over (partition by q) as spare", "row_number() over (partition by q order by rest desc, source) as rank")
    return ranked.selectExpr("source", "least + if(rank <= spare, 1, 0) as w", "q")


def period_schedule(slots: DataFrame) -> DataFrame:
    """source, w, q, j, slot: the earliest-deadline-first schedule of one period."""
    state = slots.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("source", F.col("w").alias("w"), F.lit(0).cast("long").alias("j")))).alias("s"))
    folded = state.selectExpr(
        "q",
        """aggregate(
             sequence(0L, q - 1),
             named_struct('s', s, 'out', cast(array() as array<struct<source: string, w: bigint, j: bigint>>)),
             (acc, t) -> aggregate(
               array(array_min(transform(filter(acc.s, x -> x.j < x.w and x.j * q div x.w <= t),
                 x -> named_struct('deadline', ((x.j + 1) * q + x.w - 1) div x.w, 'source', x.source, 'w', x.w, 'j', x.j)))),
               acc,
               (a, pick) -> named_struct(
                 's', transform(a.s, x -> named_struct('source', x.source, 'w', x.w, 'j', x.j + if(x.source <=> pick.source, 1L, 0L))),
                 'out', array_append(a.out, named_struct('source', pick.source, 'w', pick.w, 'j', pick.j)))),
             acc -> acc.out) as picks""",
    )
    return folded.selectExpr("q", "posexplode(picks) as (slot, pick)").selectExpr("pick.source as source", "pick.w as w", "q", "pick.j as j", "cast(slot as bigint) as slot")


def mix(docs: DataFrame, parts: dict[str, int] | None = None, block_chars: int = 65_536, period: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, start (characters of its source before it), block, slot; with `carry`
    also row, a struct of all its columns.

    Read in the order (slot, start, doc_id) the sources have their target shares of blocks for as long as all last.

    Defined results: a null source counts as the empty one; null and empty texts count one character; null ids come
    first in their source, in order of a hash of the text; rows that repeat an id follow each other by length; an empty table gives an empty result;
    other columns are ignored; more than MOST_SOURCES sources are refused.
    """
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(*carried, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.greatest(F.coalesce(F.char_length(text_col), F.lit(1)), F.lit(1)).cast("long").alias("size"), F.pmod(F.xxhash64(text_col), F.lit(NULL_BUCKETS)).alias("null_bucket"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("doc_id") / BUCKET_IDS), F.lit(-(1 << 56)) + F.col("null_bucket"))).drop("null_bucket").withColumn("chunk", F.floor(F.col("bucket") / (CHUNK_IDS // BUCKET_IDS)))
    buckets = rows.groupBy("source", "chunk", "bucket").agg(F.sum("size").alias("held"))
    chunks = buckets.groupBy("source", "chunk").agg(F.sum("held").alias("held"))
    before = lambda *keys, by: F.sum("held").over(Window.partitionBy(*keys).orderBy(by)) - F.col("held")
    chunks = chunks.select("source", "chunk", before("source", by="chunk").alias("chunk_start"))
    buckets = buckets.select("source", "chunk", "bucket", before("source", "chunk", by="bucket").alias("bucket_start"))
    starts = buckets.join(chunks, ["source", "chunk"]).select("source", "bucket", (F.col("chunk_start") + F.col("bucket_start")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.select(*["row"] * carry, "doc_id", "source", "start", F.expr(f"start div {block_chars}").alias("block"))

    sources = staged(rows.select("source").distinct(), "sources")
    n = sources.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources: one period is scheduled in one task, for {MOST_SOURCES} sources at most")
    turns = period_schedule(target_slots(sources, parts or {}, period)).groupBy("source", "w", "q").agg(F.map_from_entries(F.collect_list(F.struct("j", "slot"))).alias("slot_of"))
    out = placed.join(F.broadcast(turns), "source")  # a row a source, at most MOST_SOURCES
    return out.select(*["row"] * carry, "doc_id", "source", "start", "block", F.expr("block div w * q + slot_of[block % w]").alias("slot"))

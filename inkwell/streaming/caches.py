"""Result caches as stateful streams: which requests a cache would have answered, and with what."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that results live, that a check of availability lives if it succeeded or failed, and results
#: that a cache holds.
RESULT_LIFE_S, OK_LIFE_S, FAILED_LIFE_S, MOST = 600, 120, 30, 256
ANSWERS = "id long, hit boolean, answer string"


class Cache(StatefulProcessor):
    """The cache of one owner. Requests have entry, at (microseconds), id, value (what working it out now would give) and
    life (microseconds that this value lives). State is one row an entry; a timer drops what has expired when no
    requests come."""

    def __init__(self, owner: str, most: int | None):
        self.owner, self.most = owner, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "entry string", "stored long, until long, nth long, value string")
        self.clock = handle.getValueState("clock", "at long, nth long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, nth, timer = self.clock.get() if self.clock.exists() else (-(1 << 62), 0, 0)
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        held, out = dict(before), []
        requests = pd.concat(list(rows)).sort_values(["at", "id"])
        for entry, at, id_, value, life in zip(*(requests[c].tolist() for c in ("entry", "at", "id", "value", "life")), strict=True):
            now = max(now, at)  # the cache's clock does not go back
            found = held.get(entry)
            if found and now < found[1]:
                out.append((id_, True, found[3]))
                continue
            nth += 1
            held[entry] = (now, now + life, nth, value)
            out.append((id_, False, value))
            if self.most is not None and len(held) > self.most:
                held = {k: v for k, v in held.items() if now < v[1]}
                for old in sorted(held, key=lambda k: held[k][:1] + held[k][2:3])[: max(0, len(held) - self.most)]:
                    del held[old]
        held = {k: v for k, v in held.items() if now < v[1]}
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        if held:
            ends = max(v[1] for v in held.values()) // 1000 + 1
            if ends != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(ends)
                timer = ends
        self.clock.update((now, nth, timer))
        yield pd.DataFrame(out, columns=["id", "hit", "answer"]).assign(**{self.owner: key[0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        if self.clock.exists():
            now, nth, _ = self.clock.get()
            self.clock.update((now, nth, 0))
        return iter([])

    def close(self) -> None:
        pass


def cached_answers(requests: DataFrame, owner: str, most: int | None = MOST, late: str = "1 hour") -> DataFrame:
    """owner, id, hit, answer of a stream of requests (owner, entry, ts, id, value, life: an interval in microseconds).

    An owner's requests are answered in order of time and id. One is a hit if its entry was stored less than the stored
    value's life ago; else value is stored and is the answer. Beyond `most` entries the ones that were stored first go.
    Requests more than `late` behind the latest are left out, as they are by any watermark; those less late are
    answered at the latest time the owner's cache has seen. State lives with the stream's checkpoint, so batches that are
    run again give the same answers.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = requests.schema[owner].dataType.simpleString()
    rows = requests.withWatermark("ts", late).select(owner, "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), F.col("entry").cast("string").alias("entry"), F.col("value").cast("string").alias("value"), F.col("life").cast("long").alias("life"))
    return rows.groupBy(owner).transformWithStateInPandas(Cache(owner, most), f"{ANSWERS}, {owner} {kind}", "append", "eventTime")


def cached_results(requests: DataFrame, owner: str, life_s: int = RESULT_LIFE_S, most: int = MOST, late: str = "1 hour") -> DataFrame:
    """cached_answers of results that all live life_s seconds, the last instant included."""
    return cached_answers(requests.withColumn("life", F.lit(life_s * 1_000_000 + 1).cast("long")), owner, most, late)


def cached_checks(checks: DataFrame, owner: str, ok: str = "ok", ok_life_s: int = OK_LIFE_S, failed_life_s: int = FAILED_LIFE_S, late: str = "1 hour") -> DataFrame:
    """cached_answers of checks (owner, entry, ts, id, ok): a success lives longer than a failure; no entry is evicted."""
    life = F.when(F.col(ok), F.lit(ok_life_s * 1_000_000)).otherwise(F.lit(failed_life_s * 1_000_000)).cast("long")
    return cached_answers(checks.withColumns({"life": life, "value": F.coalesce(F.col(ok), F.lit(False)).cast("string")}), owner, None, late)

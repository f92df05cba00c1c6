import heapq
import math
import random

from pyspark.sql import functions as F

from inkwell.llm.mixing import mix, period_schedule, target_slots


def test_schedule_is_edf_and_deviates_less_than_one_block(spark):
    rng = random.Random(3)
    for parts in ({"a": 5, "b": 3}, {c: rng.randrange(1, 40) for c in "abcdefghijk"}):
        sources = spark.createDataFrame([(c,) for c in "abcdefghijk"], "source string")
        rows = period_schedule(target_slots(sources, parts, 500)).orderBy("slot").collect()
        w, q = {r.source: r.w for r in rows}, rows[0].q
        assert [r.slot for r in rows] == list(range(q)) and sum(w.values()) == q
        done, waiting, released = dict.fromkeys(w, 0), [], 0
        for r in rows:
            while released <= r.slot:
                for s, n in w.items():
                    for j in range(n):
                        if j * q // n == released:
                            heapq.heappush(waiting, (math.ceil((j + 1) * q / n), s, j))
                released += 1
            assert (r.source, r.j) == heapq.heappop(waiting)[1:]
            done[r.source] += 1
            assert all(abs(done[s] - (r.slot + 1) * n / q) < 1 for s, n in w.items())


def test_whole_result_and_starts(spark):
    rng = random.Random(8)
    rows = [(i * 90, "x" * rng.randrange(0, 300), rng.choice(["a", "a", "a", "b", None])) for i in range(400)] + [(7, None, "b"), (7, None, "b"), (None, "yy", "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, block int")
    out = mix(df, {"a": 2}, block_chars=500, period=10).collect()
    assert len(out) == len(rows)
    for s in ("a", "b", ""):
        mine = sorted((r for r in rows if (r[2] or "") == s), key=lambda r: (r[0] is not None, r[0], len(r[1] or "x")))
        starts, at = [], 0
        for r in mine:
            starts.append(at)
            at += max(1, len(r[1] or "x") if r[1] is not None else 1)
        got = sorted(r.start for r in out if r.source == s)
        assert got == starts
    assert len({(r.slot, r.source) for r in out}) == len({r.slot for r in out})
    assert mix(df.limit(0)).collect() == [] and mix(df.withColumn("source", F.lit("one"))).where("slot <> block").count() == 0

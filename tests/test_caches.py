"""Result caches as streams: several batches, against a plain loop, and run again."""

import random

from pyspark.sql import functions as F

from inkwell.streaming import caches, usage

SCHEMA = "user long, entry string, ts timestamp, id long, value string"


def loop(rows, life_s, most):
    held, out = {}, {}
    for user, entry, ts, i, value in sorted(rows, key=lambda r: (r[2], r[3])):
        mine = held.setdefault(user, {})
        if entry in mine and ts <= mine[entry][0] + life_s:
            out[i] = (True, mine[entry][1])
            continue
        mine[entry] = (ts, value)
        out[i] = (False, value)
        if len(mine) > most:
            live = {k: v for k, v in mine.items() if ts <= v[0] + life_s}
            while len(live) > most:
                del live[min(live, key=lambda k: live[k][0])]
            held[user] = live
    return out


def test_batches_and_replays_give_the_answers_of_one_loop(spark, tmp_path):
    rng, at, rows = random.Random(4), 1_700_000_000, []
    for i in range(400):
        at += rng.randrange(1, 30)
        rows.append((rng.choice((1, 1, 1, 2, 3)), f"e{rng.randrange(7)}", at, i, f"v{i}"))
    source = str(tmp_path / "in")
    for k in range(4):  # files come in order of time
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "user long, entry string, ts long, id long, value string").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        answers = caches.cached_results(stream(), "user", 120, 3)
        answers.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return {r.id: (r.hit, r.answer) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    got, n = run()
    want = loop(rows, 120, 3)
    assert got == want and n == 400 and 50 < sum(h for h, _ in want.values()) < 350
    assert run() == (got, n)  # nothing is answered twice


def test_failures_live_shorter(spark, tmp_path):
    checks = [(1, "p", 0, 1, True), (1, "p", 119, 2, False), (1, "p", 120, 3, False), (1, "p", 149, 4, True), (1, "p", 150, 5, True), (2, "p", 150, 6, None)]
    spark.createDataFrame(checks, "user long, entry string, ts long, id long, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, entry string, ts timestamp, id long, ok boolean").parquet(str(tmp_path / "in"))
    got = {r.id: (r.hit, r.answer) for r in usage.run_to_end(caches.cached_checks(stream, "user"), "append").collect()}
    assert got == {1: (False, "true"), 2: (True, "true"), 3: (False, "false"), 4: (True, "false"), 5: (False, "true"), 6: (False, "false")}

import json

from pyspark.sql import functions as F

from inkwell.sources import pages as pg
from inkwell.sources import snapshots
from inkwell.streaming import usage


def test_page_tree(spark, tmp_path):
    for doc, part, n, text in [("d1", "p1", 1, "one"), ("d1", "p1", 12, "twelve\nlines"), ("d2", "p2", 3, "𠀀")]:
        (tmp_path / "docs" / doc / "L4").mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / doc / "L4" / f"{part}_page_{n:03d}.txt").write_text(text, encoding="utf-8")
    pages = pg.read_pages(spark, str(tmp_path / "docs"))
    assert sorted(tuple(r) for r in pages.collect()) == [("d1", "p1", 1, "one"), ("d1", "p1", 12, "twelve\nlines"), ("d2", "p2", 3, "𠀀")]
    wanted = spark.createDataFrame([("d1", "p1", 1), ("d9", "p1", 1)], "doc_id string, part_id string, page_num int")
    assert sorted((r.doc_id, r.text, r.exists) for r in pg.page_text(pages, wanted).collect()) == [("d1", "one", True), ("d9", "", False)]
    out = str(tmp_path / "out")
    pg.write_pages(pages, out)
    pg.write_pages(pages.where("doc_id = 'd2'").withColumn("text", F.lit("new")), out)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["new", "one", "twelve\nlines"]


def test_json_layers_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"block_id": "p1_b1", "marks": [{"id": "m"}]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = pg.read_json_layer(spark, str(tmp_path), "block_id string, marks array<struct<id: string>>").collect()
    assert [r.block_id for r in rows] == ["p1_b1"] and rows[0].path.endswith("a.json")


def test_usage_log(spark, tmp_path):
    path = str(tmp_path / "log")
    pg.append_usage_log(spark.createDataFrame([("2024-01-02", "call", 0.5)], "ts string, type string, cost_usd double"), path)
    (tmp_path / "log" / "more.json").write_text(json.dumps({"ts": "2024-01-03", "type": "call"}) + "\nnot json\n")
    assert sorted((r.ts, r.cost_usd) for r in pg.read_usage_log(spark, path).collect()) == [("2024-01-02", 0.5), ("2024-01-03", None)]


def test_snapshots_round_trip(spark):
    rows = [(1, 0, "user", 'a "quoted"\n𠀀'), (1, 1, None, ""), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, (tuple(r) for r in snapshots.import_rows(snapshots.export_rows(df)).collect()))) == sorted(map(str, rows))


def test_stream_rolls_up_as_batch_and_drops_repeats(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", "click" if i % 2 else "view", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = usage.event_stream(spark, str(tmp_path / "events.parquet"))
    out = usage.run_to_end(usage.daily_usage(stream), "complete")
    want = df.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"), F.sum("value"))
    assert sorted((str(r[0])[:10], r[1], r[2], r[3]) for r in out.collect()) == sorted((str(r[0]), r[1], r[2], r[3]) for r in want.collect())
    first = usage.run_to_end(usage.first_within(stream, ["event_type"], "10 days").select("event_id", "event_type"), "append")
    assert sorted(r.event_type for r in first.collect()) == ["click", "view"]

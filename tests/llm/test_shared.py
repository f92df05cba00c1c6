import random

from pyspark.sql import functions as F

from inkwell.llm import _shared, exact_dedup
from inkwell.llm.components import components


def test_join_skewed_equals_a_plain_join(spark):
    rng = random.Random(1)
    keys = [7] * 3000 + [rng.randrange(400) for _ in range(2000)] + [None] * 5
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key int")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key is not null and key % 3 <> 0")
    for how in ("inner", "left"):
        got = _shared.join_skewed(rows, counted, "key", rows.count(), "id", how=how).select("id", "key", "top").collect()
        want = rows.join(counted.drop("n"), "key", how).select("id", "key", "top").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_small_sides_beyond_the_bound_are_shuffled(spark, monkeypatch):
    rows = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.range(0, 100, 3).withColumnRenamed("id", "k")
    assert {r.k for r in _shared.keep_rows(rows, keys, "k", most=0).collect()} == set(range(0, 100, 3))
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    small = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == small


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(500, 499), (7, 7)]
    out = dict((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_follow_words_and_not_their_places():
    texts = ["The cat\tsat", "", "cat THE  é", "  sat"]
    words, at = _shared.word_hashes(texts)
    assert at.tolist() == [0, 3, 3, 6, 7]
    assert words[0] == words[4] and words[1] == words[3] and words[2] == words[6] and len(set(words.tolist())) == 4

import random
from itertools import permutations

from pyspark.sql import functions as F

from inkwell.functions.arrays import running, starts_of
from inkwell.operators import alignment as al
from inkwell.operators import dictionary as di
from inkwell.operators import flows as fl
from inkwell.operators import parsing as pa
from inkwell.operators import reports as rp
from inkwell.operators import selection as se


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_smoothing_equals_the_best_of_all_permutations():
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 5, 7):
        orders = [float(i) + rng.random() for i in range(n)]
        begins, ends = [[(rng.random() * 100, rng.random() * 100) for _ in range(n)] for _ in range(2)]
        spread = max(orders) - min(orders) or 1.0
        cost = lambda i, j: ((begins[j][0] - ends[i][0]) ** 2 + (begins[j][1] - ends[i][1]) ** 2) ** 0.5 / 150 + abs(orders[i] - orders[j]) / spread  # noqa: B023, E731
        total = lambda p: sum(cost(a, b) for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        allowed = [p for p in permutations(range(n)) if p[0] == 0 and p[-1] == n - 1 and all(abs(a - b) <= 2 for a, b in zip(p, p[1:]))]  # noqa: B905
        got = fl._smoothed(orders, begins, ends, 150.0)
        assert sorted(got) == list(range(n)) and abs(total(got) - min(map(total, allowed))) < 1e-9
    assert fl._smoothed([1.0] * 30, [(0, 0)] * 30, [(0, 0)] * 30, 1.0) == list(range(30))


def test_places_of_a_needle(spark):
    rng = random.Random(4)
    cases = [("".join(rng.choice("ab.\\E$𠀀") for _ in range(rng.randrange(0, 40))), "".join(rng.choice("ab.\\E$𠀀") for _ in range(rng.randrange(0, 4)))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n string")
    out = df.select("i", starts_of(F.col("t"), F.col("n")).alias("a"), starts_of(F.col("t"), F.col("n"), overlapping=True).alias("b"))
    for i, apart, every in rows_of(out):
        t, n = cases[i]
        want, at = [], t.find(n) if n else -1
        while at >= 0:
            want.append(at)
            at = t.find(n, at + len(n))
        assert apart == want and every == [k for k in range(len(t)) if n and t.startswith(n, k)], (t, n)
    sums = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 7, 100)], "x array<int>").select("x", running(F.col("x")).alias("s"))
    assert all(s == [sum(x[: k + 1]) for k in range(len(x))] for x, s in rows_of(sums))


def test_headwords_of_one_or_two_characters_need_no_nested_loop(spark):
    texts = spark.createDataFrame([(1, "王戎簡要裴楷清通王王"), (2, "孔明臥龍"), (3, ""), (4, None)], "id int, text string")
    words = spark.createDataFrame([("王",), ("王戎",), ("孔明臥龍",), ("裴楷",), ("",), ("龍王",)], "headword string")
    joined = di.substring_join(texts, words, "id")
    assert sorted(rows_of(joined)) == [(1, "王", 0, 0), (1, "王", 8, 8), (1, "王", 9, 9), (1, "王戎", 0, 1), (1, "裴楷", 4, 5), (2, "孔明臥龍", 0, 3)]
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_marks_taken_back_and_normalized(spark):
    df = spark.createDataFrame([("王戎 簡要", "。王戎，簡要。！"), ("", "x"), (None, None), ("ab", "ab")], "a string, b string")
    out = [[(m.start, m.after) for m in r[0]] for r in rows_of(df.select(pa.marks_between("a", "b")))]
    assert out == [[(0, "。"), (1, "，"), (3, "。！")], [], [], []]
    raw = '[{"after_char_index": 3, "mark": "。"}, {"start": "1", "end": null, "before": "《"}, "x", {"start": "a"}, {"end": 2}]'
    marks = rows_of(spark.createDataFrame([(raw,), ("no json",), (None,)], "j string").select(pa.normalize_marks(F.col("j"))))
    assert [tuple(m) for m in marks[0][0]] == [(3, 3, None, "。"), (1, 1, "《", None), (0, 2, None, None)] and marks[1][0] == [] and marks[2][0] == []


def test_page_alignment_finds_variants_and_faults(spark):
    lines = spark.createDataFrame([(1, "a", 0, 0, "王戎簡要"), (1, "a", 0, 1, "裴楷清通"), (1, "b", 1, 0, "孔明卧龍"), (1, "c", 2, 0, "")], "page int, block string, pos int, line_no int, text string")
    refs = spark.createDataFrame([(1, "王戎簡要\n裴楷清通\n孔明臥龍呂望非熊")], "page int, text string")
    variants = spark.createDataFrame([("臥", "卧")], "a string, b string")
    out = {r.block: r for r in rp.page_alignment(lines, refs, variants, "page", "block").collect()}
    assert set(out) == {"a", "b", "*"}
    assert (out["a"].total, out["a"].accuracy) == (8, 1.0) and (out["b"].n_exact, out["b"].n_variant) == (3, 1)
    assert (out["*"].total, out["*"].n_deletion, out["*"].n_exact, out["*"].n_variant) == (16, 4, 11, 1)


def test_columns_keep_their_order_on_ties_and_nulls(spark):
    g = spark.createDataFrame([(1, 1, 500.0, 10.0), (1, 2, 470.0, 5.0), (1, 3, 300.0, 1.0), (1, 4, 500.0, 10.0)], "page int, key int, cx double, cy double")
    assert [r[0] for r in rows_of(se.groups_in_columns(g, "page", "key").orderBy("rank").select("key"))] == [2, 1, 4, 3]
    blocks = spark.createDataFrame([(1, "x", None, 1, None), (1, "y", 2, 0, True), (1, "z", 1, 2, False)], "page int, block_id string, reading_order int, pos int, skip boolean")
    assert [r.block_id for r in se.by_reading_order(se.blocks_to_run(blocks), "page").orderBy("rank").collect()] == ["z", "x"]


def test_counts_equal_the_pairs_they_stand_for(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 30))), "".join(rng.choice("abce") for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(99, None, "a"), (98, None, None)]
    df = spark.createDataFrame(rows, "k int, ocr string, ref string")
    variants = spark.createDataFrame([("e", "é"), ("é", "e"), ("a", "b")], "a string, b string")
    pairs = df.select("k", F.explode(al.align_chars("ocr", "ref")).alias("p")).select("k", "p.*")
    want = {r.k: tuple(r) for r in al.alignment_stats(al.relabel_variants(pairs, variants), "k").collect()}
    got = {r.k: tuple(r) for r in al.text_stats(df, ["k"], variants).collect()}
    assert len(got) == 82 and all(got[k] == v for k, v in want.items()) and got[98] == (98, 0, 0, 0, 0, 0, 0, 0.0)

import random

from pyspark.sql import functions as F

from inkwell.llm import substring_dedup as sd
from inkwell.llm.substring_dedup import _CUT, substring_dedup


def brute(rows, k=2, least=20):
    places, cut = {}, {}
    for i, t in rows:
        s = _CUT.split(t or "")[::2]
        cut[i] = s
        for a in range(len(s)):
            for b in range(a, len(s)):
                if b - a + 1 >= k and sum(len(x.split()) for x in s[a : b + 1]) >= least:
                    places.setdefault(tuple(" ".join(x.lower().split()) for x in s[a : b + 1]), set()).add((i, a))
                    break
            for c in range(a, -1, -1):
                if a - c + 1 >= k and sum(len(x.split()) for x in s[c : a + 1]) >= least:
                    places.setdefault(tuple(" ".join(x.lower().split()) for x in s[c : a + 1]), set()).add((i, c))
                    break
    gone = {i: set() for i in cut}
    for run, where in places.items():
        for i, a in where - {min(where)}:
            gone[i] |= set(range(a, a + len(run)))
    return {i: len(g) for i, g in gone.items()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((1, 2, 7, 12)))) + "."
    shared = [[sentence() for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(60):
        body = [sentence() for _ in range(rng.randrange(6))]
        for p in rng.sample(shared, rng.randrange(3)):
            body += p + [sentence()]
        rows.append((i, rng.choice((" ", "\n")).join(body)))
    rows += [(100, None), (101, ""), (102, rows[7][1])]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, first int, h int")
    out = {r.doc_id: r for r in substring_dedup(df).collect()}
    assert {i: r.n_removed for i, r in out.items()} == brute(rows)
    assert out[100].text is None and out[101].text == ""
    assert sum(brute(rows).values()) > 0
    left = [(i, r.text) for i, r in out.items()]
    assert all(v == 0 for v in brute(left).values())


def test_clean_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "The. Of. As. One two three. The. Of. As."), (2, "The. Of. As. One two three.")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(df).collect()] == [0, 0]
    assert substring_dedup(df.limit(0)).collect() == []


def test_no_fifty_words_of_an_earlier_document_stay_whole(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    fifty = lambda t: {tuple(w[i : i + 50]) for w in [t.lower().split()] for i in range(len(w) - 49)}
    long, inner, plain = words(60), words(24) + ["end."] + words(14) + ["end."] + words(20), words(52)
    rows = [(1, " ".join(words(30)) + ". " + " ".join(long) + ". " + " ".join(words(30)) + "."), (2, " ".join(words(9)) + ". " + " ".join(long) + ". " + " ".join(words(40)) + ".")]
    rows += [(3, " ".join(words(20) + inner + words(20)) + "."), (4, " ".join(words(5) + inner + words(33)) + ".")]
    rows += [(5, " ".join(words(200) + plain + words(100))), (6, " ".join(words(77) + [w.upper() for w in plain] + words(300)))]
    rows += [(7, " ".join(words(70)) + "."), (8, " ".join(["again"] * 200))]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:7]:
        for j, u in rows[:7]:
            assert i >= j or not fifty(t) & fifty(out[j].text)
    assert [i for i, r in sorted(out.items()) if r.n_removed] == [2, 4, 6, 8]
    assert all(out[i].text == t for i, t in rows if i in (1, 3, 5, 7))
    assert " ".join(long) not in out[2].text and len(out[2].text.split()) == 49
    assert len(out[8].text.split()) == 26


def test_rows_that_share_an_id_lose_only_their_own_sentences(spark):
    rng = random.Random(12)
    passage = lambda: " ".join(" ".join(f"u{rng.randrange(9000)}" for _ in range(11)) + "." for _ in range(6))
    common, own, nulls = passage(), passage(), [passage() for _ in range(3)]
    rows = [(1, common + " First tail."), (5, "Head. " + common), (5, own + " Last words here."), (5, own + " Last words here."), (None, nulls[0]), (None, nulls[1] + " " + nulls[0]), (None, nulls[2]), ((1 << 53) + 1, "Alone here."), (9, nulls[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted((r.doc_id or -1, r.text) for r in substring_dedup(df).collect())
    kept = lambda i: sorted(t for k, t in out if k == i)
    assert kept(1) == [common + " First tail."] and kept(5) == sorted(["Head.", own + " Last words here.", ""])  # one of the rows that repeat stays
    assert nulls[2] in kept(-1) and kept((1 << 53) + 1) == ["Alone here."] and kept(9) == [""]
    assert sorted(kept(-1)) in (sorted([nulls[0], nulls[1], nulls[2]]), sorted(["", nulls[1] + " " + nulls[0], nulls[2]]))


def test_copies_under_one_id_or_none_are_removed(spark):
    text = " ".join(f"Sentence number {i} has quite a few words of its own here." for i in range(8))
    short = "Too short to be a run."
    for ids in ((None, None), (7, 7), (1, 2), (7, 7, 7, None, None)):
        rows = [(i, text) for i in ids] + [(i, short) for i in ids] + [(99, None), (99, None)]
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted(r.n_removed for r in got if r.n_sentences == 8) == [0] + [8] * (len(ids) - 1)
        assert sum(r.text == short for r in got) == len(ids) and sum(r.text is None for r in got) == 2


def test_a_third_of_all_rows_may_be_one_row(spark):
    text = " ".join(f"Sentence {i} of the passage that a third of the table holds." for i in range(6))
    rows = [(None, text)] * 3000 + [(i, f"Document {i} says {i * 7} things. And it says {i * 13} more of them.") for i in range(6000)]
    once, others = sd.first_and_others(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("coalesce(doc_id, -9223372036854775808) as doc_id", "text").repartition(8))
    assert once.count() == 6001 and others.count() == 2999
    assert max(r["n"] for r in others.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) < 2000
    assert sorted(r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_sentences = 6").collect()) == [0] + [6] * 2999

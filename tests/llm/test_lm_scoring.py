import math
import random
import re
from collections import Counter

import pytest

from inkwell.llm.lm_scoring import lm_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order, alpha=0.4, least=2):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for i, t in rows}
    counts = Counter(tuple(w[k : k + n]) for w in words.values() for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, out = sum(map(len, words.values())), {}
    for i, w in words.items():
        score = off = 0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(counts[g] / total)
                elif counts[g] >= least:
                    score += math.log(counts[g] / counts[g[:-1]])
                    break
                else:
                    off += 1
                    score += math.log(alpha)
        out[i] = (len(w), off, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_stupid_backoff(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(("The", "the", "of", "a", f"w{rng.randrange(200)}", "é")) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "x " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(5).sortWithinPartitions("doc_id")
    want = brute(rows, order)
    out = {r.doc_id: r for r in lm_scores(df, order=order).collect()}
    assert len(out) == len(rows)
    for i, (n, off, score) in want.items():
        assert (out[i].n_words, out[i].n_backed_off) == (n, off) and math.isclose(out[i].score, score, rel_tol=1e-9, abs_tol=1e-9)
    assert out[500].mean_score is None


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    out = lm_scores(df.union(df)).collect()
    assert len(out) == 2 and all(math.isclose(r.score, brute([(1, "a b a b"), (2, "a b a b")], 2)[1][2]) for r in out)
    assert lm_scores(df.limit(0)).collect() == []


def test_rows_of_one_id_and_equal_lengths_keep_their_own_scores(spark):
    texts = ["a b c d", "e f g h", "a b c d", "x x x x", "c d a b"]
    ids = [None, None, 7, 7, None]
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(5)
    want = brute(list(enumerate(texts)), 2)
    out = sorted((r.doc_id or -1, r.n_words, r.n_backed_off, round(r.score, 9)) for r in lm_scores(df).collect())
    assert out == sorted((i or -1, *want[k][:2], round(want[k][2], 9)) for k, i in enumerate(ids))
    big = (1 << 53) + 1  # an id that a float cannot hold, beside a null
    df = spark.createDataFrame([(big, "a b"), (None, "a b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in lm_scores(df).collect()} == {big, None}

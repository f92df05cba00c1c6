"""The rules' counts against plain loops, and the model on labelled documents held out from it."""

import random
import re

import numpy as np
import pytest

from inkwell.llm import quality_rules as qr
from inkwell.llm.quality_rules import quality_rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def prose(rng, n):
    return " ".join(rng.choice(("the", "river", "carried", "grain", "slowly", "into", "harbour", "towns", "and", "merchants", "wrote", "letters", "about", "prices")) for _ in range(n))


def junk(rng, n):
    return " ".join("".join(rng.choice("xqzjkv0") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randrange(25, 90)) if i % 5 else junk(rng, rng.randrange(25, 90))) for i in range(900)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 900, 2)]
    odd = ["", None, " \n\t ", "a b c d e f g h a b c d e f g h " * 3, "one line\none line\n\n \nOne line\r\none line\r", "# * <b> & | $5 100%", "naïve 日本 \U00020000 word", "w " * 7, "x y z " * 4000, prose(rng, 30) + "\n" + prose(rng, 9)]
    docs += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, docs[3][1]), (3, docs[3][1]), (3, odd[3])]
    return docs, labels


def run(spark, docs, labels, **more):
    return quality_rules(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)


def test_counts_and_verdicts(spark, corpus, monkeypatch):
    monkeypatch.setattr(qr, "CHUNK_CHARS", 3000)
    docs, labels = corpus
    got = run(spark, docs, labels).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in got) == sorted((str(i), *brute(t)) for i, t in docs)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
        assert r.band == ("drop" if r.probability < 0.5 else "doubtful" if r.probability < 0.9 else "sure")
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2]  # without labels
    assert all(r.kept == (r.doc_id % 5 > 0) for r in judged if not r.base_failed)


def test_probabilities_are_calibrated(spark):
    """Two kinds of text whose labels are 1 in 80 and in 20 of 100: probabilities of unlabelled texts come near these."""
    rng = random.Random(9)
    docs = [(i, (prose if i % 2 else junk)(rng, 40)) for i in range(3000)]
    labels = [(i, int(rng.random() < (0.8 if i % 2 else 0.2)), 0) for i in range(2000)]
    got = [r for r in run(spark, docs, labels, ).collect() if r.doc_id >= 2000]
    for odd, share in ((1, 0.8), (0, 0.2)):
        assert abs(np.mean([r.probability for r in got if r.doc_id % 2 == odd]) - share) < 0.08


def test_margin_equals_the_trained_vectors(spark, corpus):
    docs, labels = corpus
    rows = spark.createDataFrame([(i, float(i % 2), False, t) for i, t in docs[:40] if t], "doc_id long, label double, held boolean, text string").coalesce(1)
    weights = np.random.default_rng(0).normal(size=1 << qr.BITS)
    dots = [float(weights[np.frombuffer(r.buckets, np.int32)] @ np.frombuffer(r.weights, np.float64)) for r in qr.feature_rows(rows).collect()]
    texts = [r.text for r in rows.collect()]
    words, at = qr.word_hashes(texts, lower=False)
    assert np.allclose(dots, qr.margins(texts, words, at, weights))


def test_sample_bound_and_missing_labels(spark, corpus, monkeypatch):
    docs, labels = corpus
    monkeypatch.setattr(qr, "TRAIN_ROWS", 150)
    fitted = []
    monkeypatch.setattr(qr, "feature_rows", lambda rows, make=qr.feature_rows: fitted.append(rows.count()) or make(rows))
    assert sum(not r.kept for r in run(spark, docs, labels).collect() if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0) == 180
    assert 90 < fitted[0] < 220
    for none in ([], [(i, 1, 0) for i in range(50)], [(None, 1, 0), (5, None, 1), (10**9, 0, 0)]):
        got = run(spark, docs, none).collect()
        assert len(got) == len(docs) and all(r.probability is None and r.band is None and r.kept == (not r.base_failed) for r in got)
    assert run(spark, docs, labels).limit(0).columns[:6] == ["doc_id", *COUNTS]
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, label string, held int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []

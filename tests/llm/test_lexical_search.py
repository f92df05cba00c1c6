"""Ranked search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import lexical_search as ls
from inkwell.llm.lexical_search import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    cut = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(cut), sum(x[2] for x in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c, length in cut:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(("the", "of", "And", "naïve", "日本", "x-y", f"w{int(rng.expovariate(0.05))}", f"Rare{rng.randrange(3000)}"))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)]  # exact copies: ties beyond the tenth place
    docs += [(None, docs[7][1]), (None, None), (2000, None), (2001, ""), (2002, "... !"), (2003, "the " * 30_000 + "rare9"), (5, "the same id, other text rare9")]
    docs += [docs[9]] * 3
    items = [(i, " ".join(rng.choice(docs[:600])[1].split()[:25])) for i in range(30)] + [(40, docs[7][1]), (41, None), (42, ""), (43, "nothing-there-at-all qqq"), (44, "the the the of"), (None, "rare9 w1"), (44, "the the the of")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_equal_to_a_scan(spark, corpus, k):
    docs, items = corpus
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search(*tables(spark, docs, items), k=k).collect()]
    assert sorted(got, key=str) == brute(docs, items, k)


def test_same_over_blocks_waves_and_first_steps(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ls, "BLOCK_COUNTS", 500)
    monkeypatch.setattr(ls, "WAVE_TERMS", 600)
    monkeypatch.setattr(ls, "FIRST_PLACES", 1)
    monkeypatch.setattr(ls, "CHUNK_CHARS", 1000)
    d, i = tables(spark, docs, items, 2)
    assert len(ls.query_waves(ls.staged(i.where("text is not null").selectExpr("item_id", "xxhash64(text) as item_key", "text"), "x"))) > 3
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search(d, i).collect()]
    assert sorted(got, key=str) == brute(docs, items, 10)


def blocks_of(docs, n_terms):
    """A block of (id, {term: tf}) with all weights 1000."""
    sizes = [len(c) for _, c in docs]
    term = np.concatenate([np.array(sorted(c), np.int32) for _, c in docs])
    tf = np.concatenate([np.array([c[t] for t in sorted(c)], np.int64) for _, c in docs])
    ids = np.array([i for i, _ in docs], np.int64)
    lengths = np.full(len(docs), 10, np.int64)
    return ls.Block([(ids.tobytes(), ids.tobytes(), lengths.tobytes(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tobytes(), term.tobytes(), tf.tobytes())], np.full(n_terms, 1000, np.int64), len(docs), 10 * len(docs))


def test_stops_early_but_not_at_equality(monkeypatch):
    monkeypatch.setattr(ls, "FIRST_PLACES", 1)
    # the best documents lead both lists: few places are read
    docs = [(i, {0: 40 - i, 1: 40 - i}) for i in range(40)]
    block, read = blocks_of(docs, 2), []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                read.append(len(key))
            return super().__getitem__(key)

    block.listed = block.listed.view(Watched)
    assert [x[2] for x in block.best(np.array([0, 1]), 2, [])] == [0, 1]
    assert sum(read) < 20
    # all tie: the smallest ids win although they come last in the lists
    block = blocks_of([(100 - i, {0: 3, 1: 3}) for i in range(64)], 2)
    assert [x[2] for x in block.best(np.array([0, 1]), 3, [])] == [37, 38, 39]
    # what is known from other blocks closes a block whose tops are lower
    low = blocks_of([(i, {0: 1}) for i in range(5)], 1)
    high = [(-(10**12), False, 7, 7)]
    assert low.best(np.array([0]), 1, high) == high


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b")], [(1, "a")])
    assert lexical_search(d.limit(0), i).collect() == []
    assert lexical_search(d, i.limit(0)).collect() == []
    assert lexical_search(d, i.where("false")).columns == ["item_id", "rank", "doc_id", "score", "text_key", "item_key"]

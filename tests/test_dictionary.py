"""Dictionary search against plain scans."""

import random

import pytest

from inkwell.functions import automaton
from inkwell.functions.automaton import Automaton
from inkwell.operators import dictionary as di


def scan(texts, words):
    return sorted((k, w, i, i + len(w) - 1) for k, t in texts for w in set(words) if w for i in range(len(t or "")) if t.startswith(w, i))


@pytest.mark.parametrize("stretch", [1, 5, 2048])
def test_automaton_finds_all(monkeypatch, stretch):
    monkeypatch.setattr(automaton, "STRETCH", stretch)
    rng = random.Random(stretch)
    for alphabet in ("ab", "abcde日\U00020000é"):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(25)})
        texts = ["".join(rng.choice(alphabet + "?\x00") for _ in range(rng.randrange(0, 90))) for _ in range(12)]
        of, word, start = Automaton(words).find(texts)
        assert sorted((int(k), words[w], int(i), int(i) + len(words[w]) - 1) for k, w, i in zip(of, word, start, strict=True)) == scan(list(enumerate(texts)), words)
    assert all(not len(x) for x in (*Automaton([]).find(["a"]), *Automaton(["a"]).find([])))


def test_substring_join_over_shards(spark, monkeypatch):
    words = ["a", "ab", "bab", "b", "", None, "學而", "而時", "學而時習之", "aaaa", "\U00020000", "ab"]
    texts = [(1, "ababab aaaaaa"), (2, "子曰學而時習之不亦說乎"), (3, None), (4, ""), (5, "x\U00020000\U00020000a"), (1, "bab")]
    t, w = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in words], "headword string")
    want = scan(texts, [x or "" for x in words])
    for letters_held in (2_000_000, 3):
        monkeypatch.setattr(di, "SHARD_LETTERS", letters_held)
        assert sorted(tuple(r) for r in di.substring_join(t, w, "id").collect()) == want
    assert di.build_automata(w).count() > 2
    assert di.substring_join(t, w.limit(0), "id").collect() == []
    plan = di.substring_join(t, w, "id")._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no row per letter

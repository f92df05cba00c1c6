import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkwell.llm.quality import HELD_OUT, ORDER, perplexities, quality


def kneser_ney(texts):
    """ln p(gram) by plain recursion over dictionaries."""
    seen = {ORDER: Counter(t[i : i + ORDER] for t in texts for i in range(len(t) - ORDER + 1))}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])
    off, contexts = {}, defaultdict(lambda: [0, 0.0])
    for k, counts in seen.items():
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0, 0.5, 1.0, 1.5]
        if n[1] and n[2]:
            d[1] = min(0.95, max(0.05, 1 - 2 * y * n[2] / n[1]))
        if n[1] and n[2] and n[3]:
            d[2] = min(1.9, max(0.1, 2 - 3 * y * n[3] / n[2]))
        if n[1] and n[3] and n[4]:
            d[3] = min(2.85, max(0.15, 3 - 4 * y * n[4] / n[3]))
        off[k] = lambda c, d=d: d[min(c, 3)]
        for g, c in counts.items():
            contexts[k, g[:-1]][0] += c
            contexts[k, g[:-1]][1] += off[k](c)

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(seen[1]) + 1)
        if (k, g[:-1]) not in contexts:
            return below
        total, freed = contexts[k, g[:-1]]
        c = seen[k].get(g, 0)
        return ((c - off[k](c) if c else 0) + freed * below) / total

    return p


def rows_of(rng, n):
    syllables = {"en": ["the", "ing", "er", " on", " a"], "de": ["sch", "en", "ung", " der", " ü"]}
    return [(i, rng.choice(["en", "de"]), "".join(rng.choice(syllables["en" if i % 3 else "de"]) for _ in range(rng.randrange(0, 120)))) for i in range(n)]


def test_perplexities_equal_plain_recursion(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 120) + [(500, "en", "𠀀é unseen ZZ"), (501, "xx", "no model here"), (502, "en", "abc"), (503, "en", "")]
    df = spark.createDataFrame([(i, lang, t, i % 2 == 0 and i < 500, i % 2 == 0 and i < 500) for i, lang, t in rows], "doc_id long, lang string, text string, trusted boolean, train boolean").repartition(3).sortWithinPartitions("doc_id")
    models = {x: kneser_ney([t for i, lang, t in rows if lang == x and i % 2 == 0 and i < 500]) for x in ("en", "de")}
    out = {r.doc_id: r for r in perplexities(df).collect()}
    assert len(out) == len(rows)
    for i, lang, t in rows:
        grams = [t[k : k + ORDER] for k in range(len(t) - ORDER + 1)] if lang in models else []
        assert out[i].n_grams == len(grams)
        assert math.isclose(out[i].logp, sum(math.log(models[lang](g)) for g in grams), rel_tol=1e-9, abs_tol=1e-9)


def test_separates_and_keeps_clean(spark):
    rng = random.Random(2)
    rows = [(i, "en" if i % 3 else "de", t * 3) for i, _, t in rows_of(rng, 600)]
    bad = [(1000 + i, lang, t.upper().replace(" ", "!! ")) for i, lang, t in rows[:60]]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in [*rows, *bad, (2000, None, None), (2001, "zz", "words " * 50)]], "doc_id long, lang string, text string, keep string, logp double")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i % 2] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(out) == len(rows) + len(bad) + 2
    assert sum(out[i].keep for i, _, _ in rows) >= 0.98 * len(rows)
    assert all(not out[i].keep for i, _, t in bad if len(t) >= 110)
    assert out[2000].keep and out[2001].keep
    assert all(r.keep for r in quality(docs, labels.limit(0)).collect())
    assert quality(docs.limit(0), labels).collect() == []
    held = spark.range(600).where(F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0).count()
    assert 60 < held < 240

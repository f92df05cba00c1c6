import random
import re
from itertools import combinations

import numpy as np
import pytest

from inkwell.llm.jaccard_join import MOST_SPARED, SPARED_BITS, Bounds, choose_boundary, jaccard_components, linked_rows, set_keys

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            ra, rb = find(a), find(b)
            top[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies(rng, n_bases, copies):
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 14, 25, 60, 200)))]
        chain = [base]
        for _ in range(copies):
            w = list(rng.choice(chain))
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w.append(rng.choice(vocabulary))
            chain.append(w)
        rows += [" ".join(c) for c in chain]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_a_common_passage_makes_no_group(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(90))
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(60, 90))) + " " + passage) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(200 + i, passage + f" x{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = near_copies(rng, 12, 14) + [(9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, "ONE\ttwo")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, rep int")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def kept_keys(keys, tags):
    """The keys that are left when a set gives up what it can, in an order of lists that is the same for all sets."""
    spared, odd = tags >> 1 & MOST_SPARED, tags & 1
    keep = np.ones(len(keys), bool)
    for parity in (0, 1):
        mine = np.flatnonzero(odd == parity)
        order = mine[np.argsort(keys[mine] % 104729, kind="stable")]
        keep[order] = np.arange(len(order)) >= spared[order]
    return keys[keep], int(tags[0] >> SPARED_BITS + 1)


def test_keys_meet_whenever_sets_link():
    bounds, rng = Bounds(90), np.random.default_rng(3)
    edges = bounds.classes(4000)
    for boundary in (0, 12, 24):
        for n in (2, 9, 10, 11, 18, 19, 20, 27, 38, 57, 150, 400):
            for _ in range(20):
                base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                a = np.sort(rng.permutation(base)[: rng.integers(max(1, int(n * 0.9)), n + 1)])
                b = np.unique(np.concatenate((rng.permutation(base)[: rng.integers(max(1, int(n * 0.9)), n + 1)], rng.integers(0, 1 << 63, rng.integers(0, 2 + n // 20), dtype=np.uint64))))
                both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                for share in (0, 0.5, 0.9, 1):
                    popular = np.sort(rng.permutation(base)[: int(share * n)])
                    if 100 * both >= 90 * union:
                        kept = [kept_keys(*set_keys(s, boundary, bounds, edges, popular)) for s in (a, b)]
                        assert len(np.intersect1d(kept[0][0], kept[1][0])) >= min(kept[0][1], kept[1][1]) >= 1


def test_boundary_follows_cost():
    assert choose_boundary({12: 1000}, Bounds(90)) >= 12
    assert choose_boundary({40: 1000}, Bounds(90)) < 40


def test_rows_that_share_an_id_or_have_none_link_by_their_own_texts(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(6)]
    rows = [(3, base[0]), (5, base[0]), (5, base[1]), (9, base[1] + " tail"), (5, base[2]), (5, base[2])]  # 5 is three texts
    rows += [(None, base[3]), (20, base[3] + " tail"), (None, base[4]), (None, base[4] + " tail"), (None, base[5]), (30, base[5]), (None, ""), (None, None), (40, base[2] + " x"), (41, "a b"), (None, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {}
    for r in jaccard_components(df).collect():
        out.setdefault((r.doc_id, r.n_shingles), set()).add(r.component_id)
    assert out == {
        (3, 58): {3}, (5, 58): {3, 5}, (9, 59): {5}, (None, 58): {20, None, 30}, (20, 59): {20}, (None, 59): {None},
        (30, 58): {30}, (None, 0): {None}, (40, 59): {5}, (41, 1): {41}, (None, 1): {41},
    }
    linked = {(r.doc_id, r.n_shingles): r.component for r in linked_rows(df.where("doc_id is null")).where("n_shingles > 0 and n_shingles <> 58").collect()}
    both = [r.component for r in linked_rows(df.where("doc_id is null")).where("n_shingles >= 58").collect()]
    assert linked[None, 1] is not None and len(both) == 4 and len(set(both)) == 3

import hashlib
import random

import numpy as np

from inkwell.llm import exact_dedup as exact_dedup_module
from inkwell.llm.exact_dedup import build_filter, exact_dedup, merge_filters, read_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "É", "é", "ABC", "abc", "aBc ", "x" * 200_000] + [f"text {i}" for i in range(20)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    df = spark.createDataFrame([(i, t, "f", 0) for i, t in rows], "doc_id long, text string, fp string, n int").repartition(7)
    norm = {i: (t or "").translate(LOWER) for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())
    assert sorted(tuple(r) for r in exact_dedup(df).collect()) == want


def test_repeated_rows_keep_one_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    out = exact_dedup(df).collect()
    assert sorted(r.group_size for r in out) == [1, 3, 3, 3] and sum(r.kept for r in out) == 2
    assert exact_dedup(df.limit(0)).collect() == []


def test_filters_round_trip_and_merge_losslessly():
    rng, bits = np.random.default_rng(2), 64 - 6
    parts = []
    for n in (0, 1, 500):
        values, counts = np.unique(rng.integers(0, 1 << 58, n, dtype=np.uint64) & np.uint64((1 << 58) - 1), return_counts=True)
        counts = counts + rng.integers(0, 3, len(counts))
        parts.append((values, counts))
        got = read_filter(build_filter(values, counts, bits), bits)
        assert (got[0] == values).all() and (got[1] == counts).all()
    twice = merge_filters([build_filter(*parts[2], bits), build_filter(*parts[2], bits), build_filter(*parts[1], bits)], bits)
    assert twice[1].sum() == 2 * parts[2][1].sum() + parts[1][1].sum()


def test_a_third_of_rows_repeats_and_large_ranges(spark, monkeypatch):
    rows = [(None, "same")] * 100 + [(7, "Other")] * 50 + [(8, "other")] * 3 + [(i, f"text {i % 40}") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    monkeypatch.setattr(exact_dedup_module, "TASK_ROWS", 8)
    monkeypatch.setattr(exact_dedup_module, "RANGE_ROWS", 1)
    out = exact_dedup(df).collect()
    assert len(out) == len(rows)
    kept = sorted(((r.doc_id or -1), r.group_size) for r in out if r.kept)
    assert kept == sorted([(-1, 100), (8, 53)] + [(max(j for j in range(100, 200) if j % 40 == k), sum(j % 40 == k for j in range(100, 200))) for k in range(40)])

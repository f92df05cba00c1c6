"""Whitening against numpy on one machine."""

import numpy as np
import pytest

from inkwell.llm import whitening
from inkwell.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=256):
    """(vec_id, component) -> (n, deviation, whitened, explained), whitened up to its sign."""
    kept = [(i, np.array([float(np.float32(c)) for c in v])) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, np.floor(scale * v).astype(int)) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, [(i, c + 1, int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))), float((v - sums / n) @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum()) for i, v in x for c in range(min(k, len(sums)))]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 12)) * np.linspace(2, 0.4, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[4][1]) for i in range(150)] + [(None, rows[8][1]), (3, rows[8][1]), (3, rows[8][1])]
    return rows, [(2000, None), (2001, [float("nan")] * 12), (2002, [float("inf")] + [0.0] * 11), (2003, [None] + [0.0] * 11), (2004, [1.0] * 5), (2005, [])]


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_equal_to_numpy(spark, vectors, monkeypatch, block_rows):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block_rows)
    rows, odd = vectors
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).repartition(5)
    got = whiten(df).collect()
    n, want = brute(rows, 4)
    assert {r.n for r in got} == {n} and len(got) == len(want)
    signs = {}
    order = lambda x: (str(x[0]), x[1], x[2], abs(x[3]))
    for g, w in zip(sorted(((r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in got), key=order), sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and abs(abs(g[3]) - abs(w[3])) < 1e-9 and abs(g[4] / w[4] - 1) < 1e-9
        if abs(w[3]) > 1e-6:
            signs.setdefault(g[1], set()).add(np.sign(g[3]) == np.sign(w[3]))
    assert all(len(s) == 1 for s in signs.values())
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_rows_are_numbered_without_gaps(spark):
    out = whitening.indexed(spark.range(1000).repartition(7).where("id % 3 > 0"), "numbered")
    assert sorted(r.row for r in out.collect()) == list(range(666))


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e9, 3.0]), (2, [-1e9, 0.5]), (3, [7.0, -2.5])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).where("component = 1").collect()}
    _, want = brute(rows, 2)
    assert got == {w[0]: (w[2] if w[2] < 1 << 63 else None) for w in want if w[1] == 1}
    assert got[3] is not None and got[1] is None
    huge = whiten(spark.createDataFrame([(i, [3e38, 1.0 * i], 0) for i in range(5)] + [(9, [-3e38, 2.0], 0)], SCHEMA)).collect()
    assert len(huge) == 12 and {r.deviation for r in huge} == {None}


def test_no_spread_few_dimensions_and_empty(spark):
    df = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    same = whiten(df([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same)] == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whiten(df([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert len(line) == 6 and all((r.whitened is None) == (r.component == 2) for r in line)
    assert whiten(df([(1, None)])).collect() == whiten(df([(1, [1.0])]).limit(0)).collect() == []
    assert whiten(df([(1, [1.0])]).where("false").withColumnRenamed("label", "row")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    clash = whiten(df([(1, [1.0, 2.0]), (2, [2.0, 4.0])]).withColumnRenamed("label", "row").selectExpr("*", "1 as x", "2 as deviation"))
    assert clash.count() == 4

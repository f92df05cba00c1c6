"""The kept n-gram index, and lines and blocks of any outline, against plain loops."""

import math
import random

from inkwell.operators import gram_index as gi
from inkwell.operators import polygons as po


def test_phrases_are_found_without_shuffling_the_index(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abc日\U00020000") for _ in range(rng.randrange(0, 200)))) for i in range(40)] + [(100, "ab" * 60), (101, None), (102, "abab"), (None, "ababab")]
    phrases = [("p1", "ababab"), ("p2", "ab" * 8), ("p3", "ababa"), ("p4", "abab"), ("p5", docs[7][1][3:20]), ("p6", ""), ("p7", "x" * 9), ("p8", None)]
    texts, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(phrases, "q string, phrase string")
    index = gi.write_index(texts, "id", folder=str(tmp_path))
    want = sorted((q, i, k) for q, p in phrases for i, t in docs if p and len(p) >= 5 and t and i is not None for k in range(len(t)) if t.startswith(p, k))
    assert sorted(tuple(r) for r in gi.find_phrases(spark, index, asked, "q", "id").collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gi.find_phrases(spark, index, asked, "q", "id")._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in gi.find_phrases(spark, index, asked, "q", "id").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if index in x and "Scan" in x)
    depth = lambda x: len(x) - len(x.lstrip(" +-:|*()0123456789"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    join = next(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:join]) and any("Bucketed: true" in x for x in lines)
    spark.sql(f"drop table {index}")


def test_index_has_a_row_for_each_gram_of_a_block(spark, tmp_path):
    texts = spark.createDataFrame([(str(i), "abcdefgh" if i % 2 else "fghabcde") for i in range(100)] + [("x", "abcdefgh"), ("x", "abcdefgh")], "id string, text string").coalesce(1)
    rows = gi.postings(texts, "id").collect()
    assert len(rows) == 8 and sum(r["keys"] is not None for r in rows) == 1  # seven grams; none over the end of a text
    index = gi.write_index(texts, "id", folder=str(tmp_path))
    asked = spark.createDataFrame([(1, "cdefgh"), (2, "habcd"), (3, "hfgha"), (4, "efghabcdefg")], "q int, phrase string")
    got = sorted(map(tuple, gi.find_phrases(spark, index, asked, "q", "id").collect()))
    assert got == sorted([(1, str(i), 2) for i in range(1, 100, 2)] + [(1, "x", 2)] * 2 + [(2, str(i), 2) for i in range(0, 100, 2)])
    spark.sql(f"drop table {index}")


def test_index_is_no_larger_than_its_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(gi, "BLOCK_LETTERS", 3000)
    docs = [(i, "".join(rng.choice("abcd 日") for _ in range(rng.choice((3, 40, 400))))) for i in range(60)] + [(60, "abcab" * 50), (60, "abcab" * 50), (61, "")]
    texts = spark.createDataFrame(docs, "id long, text string").repartition(3)
    rows = gi.postings(texts, "id").where("keys is null").collect()
    assert sum(len(r.steps) for r in rows) <= sum(len(t) for _, t in docs) / 5 and len({r.block for r in rows}) >= 3
    index = gi.write_index(texts, "id", folder=str(tmp_path))
    cut = [t[k : k + n] for _, t in docs for n in (5, 8, 9, 10, 14, 33) for k in [rng.randrange(len(t) + 1)] if len(t) >= n]
    phrases = [(i, p) for i, p in enumerate([*cut, "abcab" * 5, "bcaba" * 2, "abcabd" * 2, "z" * 9, "aaaaz", docs[0][1] + docs[1][1]])] + [(None, "abcab" * 3)]
    asked = spark.createDataFrame([((q, "k"), p) for q, p in phrases], "q struct<i: int, k: string>, phrase string")
    got = sorted((-1 if r.q.i is None else r.q.i, r.id, r.start) for r in gi.find_phrases(spark, index, asked, "q", "id").collect())
    assert got == sorted((-1 if q is None else q, i, k) for q, p in phrases if len(p) >= 5 for i, t in docs for k in range(len(t)) if t.startswith(p, k))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    spark.sql(f"drop table {index}")


def polygon(rng, cx, cy, r):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(rng.randrange(3, 9)))
    return [(round(cx + r * math.cos(a)), round(cy + r * math.sin(a))) for a in turns]


def crosses(points, x, y):
    """Even-odd test by exact whole numbers, for points on no edge."""
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if (y1 < y) != (y2 < y) and ((x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)) * (1 if y2 > y1 else -1) > 0:
            odd = not odd
    return odd


def on_edge(points, x, y):
    return any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))


def frames(spark, lines, blocks):
    ls = spark.createDataFrame([(1, i, conf, *map(float, b)) for i, conf, b in lines], "page long, id long, conf double, x1 double, y1 double, x2 double, y2 double")
    bs = spark.createDataFrame([(1, kind, n, n, [{"x": x, "y": y} for x, y in ps]) for kind, n, ps in blocks], "page long, kind string, block long, pos long, points array<struct<x: int, y: int>>")
    return ls, bs


def test_lines_meet_polygons_as_in_plain_loops(spark):
    rng = random.Random(8)
    blocks = [(rng.choice(po.KINDS), n, polygon(rng, rng.randrange(1000), rng.randrange(1000), rng.randrange(40, 400))) for n in range(25)] + [("figure", 90, [(0, 0), (2000, 0), (2000, 2000), (0, 2000)])]
    lines = []
    while len(lines) < 300:
        x, y = rng.randrange(1100), rng.randrange(1100)
        if not any(on_edge(ps, x, y) for _, _, ps in blocks):
            lines.append((len(lines), rng.choice((0.05, 0.5)), (x - 3, y - 2, x + 3, y + 2)))

    def want(x, y):
        hits = [(po.KINDS.index(kind), n, kind) for kind, n, ps in blocks if kind in po.KINDS and (crosses(ps, x, y) if kind == "text_block" else min(p[0] for p in ps) <= x <= max(p[0] for p in ps) and min(p[1] for p in ps) <= y <= max(p[1] for p in ps))]
        return (min(hits)[2], min(hits)[1]) if hits else (None, None)

    ls, bs = frames(spark, lines, blocks)
    for cell in (64, 256, 5000):
        got = {r.id: (r.kind, r.block) for r in po.assign_by_kind(ls, bs, "page", cell=cell).collect()}
        assert got == {i: want(b[0] + 3, b[1] + 2) for i, conf, b in lines if conf >= 0.1}


def test_points_on_upright_and_level_edges_are_in(spark):
    ls, bs = frames(spark, [(i, 1.0, (x, y, x, y)) for i, (x, y) in enumerate([(0, 5), (10, 5), (5, 0), (5, 10), (0, 0), (11, 5), (5, 11)])], [("text_block", 1, [(0, 0), (10, 0), (10, 10), (0, 10)])])
    assert sorted(r.id for r in po.assign_by_kind(ls, bs, "page").collect() if r.block) == [0, 1, 2, 3, 4]


def test_blocks_go_into_blocks_and_take_their_lines(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    blocks = [("text_block", 0, square(100, 100, 50)), ("text_block", 1, square(90, 90, 100)), ("text_block", 2, square(0, 0, 400)), ("text_block", 3, square(1000, 0, 80)), ("text_block", 4, square(1001, 1, 80)), ("text_block", 5, square(200, 200, 20)), ("block_ad", 6, square(500, 500, 100)), ("text_block", 7, square(2000, 0, 60))]
    lines = [(1, 0.9, (110, 110, 120, 120)), (2, 0.9, (300, 300, 320, 320)), (3, 0.9, (540, 540, 560, 560)), (4, 0.9, (800, 800, 820, 820)), (5, 0.01, (110, 110, 120, 120)), (6, 0.9, (110, 130, 112, 140))]
    ls, bs = frames(spark, lines, blocks)
    assert {r.block: r.owner for r in po.absorbed(bs.where("kind = 'text_block'"), "page").collect()} == {0: 2, 1: 2, 2: 2, 3: 4, 4: 4, 5: 2, 7: 7}
    got = {(r.kind, r.block): (r.inner, r.lines) for r in po.nested_page(ls, bs, "page").collect()}
    assert got == {("text_block", 2): ([5], [1, 2]), ("text_block", 4): ([], []), ("block_ad", 6): ([], [3]), ("text_block", 7): ([], []), (None, None): ([], [4])}
    # the outline may stick out by the margin, not by more
    slant = [("text_block", 0, [(0, 0), (100, 0), (0, 100)]), ("text_block", 1, [(60, 60), (80, 60), (70, 70)]), ("text_block", 2, [(60, 60), (200, 60), (70, 70)])]
    pairs = {(r.inner, r.outer) for r in po.blocks_within(frames(spark, lines, slant)[1], "page").collect()}
    assert pairs == {(1, 0), (1, 2)}

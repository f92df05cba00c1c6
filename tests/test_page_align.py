"""Pages in a long text: the heaviest chain, and pages that are altered, empty, foreign or in decomposed form."""

import itertools
import random
import time
import unicodedata

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkwell.functions.arrays import letters, stretches
from inkwell.operators.page_align import align_pages, heaviest_chain
from inkwell.plans import catalog as plans

PAGES = ["天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏", "閏餘成歲律呂調陽雲騰致雨露結爲霜金生麗水玉出崑岡", "劍號巨闕珠稱夜光果珍李柰菜重芥薑海鹹河淡鱗潛羽翔"]


def test_heaviest_chain_equals_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(0, 8)
        order, place, weight = ([rng.randrange(k) for _ in range(n)] for k in (5, 6, 4))
        weight = [w + 1 for w in weight]
        rises = lambda c: all(order[a] < order[b] and place[a] < place[b] for a, b in zip(c, c[1:]))  # noqa: B023, B905, E731
        best = max((sum(weight[i] for i in c) for k in range(n + 1) for c in itertools.permutations(range(n), k) if rises(c)), default=0)
        got = heaviest_chain(np.array(order, np.int64), np.array(place, np.int64), np.array(weight, float)).tolist()
        assert rises(got) and sum(weight[i] for i in got) == best


def aligned(spark, docs):
    """docs: {doc: (pages, text)}"""
    pages = spark.createDataFrame([(d, i + 1, t) for d, (ps, _) in docs.items() for i, t in enumerate(ps)], "doc long, page int, text string")
    texts = spark.createDataFrame([(d, t) for d, (_, t) in docs.items()], "doc long, text string")
    out = {}
    for r in sorted(align_pages(pages, texts, "doc").collect(), key=lambda r: (r.doc, r.page)):
        out.setdefault(r.doc, []).append(r)
    return out


def test_pages_of_short_documents(spark):
    full, other = "".join(PAGES), "完全不同的文字" * 4
    docs = {
        1: (PAGES, full), 2: (PAGES, unicodedata.normalize("NFD", full)), 3: ([PAGES[0], PAGES[1].replace("騰", "★"), PAGES[2]], full), 4: ([PAGES[0], "", PAGES[2]], full), 5: ([PAGES[0], other, PAGES[2]], full),
        6: ([full], full), 7: (["한글만"], "한글만 있는 텍스트"), 8: (["★" * 15 + PAGES[0][15:], *PAGES[1:]], full), 9: (PAGES, " , ".join(f"가나 {x[:12]}。 {x[12:]}" for x in PAGES)), 10: (["天地", None], None), 11: (["海鹹河"], full),
    }
    got = aligned(spark, docs)
    for d in (1, 2):
        assert [(r.start, r.end) for r in got[d]] == [(0, 21), (21, 45), (45, 72)] and all(r.confidence == 1.0 for r in got[d])
        assert [r.matched_text for r in got[d]] == [full[:21], full[21:45], full[45:]]
    assert [(r.start, r.end) for r in got[3]] == [(0, 21), (21, 45), (45, 72)] and 0.8 < got[3][1].confidence < 1
    assert got[4][1].confidence == 0 and got[4][1].matched_text and got[4][1].anchor == ""
    assert got[5][0].confidence >= 0.8 and got[5][2].confidence >= 0.5 and got[5][1].confidence < 0.6
    assert (got[6][0].start, got[6][0].end, got[6][0].confidence) == (0, 72, 1.0)
    assert [(r.page, r.matched_text, r.confidence) for r in got[7]] == [(1, "한글만 있는 텍스트", 0.0)]
    assert got[8][0].confidence > 0 and [r.confidence for r in got[8][1:]] == [1.0, 1.0]
    assert all(r.confidence == 1.0 for r in got[9]) and got[9][1].matched_text.endswith("玉出崑岡") is False and "閏餘" in got[9][0].matched_text + got[9][1].matched_text
    assert [r.matched_text for r in got[10]] == [""] and got[11][0].matched_text == full


def test_one_long_document(spark):
    rng = random.Random(5)
    pages = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(50, 120))) for _ in range(300)]
    text = "".join(pages)
    ends = np.cumsum([len(p) for p in pages])
    altered = ["".join("〇" if rng.random() < 0.08 else c for c in p) for p in pages]
    altered[100:103] = ["", "二三四五六七八九十百", pages[250]]  # lost, foreign, and a copy of a later page
    got = aligned(spark, {1: (altered, text)})[1]
    middle = [int(e) - len(p) + len(p) // 2 - 7 for e, p in zip(ends, pages, strict=True)]
    near = [abs(r.start - (middle[i - 1] + middle[i]) // 2) <= 40 for i, r in enumerate(got) if i and not 98 < i < 106]
    assert sum(near) >= 0.97 * len(near)
    assert sum(r.confidence > 0.6 for r in got) > 270 and got[250].confidence > 0.6


def test_of_equally_heavy_chains_the_one_with_earlier_places():
    chain = lambda order, place: heaviest_chain(np.array(order, np.int64), np.array(place, np.int64), np.ones(len(order))).tolist()
    assert chain([0, 1, 1, 2], [0, 5, 9, 12]) == [0, 1, 3] and chain([0, 0, 1, 2, 2], [7, 2, 8, 20, 11]) == [1, 2, 4]


def both(spark, path, name, turns):
    """The rows of a query over conversations, and of its SQL."""
    pd.DataFrame(turns, columns=["conv_id", "turn", "text"]).to_parquet(path / "conversations.parquet")
    pd.DataFrame({"n_nationkey": [0]}).to_parquet(path / "nation.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = con.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, plans.QUERIES[name](spark, str(path)).select(*columns).collect())), sorted(want.fetchall())


def test_chained_pages_of_repeated_anchors_equal_their_sql(spark, tmp_path):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    said = [word(n) for n in (60, 200, 200, 15, 20, 9, 14, 31, 40)]
    middle = [t[len(t) // 2 - 7 :][:15] for t in said]
    said[1] = said[1][:150] + middle[1] + said[1][165:]  # again behind itself
    said[2] = said[2][:40] + middle[2] + said[2][55:]  # and before itself
    turns = [(1, k, t) for k, t in enumerate(said)] + [(2, 0, "abcdeabcdeabcde" * 2), (2, 1, "abcdeabcdeabcde"), (2, 2, word(50)), (3, 0, "E, é 1. " * 9), (3, 1, "Ééé e é e.")]
    got, want = both(spark, tmp_path, "chained_pages", turns)
    assert got == want


def test_altered_blocks_of_repetitive_texts_equal_their_sql(spark, tmp_path):
    rng = random.Random(11)
    drawn = ["".join(rng.choice(letters_) for _ in range(n)) for letters_ in ("ab", "éea", "abcdefgh") for n in (30, 89, 200)]
    said = ["ción" * 40, "tion the " * 30, "ab" * 15, "abcdefg" * 13, "e" * 100, "é" * 45 + "e" * 60, "a~b" * 50, "ab cd." * 4, *drawn]
    got, want = both(spark, tmp_path, "page_alignment_altered", [(k, 0, t) for k, t in enumerate(said)])
    assert got == want and len({r[3] for r in got}) > 6 and sum(r[5] < 0.85 for r in got) > 3


def test_stretches_split_a_text_once(spark):
    rows = spark.createDataFrame([("ab" * 30_000,)], "t string")
    began = time.time()
    assert rows.select(F.size(F.array_distinct(stretches(letters(F.col("t")), 5))), F.size(stretches(letters(F.col("t")), 5))).first() == (2, 59_996)
    assert time.time() - began < 30

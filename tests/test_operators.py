from pyspark.sql import functions as F

from inkwell.operators import alignment as al
from inkwell.operators import dictionary as di
from inkwell.operators import layout as la
from inkwell.operators import lineage as li
from inkwell.operators import records as rc
from inkwell.operators import spans as sp
from inkwell.operators import texts as tx
from inkwell.operators import usage as us


def one(df):
    return [tuple(r) for r in df.collect()]


def test_marks_render_in_place_and_out_of_range_ones_go(spark):
    texts = spark.createDataFrame([("b", "王戎簡要"), ("c", "x"), ("d", None)], "block string, text string")
    marks = spark.createDataFrame([("b", 0, 0, 1, "《", "》"), ("b", 1, 3, 3, None, "。"), ("b", 2, 9, 9, "!", "!"), ("b", 3, 1, 1, None, "，")], "block string, seq int, start int, end int, before string, after string")
    out = dict(one(sp.render_marks(texts, marks, "block")))
    assert out == {"b": "《王戎》，簡要。", "c": "x", "d": None}


def test_sentences_have_a_tail_and_count_code_points(spark):
    df = spark.createDataFrame([("𠀀一。二",), ("",), ("三？",)], "text string").select(sp.split_sentences(F.col("text")).alias("s"))
    assert [[tuple(x) for x in r.s] for r in df.collect()] == [[(0, 0, 2), (1, 3, 3)], [], [(0, 0, 1)]]


def test_alignment_names_pairs_from_the_ocr_side(spark):
    df = spark.createDataFrame([(1, "abcX", "abYcd"), (2, "", "a"), (3, "裵楷", "裴楷"), (4, None, None)], "id int, ocr string, ref string")
    pairs = df.select("id", F.inline(al.align_chars("ocr", "ref")))
    variants = spark.createDataFrame([("裴", "裵")], "a string, b string")
    out = {r.id: r for r in al.alignment_stats(al.relabel_variants(pairs, variants), "id").collect()}
    assert (out[3].n_variant, out[3].n_exact, out[3].accuracy) == (1, 1, 1.0) and out[2].n_deletion == 1 and 4 not in out
    for r in out.values():
        ocr = {1: "abcX", 2: "", 3: "裵楷"}[r.id]
        assert r.n_exact + r.n_variant + r.n_mismatch + r.n_insertion == len(ocr)


def test_best_window_finds_and_falls_back(spark):
    df = spark.createDataFrame([("needle text here", "some hay before needle text hero and after"), ("qqq", "nothing alike")], "n string, t string")
    a, b = df.select(al.best_window("n", "t").alias("w")).select("w.*").collect()
    assert (a.start, b.start, b.length) == (16, 0, 13) and a.ratio > 0.9 and b.ratio < 0.3


def test_best_window_looks_at_every_place(spark):
    import difflib
    import random

    rng, size = random.Random(3), 24
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    decoys = "the king of nothing at all, " * 90
    far = ("the king of the old hill and his men", decoys + "the king of the old hell and his men" + " rest")
    bare = ("abXcdXefXghXabXcdXefXghX", word(300) + "abYcdYefYghYabYcdYefYghY" + word(50))
    rows = [far, bare, *((word(size), word(rng.choice((30, 80, 200)))) for _ in range(12))]
    got = [tuple(r.w) for r in spark.createDataFrame(rows, "n string, t string").coalesce(1).select(al.best_window("n", "t").alias("w")).collect()]
    assert got[0][:2] == (len(decoys), len(far[0])) and abs(got[1][0] - 300) < 2
    alike = lambda n, part: difflib.SequenceMatcher(None, n, part).ratio()
    for (n, t), (start, length, ratio) in zip(rows[1:], got[1:], strict=True):
        windows = [(alike(n, t[s : s + len(n)]), -s) for s in range(len(t) - len(n) + 1)]
        best, back = max(windows)
        low, high = max(0, -back - 2), min(len(t), -back + len(n) + 2)
        want = (0, len(t)) if best < 0.3 else (low, high - low) if alike(n, t[low:high]) > best else (-back, len(n))
        probes = [p for k in (5, 3) for p in (n[:k], n[len(n) // 2 : len(n) // 2 + k], n[-k:])]
        assert (start, length) == want or (any(p in t for p in probes) and ratio <= max(alike(n, t[max(0, s - 2) : s + len(n) + 2 * k]) for s in range(len(t)) for k in (0, 1)))
    short = spark.createDataFrame([("abc", "abcd"), ("abcd", "abc"), ("", "abc"), ("abc", None)], "n string, t string").select(al.best_window("n", "t").alias("w")).collect()
    assert [(r.w.start, r.w.length) for r in short] == [(0, 3), (0, 3), (0, 3), (0, 0)]


def test_altered_pages_are_mapped(spark):
    import random

    rng = random.Random(4)
    page = lambda: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(80))
    true = [page() for _ in range(8)]
    true[1] = true[1][:10] + true[3][32:47] + true[1][25:]
    whole, pages = "".join(true), list(true)
    pages[2] = "".join("x" if i % 15 == 7 else c for i, c in enumerate(true[2]))
    pages[4], pages[6] = "", "y" * 80
    pages[5] = "".join("x" if i % 4 == 3 else c for i, c in enumerate(true[5]))
    pages[5] = pages[5][:65] + "".join("z" if i in (4, 9) else c for i, c in enumerate(true[5][65:]))
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)] + [(2, 0, None)], "d long, page int, text string")
    out = sorted(one(al.map_pages(rows, spark.createDataFrame([(1, whole), (2, "")], "d long, text string"), "d")))
    assert [r[2] for r in out] == [0, 80, 160, 240, 320, 400, 480, 560, 0]
    assert out[0][3] == 1.0 and out[4][3] == out[6][3] == 0.0 and 0 < out[5][3] < out[2][3] < 1.0


def test_pages_that_stand_within_earlier_pages_are_mapped():
    import random
    import re

    rng = random.Random(5)
    page = lambda n: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(n))
    first, short = page(154), page(11)
    for texts in ([first, "X" + first[36:73], page(80)], [first, first[30:], first], [page(60), short, short, page(20)], ["E" * 20, page(12), "E" * 20], ["ab" * 9, "ab" * 9]):
        altered = [re.sub("(?s)(.{14}).", r"\1~", t) for t in texts]
        placed = al._place_pages(altered, "".join(texts), 15)
        assert [start for start, _ in placed] == [sum(map(len, texts[:i])) for i in range(len(texts))]
        assert all(confidence > 0.6 for _, confidence in placed)


def test_corrections_apply_from_the_end_and_skip_stale_ones(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "zz")], "id int, text string")
    patches = spark.createDataFrame([(1, 1, "b", "X"), (1, 3, "d", "YY"), (1, 2, "q", "!"), (1, None, "a", "!")], "id int, char_index int, original string, corrected string")
    assert sorted(one(tx.apply_corrections(texts, patches, "id"))) == [(1, "aXcYY", 2), (2, "zz", 0)]


def test_script_classes_carry_forward(spark):
    df = spark.createDataFrame([(1, "123\n天地玄黃\n - \n하늘과 땅\n\n天하늘하늘")], "id int, text string")
    rows = tx.classify_lines(tx.lines_of(df, "id"), "id").orderBy("line_no").collect()
    assert [r["class"] for r in rows] == ["original", "original", "original", "translation", "translation", "translation"]
    assert one(tx.split_by_class(tx.classify_lines(tx.lines_of(df, "id"), "id"), "id"))[0][1] == "123\n天地玄黃\n - "


def test_cleaning_keeps_places_of_marks_and_glosses(spark):
    df = spark.createDataFrame([("，天地는 玄黃。",), (None,)], "t string").select(al.clean_text("t", F.lit("，。"), F.lit(True)).alias("c"))
    a, b = (r.c for r in df.collect())
    assert (a.clean, [(m.pos, m.text) for m in a.marks], [(g.pos, g.text) for g in a.glosses]) == ("天地玄黃", [(0, "，"), (3, "。")], [(1, "는")])
    assert b.clean == ""


def test_markers_split_a_page(spark):
    df = spark.createDataFrame([(1, "[본]a [주] b"), (2, " plain ")], "id int, text string")
    assert sorted(one(tx.split_by_markers(df, r"\[[본주]\]", "id"))) == [(1, 0, "[본]", "a"), (1, 1, "[주]", "b"), (2, 0, None, "plain")]


def test_substring_join_equals_plain_search(spark):
    texts = [(1, "aa bb cc dd ee aa bb cc dd"), (2, "xaa bb cc ddy"), (3, "bb"), (4, ""), (5, None), (6, "aaa")]
    words = ["aa bb cc dd", "bb cc dd", "bb cc", "bb", "a", "aa"]
    out = one(di.substring_join(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "headword string"), "id"))
    want = [(i, w, k, k + len(w) - 1) for i, t in texts for w in words for k in range(len(t or "")) if (t or "").startswith(w, k)]
    assert sorted(out) == sorted(want)


def test_as_of_falls_back_to_the_oldest(spark):
    later = spark.createDataFrame([("g", 5, "i1"), ("g", 1, "i0"), ("h", 3, "i2")], "g string, ts int, id string")
    earlier = spark.createDataFrame([("g", 5, "o5"), ("g", 3, "o3"), ("g", 6, "o6")], "g string, ts int, id string")
    assert sorted((r.id, r.linked, r.preceded) for r in li.as_of_link(later, earlier, "g", "ts", "id").collect()) == [("i0", "o3", False), ("i1", "o5", True), ("i2", None, False)]


def test_trailer_takes_the_last_line(spark):
    df = spark.createDataFrame([("s\n\nKey: a\nKey:  b ",), ("none",), (None,)], "m string")
    subjects = spark.createDataFrame([("L4: fix L6 and L4 gloss\nL2",), ("none",)], "m string")
    assert [r[0] for r in subjects.select(li.layers_of(F.col("m"), ("gloss", "other"))).collect()] == [["L4", "L6", "L4_gloss", "L6_gloss"], ["unknown"]]
    assert [r[0] for r in df.select(li.trailer(F.col("m"), "Key")).collect()] == ["b", None, None]


def test_dependencies_stay_changed_and_settled(spark):
    tracked = spark.createDataFrame([("a", "1", "unchanged"), ("b", "1", "unchanged"), ("c", "1", "acknowledged"), ("d", "1", "changed"), ("e", "1", "unchanged")], "path string, hash_at_base string, status string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash_now string")
    assert dict(one(li.check_dependencies(tracked, now, "path"))) == {"a": "unchanged", "b": "changed", "c": "acknowledged", "d": "changed", "e": "changed"}


def test_upsert_drops_new_rows_without_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert sorted(one(rc.upsert(old, new, "k", ["v"]))) == [(1, "a", "kept"), (2, "B", "replaced"), (3, "C", "added")]


def test_dangling_is_silent_when_nothing_is_known(spark):
    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "block string")
    known = spark.createDataFrame([("y",)], "block string")
    assert one(rc.dangling(rows, "block", known, "L5")) == [("L5", "x", 2)] and one(rc.dangling(rows, "block", known.limit(0), "L5")) == []


def test_nms_keeps_the_most_confident(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "b", 0.8, 1.0, 1.0, 10.0, 10.0), (1, "c", 0.7, 20.0, 0.0, 30.0, 10.0)], "page int, id string, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.id for r in la.non_max_suppression(df, ["page"]).collect()) == ["a", "c"]


def test_xy_cut_reads_columns_from_the_right(spark):
    rows = [(1, 1, 60.0, 0.0, 100.0, 40.0), (1, 2, 60.0, 50.0, 100.0, 90.0), (1, 3, 0.0, 0.0, 40.0, 40.0), (1, 4, 0.0, 50.0, 40.0, 90.0)]
    df = spark.createDataFrame(rows, "page long, id long, x1 double, y1 double, x2 double, y2 double")
    assert [r.id for r in la.xy_cut(df, "page").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_json_salvage(spark):
    raw = ['<think>{"a"</think>```json\n{"a": 1}\n```', '[{"k": 1}, {"k": 2}, {"k":', "no json", None, 'text {"s": "a\nb"} tail']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(al.salvage_json("raw").alias("j"))
    assert [r.j for r in df.collect()] == ['{"a": 1}', '[{"k": 1}, {"k": 2}]', None, None, '{"s": "a\\nb"}']


def test_adjacent_duplicates_compare_with_the_last_kept(spark):
    rows = [(1, 1, 1, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 2, 2, 0.9, 0.5, 0.0, 10.0, 10.0), (1, 3, 3, 0.1, 0.0, 0.0, 10.0, 9.5), (1, 4, 4, 0.1, 50.0, 0.0, 60.0, 10.0), (2, 5, 1, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "page long, id long, rank int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.id for r in la.drop_adjacent(df, "page").collect()) == [2, 4, 5]


def test_medians_are_exact_without_gathering(spark):
    import random
    from statistics import median

    rng = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 4.0], "same": [7.0] * 3000, "many": [rng.random() for _ in range(30_001)], "even": [float(rng.randrange(50)) for _ in range(20_000)], None: [1.0, 2.0, 9.0], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    assert dict(one(us.medians(df, "k", "v"))) == {k: median(vs) for k, vs in groups.items() if vs}
    stats = {r.k: (r.num, r.median) for r in us.timing_stats(df, "k", "v").collect()}
    assert stats["none"] == (0, None) and stats["two"] == (2, 2.5) and stats[None] == (3, 2.0)


def test_every_line_is_put_into_a_block(spark, tmp_path):
    import duckdb
    import pandas as pd

    from inkwell.plans import catalog as plans

    # order, number, part, supplier, status: two lines of one box, one number with two boxes, one line twice, a page without blocks
    rows = [(1, 1, 5, 7, "O"), (2, 1, 5, 7, "O"), (3, 2, 8, 9, "O"), (3, 2, 20, 30, "O"), (4, 3, 6, 2, "O"), (4, 3, 6, 2, "O"), (9, 1, 5, 7, "O"), (5, 1, 5, 7, "F"), (6, 2, 21, 30, "F")]
    table = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"]).astype({"l_linenumber": "int32"})
    table.assign(l_quantity=9.0).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = sorted(map(tuple, plans.QUERIES["line_to_block"](spark, str(tmp_path)).select("page", "line", "block", "how").collect()))
    assert [r[1] for r in got] == [9, 17, 26, 26, 35, 35, 73]
    assert got == sorted(con.execute(f"SELECT page, line, block, how FROM ({plans.SQL['line_to_block']})").fetchall())

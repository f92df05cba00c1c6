"""Plans and kernels whose cost has to follow the input: no estimate, batch or page may make one step hold it all."""

import difflib
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions.likeness import ratio
from inkwell.functions.tasks import ROWS_A_TASK, dealt
from inkwell.operators import alignment as al
from inkwell.operators import layout as la
from inkwell.operators import order as od
from inkwell.operators import parsing as ps
from inkwell.operators import polygons as po
from inkwell.operators import records as rc
from inkwell.operators import stewardship as st
from inkwell.operators import variants as va
from inkwell.plans import catalog as plans
from inkwell.sources import packages as pk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wanted_pages_are_not_broadcast(spark):
    wanted = spark.range(3).selectExpr("id as doc", "'v1' as part_id", "explode(array(0, 1)) as page_num")
    files = spark.createDataFrame([(0, "page_001.png"), (1, "x_p0000.JPG"), (2, "v1_page_001.tif")], "doc long, name string")
    out = st.page_image(wanted, files)
    assert "BroadcastHashJoin" not in plan_of(out)
    assert {(r.doc, r.page_num): r.name for r in out.collect() if r.name} == {(0, 1): "page_001.png", (1, 0): "x_p0000.JPG", (2, 1): "v1_page_001.tif"}


def test_texts_of_a_batch_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(al, "PIECE_LETTERS", 10)
    texts = ["abcd", None, "e" * 30, "", "fghij", "klmno", "p"]
    got = list(al.pieces(pd.Series(texts)))
    assert [(s.start, s.stop) for s in got] == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert all(sum(len(t or "") for t in texts[s]) <= 10 or len([t for t in texts[s] if t]) == 1 for s in got)
    assert list(al.pieces(pd.Series([], dtype=object))) == []
    sizes = [len(x) for x in al.clean_text.func(iter([(pd.Series(texts), pd.Series(["."] * 7), pd.Series([True] * 7))]))]
    assert sizes == [2, 1, 3, 1]


def test_lines_and_blocks_of_a_page_make_no_pairs(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, 8.0, 8.0, 9.0, 9.0), (1, 2, 1.0, 1.0, 2.0, 2.0), (2, 3, 0.0, 0.0, 1.0, 1.0)], "page int, line int, x1 double, y1 double, x2 double, y2 double")
    blocks = spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 5.0, 5.0), (1, "b", 0, 1.0, 1.0, 4.0, 4.0), (1, "c", 2, 30.0, 0.0, 31.0, 1.0)], "page int, block string, pos int, x1 double, y1 double, x2 double, y2 double")
    out = la.assign_lines(lines, blocks, "page")
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a", "inside"), (1, 2, "b", "inside"), (2, 3, "unmatched", "none")]
    join = next(i for i, x in enumerate(plan_of(out).splitlines()) if "Join" in x)
    assert any("collect_list" in x for x in plan_of(out).splitlines()[join:])


def test_an_item_is_read_once(spark):
    xml = """<item><dc:title>a &amp; b<i>x</i>tail</dc:title><dc:title>second</dc:title><dc:subject xsi:type="dcndl:NDC9">9</dc:subject><dc:subject>s1<!-- c -->s2</dc:subject>
      <dc:identifier xsi:type="dcndl:ISBN">1</dc:identifier><dc:identifier xsi:type="dcndl:ISBN">2</dc:identifier><dcndl:materialType rdfs:label="">m</dcndl:materialType><rdfs:seeAlso rdf:resource="u"/><box><dc:creator>no</dc:creator></box></item>"""
    rows = spark.createDataFrame([(1, xml), (2, "<other><dc:title>t</dc:title></other>"), (3, ""), (4, None)], "id int, xml string")
    out = rows.select("id", ps.search_item(F.col("xml")).alias("i"))
    assert "xpath" not in plan_of(out) and plan_of(out).count("search_item(") >= 1
    one = lambda tag, more="": F.try_element_at(F.xpath("xml", F.lit(f"/item/*[name()='{tag}'{more}]/text()")), F.lit(1))
    want = rows.select("id", one("dc:title").alias("title"), one("dc:creator").alias("creator"), F.xpath("xml", F.lit("/item/*[name()='dc:subject' and not(@*)]/text()")).alias("subjects")).collect()
    got = {r.id: r.i for r in out.collect()}
    assert [(got[r.id].title, got[r.id].creator, got[r.id].subjects) for r in want] == [(r.title, r.creator, r.subjects) for r in want]
    assert (got[1].title, got[1].isbn, got[1].ndc9, got[1].material, got[1].see_also) == ("a & b", "2", "9", "m", "u")


def test_pages_of_the_same_boxes_are_worked_out_once():
    seen = []
    page = lambda *boxes: [dict(zip(od.SIDES, b, strict=True)) for b in boxes]
    places = od._per_page(lambda b: seen.append(len(b)) or list(range(len(b)))).func
    one, two = page((0, 0, 1, 1), (2, 0, 3, 1)), page((0, 0, 1, 1), (2, 0, 3, 2))
    assert places(pd.Series([one, two, one, [], one])).tolist() == [[0, 1], [0, 1], [0, 1], [], [0, 1]] and seen == [2, 2, 0]


def test_boxes_are_tried_before_outlines(spark):
    square = lambda a, n: [(a, a), (a + n, a), (a + n, a + n), (a, a + n)]
    blocks = spark.createDataFrame([(1, 1, square(0, 300)), (1, 2, square(50, 20)), (1, 3, square(320, 30)), (1, 4, square(290, 10))], "page int, block int, points array<struct<x: int, y: int>>")
    out = po.blocks_within(blocks, "page")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1), (1, 4, 1), (1, 4, 3)]
    assert "i_x1" in plan_of(out)


def test_blocks_meet_by_page_without_a_row_for_each_cell(spark, tmp_path):
    square = lambda a, n: [(a, a), (a + n, a), (a + n, a + n), (a, a + n)]
    rows = [(1, 1, square(0, 100_000)), (1, 2, square(50, 20)), (1, 2, square(600, 20)), (None, 3, square(0, 900)), (None, 4, square(1, 1)), (2, 5, []), (2, 6, square(-30, 9)), (2, 7, square(0, 9)), (2, None, square(0, 9)), (3, 8, None)]
    out = po.blocks_within(spark.createDataFrame(rows, "page int, block int, points array<struct<x: int, y: int>>"), "page")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1), (1, 2, 1), (2, 6, 7), (2, 7, 6)]
    assert "Generate" not in plan_of(out)
    table = pd.DataFrame([(k // 9, k % 4, k * 7, k * 3, 5.0 + k % 40) for k in range(900)], columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    table.to_parquet(tmp_path / "lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = plans.QUERIES["blocks_in_blocks"](spark, str(tmp_path))
        assert plan_of(out).count("Exchange hashpartitioning(page") == plan_of(out).count("REPARTITION_BY_NUM") == 2  # of which one is read again
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        assert sorted(map(tuple, out.collect())) == sorted(con.execute(plans.SQL["blocks_in_blocks"]).fetchall())
        assert plan_of(out).count("ReusedExchange") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_texts_are_not_matched_letter_by_letter(spark, monkeypatch):
    text = "一二三 abc " * 40
    monkeypatch.setattr(al.difflib, "SequenceMatcher", lambda *a: (_ for _ in ()).throw(AssertionError("matched")))
    assert al.align_counts.func(pd.Series([text, None]), pd.Series([text, ""])).iloc[:, :4].to_numpy().tolist() == [[320, 320, 0, 0], [0, 0, 0, 0]]
    assert al._window("三 abc 一", "x" + text) == (3, 7, 1.0)
    monkeypatch.undo()
    assert difflib.SequenceMatcher(None, text, text).get_opcodes() == [("equal", 0, 320, 0, 320)]


def test_pages_of_as_many_boxes_are_worked_out_together(spark):
    seen = []
    kernel = lambda b: seen.append(b.shape) or np.tile(np.arange(b.shape[1]), (len(b), 1))
    side = pa.array([[1.0, 2.0], [], [3.0], [4.0, 5.0]])
    assert od._by_size(side, side, side, side, kernel).to_pylist() == [[0, 1], [], [0], [0, 1]] and sorted(seen) == [(1, 1, 4), (2, 2, 4)]
    notes = [(1, 1, 1, 0, 0, 9, 30), (1, 2, 2, 9, 0, 18, 30), (1, 3, 3, 17, 0, 26, 30), (2, 1, 1, 0, 0, 9, 30), (3, 1, 1, 0, 0, 9, 30), (3, 2, 2, 50, 0, 59, 30), (3, 3, 3, 9, 0, 18, 30)]
    out = od.inline_groups(spark.createDataFrame(notes, "page int, id int, pos int, x1 int, y1 int, x2 int, y2 int"), ["page"])
    assert sorted((r.page, r.id, r.seed, r.nth) for r in out.collect()) == [(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 3, 1), (2, 1, 1, 1), (3, 1, 1, 1), (3, 2, 2, 1), (3, 3, 1, 2)]


def test_lines_in_bands_need_no_comparator(monkeypatch):
    boxes = np.array([[[50, 0, 58, 30], [0, 40, 8, 70], [1, 0, 9, 30]], [[0, 0, 8, 30], [2, 40, 10, 70], [4, 0, 12, 30]]], float)
    want = [od.in_bands(-b[:, 0], b[:, 1], 8 * od.SAME_COLUMN) for b in boxes]
    tried = []
    monkeypatch.setattr(od, "in_bands", lambda *a, f=od.in_bands: tried.append(1) or f(*a))
    assert od._line_orders(boxes).tolist() == want and len(tried) == 1  # the second page's columns run into each other


def test_ratio_is_that_of_difflib():
    r = random.Random(2)
    for n in (0, 1, 5, 90, 199, 200, 201, 330):
        for letters in ("ab", "abcdefghij klmnop", "etaoinshrdlu cmfwyp" * 4 + "qzxjkvbgあ"):
            b = "".join(r.choice(letters) for _ in range(n))
            for a in (b, b[3:] + "xy", b.replace("e", "é").replace("a", "ä"), b[::-1], ""):
                assert ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_rows_of_packages_are_handed_on_together(spark, monkeypatch):
    files = spark.createDataFrame([(i, [f"a & <{i}>", "b"], ["n"] if i % 2 else None) for i in range(50)], "id int, s array<string>, notes array<string>").coalesce(1)
    made = pk.packages_of(files, F.col("id").cast("string"), F.col("s"), F.col("notes"))
    out = pk.parse_packages(made).coalesce(1)
    got = sorted((int(r.path), r.kind, r["index"], r.text) for r in out.collect())
    assert got == sorted([(i, "section", j, x) for i in range(50) for j, x in enumerate((f"a & <{i}>", "b"))] + [(i, "footnote", 1, "n") for i in range(1, 50, 2)])
    assert "MapInArrow" in plan_of(out)


def test_pairs_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    assert dealt(spark.range(3), 9 * ROWS_A_TASK, "id").rdd.getNumPartitions() == 9 and dealt(spark.range(3), 3, "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr("inkwell.functions.tasks.ROWS_A_TASK", 2)
    groups = spark.createDataFrame([(list(range(6)),), ([1, 1, 2],), (None,)], "chars array<int>")
    out = rc.variant_pairs(groups, "chars", spark.createDataFrame([(2, 1), (0, 9)], "a int, b int"))
    assert sorted(map(tuple, out.collect())) == [(i, j) for i in range(6) for j in range(i + 1, 6) if (i, j) != (1, 2)]
    assert out.rdd.getNumPartitions() == 8  # 16 pairs
    files = spark.createDataFrame([(i, "a,b\nb,a\nc,d\nalone\n") for i in range(20)], "file int, text string")
    new, report = va.import_variants(files, spark.createDataFrame([("b", "a")], "a string, b string"), "csv")
    assert sorted(map(tuple, new.collect())) == [(i, "c", "d") for i in range(20)]
    assert {(r.added, r.skipped, len(r.errors)) for r in report.collect()} == {(1, 2, 1)} and report.count() == 20
    assert "hashpartitioning(file" in plan_of(report) and ", 23), REPARTITION_BY_NUM" in plan_of(report)

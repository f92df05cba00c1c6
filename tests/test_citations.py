"""Citations resolved across layers, and variants imported from files."""

from inkwell.operators import citations as ci
from inkwell.operators import variants as va

MARK = "mark string, doc string, page int, block string, start int, end int, snapshot string"
TRANSLATION = "doc string, page int, block string, seq int, id string, start int, end int, source_text string, translation string, language string, status string"
NOTE = "doc string, page int, block string, seq int, id string, start int, end int, type string, label string, description string"


def test_a_mark_brings_all_layers(spark):
    text = "王戎簡要裴楷清通孔明臥龍"
    marks = [("m1", "d1", 1, "tb1", 0, 3, "王戎簡要"), ("m2", "d1", 1, "lay", 4, 99, "other"), ("m3", "d1", 1, "tb1", 50, 60, "x"), ("m4", "d9", 1, "none", 0, 1, ""), ("m5", "d1", 1, "tb1", 4, 7, None), ("m6", "d1", 1, "tb1", 5, 2, None)]
    punctuation = [("tb1", 1, 3, 3, None, "，"), ("tb1", 2, 7, 7, None, "。"), ("tb1", 3, 0, 1, "《", "》"), ("tb1", 4, 3, 4, "x", "y")]
    translations = [("d1", 1, "tb1", 2, "t2", 2, 5, None, "b", None, None), ("d1", 1, "tb1", 1, "t1", 0, 0, "王", "a", "en", "accepted"), ("d1", 2, "tb1", 3, "t3", 0, 9, "", "other page", None, None), ("d1", 1, "lay", 1, "t4", 0, 3, "", "before", None, None)]
    notes = [("d1", 1, "tb1", 1, "n1", 3, 3, "person", "l", None), ("d1", 1, "tb1", 2, "n2", 4, 4, None, None, None)]
    out = ci.resolve(
        spark.createDataFrame(marks, MARK), spark.createDataFrame([("tb1", text)], "block string, text string"), spark.createDataFrame([("d1", 1, "page " + text)], "doc string, page int, text string"),
        spark.createDataFrame(punctuation, "block string, seq int, start int, end int, before string, after string"), spark.createDataFrame(translations, TRANSLATION), spark.createDataFrame(notes, NOTE),
        spark.createDataFrame([("d1", "蒙求", "李瀚")], "doc string, title string, author string"), width=2,
    )
    got = {r.mark: r for r in out.collect()}
    assert len(got) == 6
    m1 = got["m1"]
    assert (m1.original, m1.punctuated, m1.block_text, m1.text_changed, m1.bibliography.title) == ("王戎簡要", "《王戎》簡要，", text, False, "蒙求")
    assert [tuple(x) for x in m1.translations] == [("t1", "王", "a", "en", "accepted"), ("t2", "", "b", "ko", "draft")] and [tuple(x) for x in m1.annotations] == [("n1", "person", "l", "")]
    assert (got["m2"].original, got["m2"].punctuated, got["m2"].text_changed, got["m2"].translations) == (("page " + text)[4:], ("page " + text)[4:], True, [])
    assert (got["m3"].original, got["m3"].text_changed) == ("", False)
    assert (got["m4"].original, got["m4"].block_text, got["m4"].bibliography) == ("", "", None)
    assert (got["m5"].punctuated, [x.id for x in got["m5"].translations], [x.id for x in got["m5"].annotations]) == ("裴楷清通。", ["t2"], ["n2"])
    assert got["m6"].original == text[5:]


FILES = {
    "csv": ("齒,歯,齿\n# remark, x\n // also, one\n說,説\nalone\n齒,歯\na,a\n", "csv", {("歯", "齒"), ("歯", "齿"), ("齒", "齿")}, 3, ["line 5: alone"]),
    "tsv": ("裏\t裡\n\n群\t羣\n", "tsv", {("裏", "裡"), ("羣", "群")}, 0, []),
    "text": ("裏↔裡 群 = 羣\n峰→峯", "text", {("峯", "峰")} | {tuple(sorted(p)) for p in (("裏", "裡"), ("裏", "群"), ("裏", "羣"), ("裡", "群"), ("裡", "羣"), ("群", "羣"))}, 0, []),
    "json1": ('{"variants": {"裏": ["裡", 5], "裡": ["裏"], "_format_guide": ["x"]}}', "json", {("裏", "裡")}, 1, []),
    "json2": (' {"A": "B", "說": ["説"], "C": "C", "D": 7}', "json", {("A", "B")}, 2, []),
    "json4": ('[["a", "b", "c"], ["x"], "yz", ["b", "a"]]', "json", {("a", "b"), ("a", "c"), ("b", "c")}, 1, ['item 1: ["x"]', 'item 2: "yz"']),
    "blank": ("  \n ", "text", set(), 0, []),
}


def test_variants_of_all_forms(spark):
    existing = spark.createDataFrame([("説", "說")], "a string, b string")
    new, report = va.import_variants(spark.createDataFrame([(k, v[0]) for k, v in FILES.items()] + [("bad", '{"a": '), ("null", None)], "file string, text string"), existing)
    pairs: dict[str, set] = {}
    for r in new.collect():
        pairs.setdefault(r.file, set()).add((r.a, r.b))
    got = {r.file: r for r in report.collect()}
    for name, (_, form, want, skipped, errors) in FILES.items():
        assert pairs.get(name, set()) == {tuple(sorted(p)) for p in want}
        assert (got[name].format, got[name].added, got[name].skipped, got[name].errors) == (form, len(want), skipped, errors), name
    assert got["bad"].format == "json" and len(got["bad"].errors) == 1 and got["null"].added == 0
    forced, _ = va.import_variants(spark.createDataFrame([("f", "a b")], "file string, text string"), existing, "csv")
    assert forced.collect() == []

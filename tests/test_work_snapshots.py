"""Snapshots of works: built from files, checked, and back to files."""

import json

from inkwell.sources import work_snapshots as ws

FILES = "work string, area string, path string, content string, size long"
O, I = "original", "interpretation"
WORK = [
    ("w", O, "manifest.json", '{"document_id": "d", "title": "蒙求 \\"x\\"", "parts": [{"part_id": "vol1"}]}', 1), ("w", O, "bibliography.json", '{"title": "t", "n": 1}', 1), ("w", O, "L1_source/a.pdf", None, 77), ("w", O, "L1_source/.hidden", None, 1),
    ("w", O, "L3_layout/vol1_page_002.json", '{"part_id": "vol1", "page_number": 2, "blocks": [{"block_id": "p2_b1"}]}', 1), ("w", O, "L3_layout/vol1_page_001.json", '{"part_id": "vol1", "page_number": 1, "blocks": [{"block_id": "p1_b1"}]}', 1), ("w", O, "L3_layout/broken.json", "{", 1),
    ("w", O, "L4_text/pages/vol1_page_001.txt", '一\n二 "q" \\ \t𠀀', 1), ("w", O, "L4_text/pages/vol1_page_002.txt", "", 1), ("w", O, "L4_text/corrections/vol1_page_001_corrections.json", '{"corrections": [{"type": "ocr"}]}', 1),
    ("w", I, "manifest.json", '{"interpretation_id": "i", "title": "reading", "interpreter": {"type": "human"}}', 1), ("w", I, "dependency.json", '{"source": {"document_id": "d", "base_commit": "abc"}, "tracked_files": []}', 1),
    ("w", I, "L5_reading/main_text/vol1_page_001_punctuation.json", '{"block_id": "p1_b1", "marks": [{"id": 1}]}', 1), ("w", I, "L5_reading/main_text/vol1_page_001_hyeonto.json", '{"block_id": "gone", "annotations": []}', 1),
    ("w", I, "L6_translation/main_text/vol1_page_001_translation.json", '{"translations": [{"id": "t", "source": {"block_id": "p2_b1"}}, {"id": "u", "source": {"block_id": "lost"}}]}', 1),
    ("w", I, "L7_annotation/main_text/vol1_page_001_annotation.json", '{"blocks": [{"block_id": "p1_b1", "annotations": [{"type": "person"}, {"type": "odd"}]}]}', 1), ("w", I, "L7_annotation/main_text/empty_annotation.json", "{}", 1),
    ("w", I, "core_entities/works/k1.json", '{"id": "k1", "title": "x"}', 1), ("w", I, "core_entities/tags/g2.json", '{"id": "g2"}', 1), ("w", I, "core_entities/tags/g1.json", '{"id": "g1"}', 1), ("bare", O, "L4_text/pages/p.txt", "only text", 1),
]


def test_round_trip(spark):
    files = spark.createDataFrame(WORK, FILES).repartition(3)
    library = spark.createDataFrame([("annotation_types", '[{"id": "person"}]'), ("variant_characters", '{"variants": {}}')], "key string, content string")
    made = ws.build(files, library).cache()
    got = {r.work: json.loads(r.snapshot) for r in made.collect()}
    w = got["w"]
    assert w["schema_version"] == "1.0" and w["work"] == {"document_id": "d", "title": '蒙求 "x"', "parts": [{"part_id": "vol1"}], "interpretation_id": "i", "interpretation_title": "reading", "interpreter": {"type": "human"}, "bibliography": {"title": "t", "n": 1}}
    assert w["original"]["layers"]["L1_source"]["files"] == [{"path": "L1_source/a.pdf", "name": "a.pdf", "size_bytes": 77}] and [p["page_number"] for p in w["original"]["layers"]["L3_layout"]["pages"]] == [1, 2]
    assert w["original"]["layers"]["L4_text"]["pages"][0] == {"file_name": "vol1_page_001.txt", "text": '一\n二 "q" \\ \t𠀀', "corrections": {"corrections": [{"type": "ocr"}]}} and w["original"]["layers"]["L4_text"]["pages"][1]["text"] == ""
    assert w["interpretation"]["layers"]["L5_punctuation"] == [{"_source_path": "L5_reading/main_text/vol1_page_001_punctuation.json", "block_id": "p1_b1", "marks": [{"id": 1}]}] and len(w["interpretation"]["layers"]["L7_annotation"]) == 1
    assert [e["id"] for e in w["interpretation"]["core_entities"]["tags"]] == ["g1", "g2"] and w["interpretation"]["base_original_hash"] == "abc" and w["annotation_types"] == [{"id": "person"}]
    assert got["bare"]["work"] == {} and got["bare"]["interpretation"]["core_entities"] == {}
    told = {(r.work, r.level, r.what) for r in ws.validate(made).collect()}
    assert told == {("w", "warning", "1 images are only named"), ("w", "warning", "L5_hyeonto: no block gone"), ("w", "warning", "L6_translation: no block lost"), ("w", "warning", "L7_annotation: no type odd"), ("bare", "error", "no title")}
    back = {(r.area, r.path): r.content for r in ws.restore(made, "_2").collect() if r.work == "w_2"}
    assert not [r for r in ws.restore(made, "_2").collect() if r.work != "w_2"]
    same = lambda p, c: c if p.endswith(".txt") else json.loads(c)
    want = {(a, p): same(p, c) for k, a, p, c, _ in WORK if k == "w" and c not in (None, "{", "{}") and p != "manifest.json"}
    want[I, "dependency.json"]["source"]["document_id"] = "w_2"
    want[O, "L1_source/_imported_file_list.json"] = w["original"]["layers"]["L1_source"]["files"]
    assert {k: same(k[1], c) for k, c in back.items()} == want


def test_what_is_wrong_is_told(spark):
    bad = [("a", "{"), ("b", "{}"), ("c", '{"schema_version": "9"}'), ("d", '{"schema_version": "1.0", "work": {"title": ""}}'), ("e", '{"schema_version": "1.0", "work": {"title": "t"}, "original": {"layers": {"L4_text": {"pages": [{"text": "x"}]}}}, "interpretation": {"layers": {"L5_punctuation": [{"block_id": "any"}]}}}'), ("f", None)]
    df = spark.createDataFrame(bad, "work string, snapshot string")
    told = {(r.work, r.level, r.what) for r in ws.validate(df).collect()}
    assert told == {("a", "error", "not JSON"), ("b", "error", "no schema_version"), ("c", "error", "schema_version 9"), ("d", "error", "no title"), ("d", "error", "no original"), ("d", "warning", "no interpretation"), ("f", "error", "not JSON")}
    assert {(r.work, r.path, r.content) for r in ws.restore(df, "x").collect()} == {("ex", "L4_text/pages/page.txt", "x")}

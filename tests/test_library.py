import json

from inkwell.sources import library as lib


def put(root, path, value):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_manifests_and_records(spark, tmp_path):
    root = str(tmp_path / "lib")
    put(tmp_path, "lib/library_manifest.json", {"name": "L", "documents": [{"document_id": "d1", "title": "T", "path": "documents/d1"}]})
    put(tmp_path, "lib/documents/d1/manifest.json", {"document_id": "d1", "title": "蒙求", "parts": [{"part_id": "v1", "page_count": 2}]})
    put(tmp_path, "lib/documents/d2/manifest.json", "{broken")
    put(tmp_path, "lib/documents/d3/readme.json", {})
    put(tmp_path, "lib/interpretations/i1/manifest.json", {"interpretation_id": "i1", "source_document_id": "d1"})
    assert [(r.folder, r.title, r.parts[0].page_count) for r in lib.documents(spark, root).collect()] == [("d1", "蒙求", 2)]
    assert [(r.folder, r.source_document_id) for r in lib.interpretations(spark, root).collect()] == [("i1", "d1")]
    own = lib.library(spark, root).first()
    assert own.documents[0].document_id == "d1" and own.interpretations == []
    put(tmp_path, "lib/core_entities/work/a.json", {"id": "w1", "name": "x", "metadata": {"k": "v"}})
    put(tmp_path, "lib/core_entities/work/b.json", "nothing")
    assert [(r.id, r.metadata) for r in lib.entities(spark, root, "work").collect()] == [("w1", {"k": "v"})]


def test_page_files_fall_back_to_texts(spark, tmp_path):
    root = str(tmp_path / "lib")
    for name in ("d1/L1_source/v1_page_001.PNG", "d1/L4_text/pages/v1_page_001.txt", "d2/L1_source/book.hwp", "d2/L4_text/pages/v1_page_001.txt", "d2/L4_text/pages/v1_page_002.txt", "d2/L4_text/pages/notes.json", "d3/L1_source/book.hwp", "d3/L1_source/.hidden"):
        put(tmp_path, f"lib/documents/{name}", "x")
    out = {(r.folder, r["name"], r.layer) for r in lib.page_files(spark, root).collect()}
    assert out == {("d1", "v1_page_001.PNG", "L1_source"), ("d2", "v1_page_001.txt", "L4_text"), ("d2", "v1_page_002.txt", "L4_text"), ("d3", "book.hwp", "L1_source")}


def test_layers_with_defaults_and_fallback(spark, tmp_path):
    put(tmp_path, "l3/v1_page_001.json", {"part_id": "v1", "page_number": 1, "blocks": [{"block_id": "p1_b1", "bbox": [0, 0, 1, 1]}]})
    put(tmp_path, "corr/v1_page_001_corrections.json", {"part_id": "v1", "corrections": [{"line": 0, "char_index": 2, "original_ocr": "a", "corrected": "b"}]})
    wanted = spark.createDataFrame([("v1", 1), ("v1", 2)], "part_id string, page_num int")
    assert sorted((r.page_num, len(r.blocks)) for r in lib.page_layouts(spark, str(tmp_path / "l3"), wanted).collect()) == [(1, 1), (2, 0)]
    assert sorted((r.page_num, [c.corrected for c in r.corrections]) for r in lib.page_corrections(spark, str(tmp_path / "corr"), wanted).collect()) == [(1, ["b"]), (2, [])]
    mark = lambda i: {"id": i, "target": {"start": 0, "end": 1}, "after": "。"}
    put(tmp_path, "l5/v1_page_001.json", {"block_id": "b1", "marks": [mark("old")]})
    put(tmp_path, "l5/v1_page_001_blk_b1.json", {"block_id": "b1", "marks": [mark("new")]})
    put(tmp_path, "l5/v1_page_002.json", {"block_id": "b9", "marks": [mark("page")]})
    asked = spark.createDataFrame([("v1", 1, "b1"), ("v1", 2, "b9"), ("v1", 2, "b1")], "part_id string, page_num int, block_id string")
    out = {(r.page_num, r.block_id): [m.id for m in r.marks] for r in lib.block_marks(spark, str(tmp_path / "l5"), asked).collect()}
    assert out == {(1, "b1"): ["new"], (2, "b9"): ["page"], (2, "b1"): []}
    put(tmp_path, "l6/v1_page_001_translation.json", {"page_number": 1, "translations": [{"id": "t", "translation": "x"}]})
    assert sorted((r.page_num, len(r.translations)) for r in lib.translations(spark, str(tmp_path / "l6"), wanted).collect()) == [(1, 1), (2, 0)]
    put(tmp_path, "cite/main_page_003_citation_marks.json", {"page_number": 3, "marks": [{"id": "a"}, {"id": "b"}]})
    put(tmp_path, "cite/main_page_004_citation_marks.json", {"marks": [{"id": "c"}]})
    assert sorted((r.page_number, r.pos, r.id) for r in lib.citation_marks(spark, str(tmp_path / "cite")).collect()) == [(0, 0, "c"), (3, 0, "a"), (3, 1, "b")]
    assert {r._source_path for r in lib.layer_files(spark, str(tmp_path / "l5"), "block_id string").collect()} == {"v1_page_001.json", "v1_page_001_blk_b1.json", "v1_page_002.json"}


def test_json_pages_replace_only_what_is_written(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("v1", 1, "a"), ("v1", 2, "b")], "part_id string, page_num int, text string")
    lib.write_json_pages(rows, out)
    lib.write_json_pages(spark.createDataFrame([("v1", 2, "new")], "part_id string, page_num int, text string"), out)
    assert sorted(r.text for r in spark.read.json(out).collect()) == ["a", "new"]

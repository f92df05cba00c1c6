"""Packages: sections, notes, images and what can't be read."""

import io
import zipfile

import pytest

from inkwell.functions.plugins import Readers
from inkwell.sources import packages as pk

NS = 'xmlns:hp="urn:x"'
SECTION = f"""<hs:sec xmlns:hs="urn:s" {NS}><hp:p><hp:run><hp:t>第一 <hp:tab/>段</hp:t><hp:ctrl><hp:footNote number="3"><hp:subList><hp:p><hp:run><hp:t>a note</hp:t></hp:run></hp:p></hp:subList></hp:footNote></hp:ctrl></hp:run></hp:p>
<hp:p><hp:run><hp:t> </hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>before</hp:t><hp:tbl><hp:p><hp:run><hp:t>cell</hp:t></hp:run></hp:p></hp:tbl></hp:run></hp:p>
<hp:p><hp:run><hp:ctrl><hp:endNote><hp:p><hp:run><hp:t>the end</hp:t></hp:run></hp:p></hp:endNote></hp:ctrl></hp:run></hp:p></hs:sec>"""


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def plain(rows):
    return sorted((r.path.rsplit("/", 1)[-1], r.kind, r["index"] if r["index"] is not None else -1, r.name or "", (r.text or "") if r.kind != "error" else "", bytes(r.content or b"")) for r in rows)


def test_data_source_and_reader_agree(spark, tmp_path):
    numbered = {f"Contents/section{i}.xml": f"<s><p><t>{i}</t></p></s>" for i in (10, 2, 0)}
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.hwpx").write_bytes(package({"Contents/section0.xml": SECTION, "BinData/image1.png": b"\x89PNG", "mimetype": "x"}))
    (tmp_path / "sub" / "b.hwpx").write_bytes(package(numbered | {"Contents/section1.xml": "<broken", "Contents/section3.xml": "<s/>"}))
    (tmp_path / "c.hwpx").write_bytes(b"PK\x03\x04 cut off")
    (tmp_path / "d.hwpx").write_bytes(pk.BINARY_FORMAT + b"\0" * 20)
    (tmp_path / "e.hwpx").write_bytes(b"")
    (tmp_path / "f.hwpx").write_bytes(package({"readme": "nothing"}))
    want = [
        ("a.hwpx", "endnote", 1, "section0.xml", "the end", b""), ("a.hwpx", "footnote", 3, "section0.xml", "a note", b""), ("a.hwpx", "image", 0, "image1.png", "", b"\x89PNG"), ("a.hwpx", "section", 0, "section0.xml", "第一 段\nbefore\ncell", b""),
        ("b.hwpx", "error", -1, "Contents/section1.xml", "", b""), ("b.hwpx", "section", 0, "section0.xml", "0", b""), ("b.hwpx", "section", 2, "section2.xml", "2", b""), ("b.hwpx", "section", 4, "section10.xml", "10", b""),
        ("c.hwpx", "error", -1, "", "", b""), ("d.hwpx", "error", -1, "", "", b""), ("e.hwpx", "error", -1, "", "", b""), ("f.hwpx", "error", -1, "", "", b""),
    ]
    readers = Readers()
    readers.add(pk.Packages)
    with pytest.raises(ValueError, match="registered already"):
        readers.add(pk.Packages)
    assert readers.register(spark) == ["packages"]
    source = spark.read.format("packages").load(str(tmp_path))
    assert source.rdd.getNumPartitions() == 6
    assert plain(source.collect()) == want
    assert plain(pk.read_packages(spark, str(tmp_path)).collect()) == [w for w in want if w[0] != "e.hwpx"]  # Spark passes empty files over
    assert plain(spark.read.format("packages").load(str(tmp_path / "*.hwpx")).where("kind = 'section'").collect()) == want[3:4]


def test_written_packages_are_read_again(spark):
    df = spark.createDataFrame([("x", ["one\n\ntwo & <three>", "𠀀"], ["n1", "n2"]), ("y", [], None), ("z", [None, ""], [])], "path string, s array<string>, n array<string>")
    from pyspark.sql import functions as F

    rows = pk.parse_packages(pk.packages_of(df, F.col("path"), F.col("s"), F.col("n"))).collect()
    assert plain(rows) == [("x", "footnote", 1, "section0.xml", "n1", b""), ("x", "footnote", 2, "section0.xml", "n2", b""), ("x", "section", 0, "section0.xml", "one\ntwo & <three>", b""), ("x", "section", 1, "section1.xml", "𠀀", b""), ("y", "error", -1, "", "", b"")]

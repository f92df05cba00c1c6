"""Word-processor packages (a zip of XML sections): sections, notes and images as rows, and what can't be read as error
rows. As a data source of its own, with a partition for each file, and over any files that Spark reads."""

from __future__ import annotations

import glob
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "path string, kind string, index int, name string, text string, content binary"
_SECTION = re.compile(r"(?:^|/)section(\d+)\.xml$", re.I)
NOTES = {"footNote": "footnote", "endNote": "endnote"}
#: What files of the older, binary format and packages begin with.
BINARY_FORMAT, PACKAGE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04"


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _paragraphs(root: ET.Element, notes: list[ET.Element]) -> list[str]:
    """The paragraphs of an element that are not empty; notes within go to `notes`, and their text is left out."""
    out: list[str] = []

    def walk(element: ET.Element, line: list[str]) -> None:
        kind = _name(element)
        if kind in NOTES:
            notes.append(element)
            return
        if kind == "p":
            own: list[str] = []
            at = len(out)
            for child in element:
                walk(child, own)
            if (text := "".join(own)).strip():
                out.insert(at, text)  # before the paragraphs that stand within it
            return
        if kind == "t":
            line.append(element.text or "")
        elif kind == "lineBreak":
            line.append("\n")
        for child in element:
            walk(child, line)
            if kind == "t":
                line.append(child.tail or "")

    loose: list[str] = []
    walk(root, loose)
    return out + (["".join(loose)] if "".join(loose).strip() else [])


def package_rows(path: str, content: bytes) -> Iterator[tuple]:
    """Rows (ROWS) of a package: sections in order of their numbers, each with its notes, then images; a row of kind error
    for each part that can't be read, or for the whole file."""
    error = lambda name, why: (path, "error", None, name, str(why), None)
    if content[:8] == BINARY_FORMAT:
        yield error(None, "the older binary format is not a package")
        return
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        names = package.namelist()
    except (zipfile.BadZipFile, OSError) as e:
        yield error(None, e)
        return
    counts = dict.fromkeys(NOTES.values(), 0)
    sections = sorted((int(m[1]), n) for n in names if (m := _SECTION.search(n)))
    if not sections:
        yield error(None, "no sections")
    for index, (_, name) in enumerate(sections):
        try:
            root = ET.fromstring(package.read(name))
        except Exception as e:  # noqa: BLE001  damaged parts fail in many ways; all are told in a row
            yield error(name, e)
            continue
        notes: list[ET.Element] = []
        if (text := "\n".join(_paragraphs(root, notes)).strip()):
            yield path, "section", index, os.path.basename(name), text, None
        for note in notes:
            kind = NOTES[_name(note)]
            counts[kind] += 1
            number = next((int(v) for k, v in note.attrib.items() if k.rsplit("}", 1)[-1] == "number" and v.isdigit()), counts[kind])
            within: list[ET.Element] = []
            body = ET.Element("note")
            body.extend(list(note))
            yield path, kind, number, os.path.basename(name), "\n".join(_paragraphs(body, within)).strip(), None
    for index, name in enumerate(n for n in names if n.startswith("BinData/") and not n.endswith("/")):
        try:
            yield path, "image", index, os.path.basename(name), None, package.read(name)
        except Exception as e:  # noqa: BLE001
            yield error(name, e)


class File(InputPartition):
    """One file."""


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = glob.glob(os.path.join(self.path, "**", "*"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path)
        return [File(f) for f in sorted(found) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(partition.value, "rb") as f:
                content = f.read()
        except OSError as e:
            yield partition.value, "error", None, None, str(e), None
            return
        yield from package_rows(partition.value, content)


class Packages(DataSource):
    """spark.read.format("packages").load(folder or pattern), once it is registered: for folders that all executors have
    mounted. read_packages reads any others."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def parse_packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """ROWS of files (path, content)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for p, c in zip(*batch.columns, strict=True):
                for row in package_rows(p.as_py(), c.as_py() or b""):
                    rows.append(row)
                    held += ROW_BYTES + len(row[4] or "") + len(row[5] or b"")
                    if held >= AT_ONCE_BYTES:
                        yield _record_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _record_batch(rows)

    return files.select(F.col(path).cast("string").alias("path_"), F.col(content).alias("content_")).mapInArrow(parse, ROWS)


#: Bytes of rows that are handed on together, at least one row, and what a row takes beside its text and content.
AT_ONCE_BYTES, ROW_BYTES = 4_000_000, 100
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("index", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("content", pa.binary())])


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_packages(spark: SparkSession, folder: str, pattern: str = "*.hwpx") -> DataFrame:
    """ROWS of the packages in a folder, and those below, of any store that Spark reads."""
    return parse_packages(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


@F.pandas_udf(T.BinaryType())
def package_of(sections: pd.Series, notes: pd.Series) -> pd.Series:
    """A package of sections (arrays of texts, a paragraph a line), with the notes behind the first paragraph."""

    def one(parts, found) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            for i, text in enumerate(parts if parts is not None else []):
                first, *others = (f"<t>{_escaped(line)}</t>" for line in (text or "").split("\n"))
                for k, note in enumerate(found if not i and found is not None else []):
                    first += f'<ctrl><footNote number="{k + 1}"><p><run><t>{_escaped(note or "")}</t></run></p></footNote></ctrl>'
                body = "".join(f"<p><run>{line}</run></p>" for line in (first, *others))
                package.writestr(f"Contents/section{i}.xml", f"<?xml version='1.0' encoding='utf-8'?>\n<sec>{body}</sec>".encode("utf-8", "xmlcharrefreplace"))
        return out.getvalue()

    return pd.Series([one(s, n) for s, n in zip(sections, notes, strict=True)])


def packages_of(rows: DataFrame, path: Column, sections: Column, notes: Column) -> DataFrame:
    """path, content: a package a row."""
    return rows.select(path.alias("path"), package_of(sections, notes).alias("content"))

"""Importing variant characters from files of any of the known forms."""

from __future__ import annotations

import json
import re
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tasks import dealt
from .alignment import row_type

_BETWEEN = {"csv": ",", "tsv": "\t", "text": r"[\s↔=→⇔]+"}
#: Lines of a file that tell its form, and how many of them need to have its separator.
HEAD_LINES, NEEDED = 5, 2
#: Letters of a file to a pair, about: what tasks are dealt out by.
LETTERS_A_ROW = 8
FOUND = row_type(format="string", pairs=T.ArrayType(row_type(a="string", b="string")), errors=T.ArrayType(T.StringType()))


def format_of(text: str) -> str:
    """json, tsv, csv or text."""
    body = text.strip()
    if body[:1] in ("{", "["):
        return "json"
    head = body.split("\n")[:HEAD_LINES]
    return next((form for form, mark in (("tsv", "\t"), ("csv", ",")) if sum(mark in line for line in head) >= NEEDED), "text")


def _from_lines(text: str, form: str) -> tuple[list[tuple], list[str]]:
    pairs, errors = [], []
    for n, line in enumerate(text.strip().split("\n"), 1):
        row = line.strip()
        if not row or row.startswith(("#", "//")):
            continue
        parts = [p for p in (x.strip() for x in re.split(_BETWEEN[form], row)) if p]
        if len(parts) < 2:
            errors.append(f"line {n}: {row}")
        pairs += combinations(parts, 2)
    return pairs, errors


def _from_json(text: str) -> tuple[list[tuple], list[str]]:
    try:
        data = json.loads(text)
    except ValueError as e:
        return [], [str(e)]
    if isinstance(data, dict):
        data = data.get("variants", data)
    pairs, errors = [], []
    if isinstance(data, dict):
        for key, others in data.items():
            others = [others] if isinstance(others, str) else others
            if not key.startswith("_") and isinstance(others, list):
                pairs += [(key, o) for o in others if isinstance(o, str)]
    elif isinstance(data, list):
        for i, group in enumerate(data):
            if not isinstance(group, list) or len(group) < 2:
                errors.append(f"item {i}: {json.dumps(group, ensure_ascii=False)}")
            else:
                pairs += combinations([c for c in group if isinstance(c, str)], 2)
    return pairs, errors


@F.pandas_udf(FOUND)
def parse_variants(texts: pd.Series, forms: pd.Series) -> pd.DataFrame:
    out = []
    for text, form in zip(texts, forms, strict=True):
        kind = format_of(text or "") if form in (None, "auto") else form
        out.append((kind, *(_from_json(text or "") if kind == "json" else _from_lines(text or "", kind))))
    return pd.DataFrame(out, columns=["format", "pairs", "errors"])


def import_variants(files: DataFrame, existing: DataFrame, form: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(new pairs, report) of importing files (file, text) of variant characters over existing pairs (a, b, either way
    round): file, a, b of the pairs that are new to each file, a before b; and file, format, added, skipped, errors.

    Forms: lines of characters with commas, tabs, or white space and arrows between them, # and // for remarks; JSON of
    {"variants": {char: [chars]}}, {char: char}, {char: [chars]} or [[char, char, ...], ...]. `auto` tells them by their
    beginning. All pairs of a line or group count; pairs of one character with itself, and those that are known or came
    before, are skipped.
    """
    letters = files.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parsed = dealt(files.select("file", "text"), letters // LETTERS_A_ROW, "file").select("file", parse_variants(F.col("text"), F.lit(form)).alias("p")).select("file", "p.*")
    known = existing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    made = parsed.select("file", F.inline("pairs")).where("a <> b").select("file", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    new = dealt(made, letters // LETTERS_A_ROW, "a", "b").join(known, ["a", "b"], "left_anti").select("file", "a", "b")
    added = dealt(new, letters // LETTERS_A_ROW, "file").groupBy("file").agg(F.count(F.lit(1)).alias("added"))
    report = parsed.select("file", "format", F.size("pairs").alias("n"), "errors").join(added, "file", "left").select("file", "format", F.coalesce("added", F.lit(0)).cast("long").alias("added"), (F.col("n") - F.coalesce("added", F.lit(0))).cast("long").alias("skipped"), "errors")
    return new, report

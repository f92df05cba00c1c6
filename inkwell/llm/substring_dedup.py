"""Substring dedup over sliding sentence spans.

A text is cut into sentences after . ! ? before white space, and at line breaks. From every sentence the shortest run
forward, and the shortest run back, of at least `min_sentences` sentences and `min_words` words is hashed, and so is
every sentence of at least STRETCH words by itself. Joined globally, a run's first place is the one with the smallest
(doc_id, tie, sentence), tie telling texts of one id apart; the sentences that any other place of it covers are removed. Runs in both directions cover every
sentence of a repeated passage that has at least 2 * min_words words in at least 2 * min_sentences whole sentences.

Passages that begin or end within sentences are found by windows of WINDOW words, whatever the sentences: a window is
hashed where its hash is the smallest of some STRETCH words around it. Equal STRETCH words therefore hash an equal
window, and windows follow each other without a gap. The words of a window's later places are removed, so of a
repeated STRETCH of words no later place stays whole; up to STRETCH - WINDOW words at each end may stay.

Defined results: null and empty texts have no sentences and stay as they are; sentences and words compare lower-cased
with white space collapsed; a sentence that loses some words counts as removed; a window's place that overlaps its
first place loses the words beyond that only; a null doc_id comes before all others; rows that share a doc_id (or have
none) are documents of their own, in the order of a hash of the text where their texts differ; of rows that repeat both
id and text one, no matter which, holds the first places and all others lose whatever their own runs and windows cover;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _BASE, _BASE_INVERSE, _powers, chunked, id_in, id_out, join_skewed, mix64, staged, text_key, tidy, with_tie, word_hashes

_CUT = re.compile(r"(\s*\n\s*|(?<=[.!?])\s+)")
_WORD = re.compile(r"\S+")

#: Words from which a repeated stretch is found wherever it begins, and words of the windows that find it.
STRETCH, WINDOW = 50, 26
#: Places counted in words are numbered from here, below all places counted in sentences.
_WORDS = -(1 << 31)


def runs_of(texts: list[str], min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts: index of the text, first sentence, last sentence (within the text), hash."""
    hashes, words, counts = [], [], []
    for t in texts:
        sentences = _CUT.split(t)[::2]
        for s in sentences:
            w = s.lower().split()
            words.append(len(w))
            hashes.append(xxhash.xxh64_intdigest(" ".join(w)))
        counts.append(len(sentences))
    n = len(words)
    of = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts, dtype=np.int64)
    begin, end = (ends - counts)[of], ends[of]
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(np.array(hashes, np.uint64)) * _powers(_BASE, n), dtype=np.uint64)))
    at = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + min_words) - 1, at + min_sentences - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at - min_sentences + 1)
    fits, back, alone = last < end, first >= begin, np.flatnonzero(np.array(words) >= STRETCH)
    pairs = np.unique(np.concatenate((at[fits] * (n + 1) + last[fits], first[back] * (n + 1) + at[back], alone * (n + 1) + alone)))
    a, b = pairs // (n + 1), pairs % (n + 1)
    h = mix64((sums[b + 1] - sums[a]) * _powers(_BASE_INVERSE, n)[a] + (b - a).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    return of[a], a - begin[a], b - begin[a], h.view(np.int64)


def _sliding(pick: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The smallest or largest (np.minimum, np.maximum) of each `width` consecutive elements."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts: index of the text, first word (within the text), hash."""
    hashes, offsets = word_hashes([" ".join(t.lower().split()) for t in texts], lower=False)
    n, reach = len(hashes), STRETCH - WINDOW + 1
    if n < STRETCH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)))
    h = mix64((sums[WINDOW:] - sums[:-WINDOW]) * _powers(_BASE_INVERSE, n)[: n - WINDOW + 1] + np.uint64(WINDOW)) | np.uint64(1)
    least = _sliding(np.minimum, h, reach)
    within = np.arange(len(least)) + STRETCH <= offsets[1:][of[: len(least)]]
    edge = np.zeros(reach - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate((edge, np.where(within, least, np.uint64(0)), edge)), reach)
    at = np.flatnonzero(best == h)
    return of[at], at - offsets[of[at]], h[at].view(np.int64)


def sentence_spans(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """doc_id, tie, first, last, h of every run and window of docs (doc_id, tie, text)."""

    @tidy
    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ties, texts = batch["doc_id"], batch["tie"].to_numpy(), batch["text"].tolist()
            for a, b in chunked(texts, 1_000_000):
                of, first, last, h = runs_of(texts[a:b], min_sentences, min_words)
                yield pd.DataFrame({"doc_id": ids.iloc[a + of].to_numpy(), "tie": ties[a + of], "first": first, "last": last, "h": h})
                of, word, h = windows_of(texts[a:b])
                yield pd.DataFrame({"doc_id": ids.iloc[a + of].to_numpy(), "tie": ties[a + of], "first": _WORDS + word, "last": _WORDS + word + WINDOW - 1, "h": h})

    return docs.select("doc_id", "tie", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(spans, "doc_id long, tie long, first int, last int, h long")


def uncovered(text: str | None, runs: list | None) -> tuple[int, int, str | None]:
    """(sentences, sentences removed, text left) once the covered runs of sentences and words are gone."""
    if not text:
        return 0, 0, text
    if runs is None or not len(runs):
        return (len(_CUT.split(text)) + 1) // 2, 0, text
    parts = _CUT.split(text)
    drop = {i for r in runs if r["first"] >= 0 for i in range(r["first"], r["last"] + 1)}
    gone = {i - _WORDS for r in runs if r["first"] < 0 for i in range(r["first"], r["last"] + 1)}
    left, removed, word = [], 0, 0
    for i, (s, sep) in enumerate(zip(parts[::2], [*parts[1::2], ""], strict=True)):
        spans = [m.span() for m in _WORD.finditer(s)] if gone else []
        stay = [k for k in range(len(spans)) if word + k not in gone]
        word += len(spans)
        if i in drop or spans and not stay:
            removed += 1
            continue
        if len(stay) < len(spans):
            removed += 1
            s = " ".join(s[slice(*spans[k])] for k in stay)
        left.append(s + sep)
    return (len(parts) + 1) // 2, removed, "".join(left).rstrip()


RESULT = "doc_id long, n_sentences int, n_removed int, text string"


def first_and_others(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) with one row of those that repeat id and text, and the others (None if there are none). A row
    may repeat as often as it likes: groups are counted, and dealt out where they are joined."""
    rows = docs.withColumn("name_", F.concat_ws(":", "doc_id", text_key("text")))
    repeated = staged(rows.groupBy("name_").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    if repeated.isEmpty():
        return docs, None
    total = docs.count()
    rows = join_skewed(rows.withColumn("row_", F.monotonically_increasing_id()), repeated.withColumn("several", F.lit(True)), "name_", total, "row_", how="left")
    copies = rows.where("several").select("name_", "doc_id", "text").withColumn("row_", F.monotonically_increasing_id())
    copies = staged(copies, "copies")  # their numbers stand from here on
    first = staged(copies.groupBy("name_").agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("n")), "first-copies")
    copies = join_skewed(copies, first, "name_", total, "row_")
    once = rows.where("several is null").unionByName(copies.where("row_ = first_"), allowMissingColumns=True)
    return once.select("doc_id", "text"), copies.where("row_ <> first_").select("doc_id", "text")


def own_runs_removed(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """substring_dedup of rows whose texts all stand elsewhere before."""

    @tidy
    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked([t or "" for t in texts], 1_000_000):
                held = [t or "" for t in texts[a:b]]
                covered: list[list[dict]] = [[] for _ in held]
                of, first, last, _ = runs_of(held, min_sentences, min_words)
                for i, x, y in zip(of.tolist(), first.tolist(), last.tolist(), strict=True):
                    covered[i].append({"first": x, "last": y})
                of, word, _ = windows_of(held)
                for i, w in zip(of.tolist(), word.tolist(), strict=True):
                    covered[i].append({"first": _WORDS + w, "last": _WORDS + w + WINDOW - 1})
                done = pd.DataFrame([uncovered(t, runs) for t, runs in zip(texts[a:b], covered, strict=True)], columns=["n_sentences", "n_removed", "text"])
                done.insert(0, "doc_id", batch["doc_id"].to_numpy()[a:b])
                yield done

    return docs.select("doc_id", "text").mapInPandas(strip, RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_removed, text (what is left of it)."""
    docs, others = first_and_others(docs.select(id_in(id_col), F.col(text_col).alias("text")))
    docs = with_tie(docs)
    spans = sentence_spans(docs, min_sentences, min_words)
    place = F.struct("doc_id", "tie", "first")
    counted = spans.groupBy("h").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = staged(counted, "repeated-spans")
    total = counted.agg(F.sum("n")).first()[0] or 0
    later = join_skewed(spans, counted, "h", total, "doc_id").where(place != F.col("keep"))
    # A window that overlaps its own first place must not take words of that.
    after = F.col("keep.first") + WINDOW
    same = (F.col("first") < 0) & (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("tie") == F.col("keep.tie")) & (after > F.col("first"))
    later = later.withColumn("first", F.when(same, after).otherwise(F.col("first")))
    covered = later.groupBy(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie")).agg(F.collect_set(F.struct("first", "last")).alias("covered"))

    @tidy
    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, covered = batch["text"].tolist(), batch["covered"].tolist()
            for a, b in chunked([t or "" for t in texts], 1_000_000):
                out = [(*uncovered(t, runs),) for t, runs in zip(texts[a:b], covered[a:b], strict=True)]
                done = pd.DataFrame(out, columns=["n_sentences", "n_removed", "text"])
                done.insert(0, "doc_id", batch["doc_id"].to_numpy()[a:b])
                yield done

    kept = docs.join(covered, (docs["doc_id"] == covered["of"]) & (docs["tie"] == covered["of_tie"]), "left").drop("of", "of_tie", "tie")
    out = kept.mapInPandas(rebuild, RESULT)
    if others is not None:
        out = out.unionByName(own_runs_removed(others, min_sentences, min_words))
    return out.withColumn("doc_id", id_out())

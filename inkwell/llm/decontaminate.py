"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, and verification.

Distinct items are cut into entries of at most ENTRY_WORDS words. Document frequencies, the number of entries and their
mean length are those of all items, so a score does not depend on how the index is cut; BM25 weights are divided by the
entry's own best score, so one threshold (a share of a perfect match) serves all. Every document is cut into passages of
2 * ENTRY_WORDS words at a stride of ENTRY_WORDS, so any entry that occurs in one piece lies within one passage, and
each passage queries the index. Passages whose terms' list maxima, or the block maxima of any block, cannot add up to the
threshold are passed over (tested for many passages at once); the others run block-max WAND: lists in the order of their
current entries give the pivot by list maxima, the pivot's block is skipped if its block maxima cannot reach the
threshold, and else the pivot is scored. So all entries above the threshold are retrieved.

A pair of document and item found this way is verified on whole texts: shingles of five words of the item's question
(all but its last sentence) and answer (its last sentence; both are the whole item if it has but one) are looked up in
the document.

Tasks build the index in shards of some SHARD_ENTRIES entries. Shards go to the executors in waves of at most WAVE_BYTES
(one shard at least); the documents are read once for each wave.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _BASE, _BASE_INVERSE, _powers, chain, chunked, held, id_in, id_out, mix64, staged, text_key, tidy

ENTRY_WORDS, BLOCK_ENTRIES = 64, 2
SHARD_ENTRIES, WAVE_BYTES = 20_000, 256_000_000
K1, B = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _word_table() -> np.ndarray:
    """Which code points are letters, digits or underscores."""
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for m in re.finditer(r"\w+", every):
        out[m.start() : m.end()] = True
    return out


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of letters and digits, and each text's first."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    edge = np.flatnonzero(np.diff(held("contamination words", _word_table)[codes].view(np.int8), prepend=0))
    begin, end = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), dtype=np.uint64)))
    hashes = mix64((sums[end] - sums[begin]) * _powers(_BASE_INVERSE, len(codes))[begin] + (end - begin).astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(begin, np.cumsum([len(t) + 1 for t in lower]))))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of runs of `width` words; of all words if there are fewer."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - width + 1]
    for i in range(1, width):
        h = chain(h, words[i : len(words) - width + 1 + i])
    return np.unique(h)


class Index:
    """A shard: postings (entries and their normalised weights) by term, with list and block maxima; the parts of its
    items for verification. postings has item (key), entry, term and weight; items has item and text."""

    def __init__(self, postings: pd.DataFrame, items: pd.DataFrame, width: int):
        self.items = items["item"].to_numpy(np.int64)
        at_item = pd.Series(np.arange(len(items)), index=self.items)
        entries = postings[["item", "entry"]].drop_duplicates()
        sizes = postings.groupby(["item", "entry"])["term"].transform("size")
        entries = postings.assign(size=sizes)[["item", "entry", "size"]].drop_duplicates().sort_values(["size", "item", "entry"])  # blocks of like length
        self.item = at_item[entries["item"]].to_numpy()
        number = pd.Series(np.arange(len(entries)), index=pd.MultiIndex.from_frame(entries[["item", "entry"]]))
        entry = number[pd.MultiIndex.from_frame(postings[["item", "entry"]])].to_numpy()
        # terms are numbered by the length of their lists, longest first
        self.terms, inverse, counts = np.unique(postings["term"].to_numpy(np.int64).view(np.uint64), return_inverse=True, return_counts=True)
        self.number = np.argsort(np.argsort(-counts, kind="stable"))
        term = self.number[inverse]
        by = np.lexsort((entry, term))
        self.entry, self.weight = entry[by], postings["weight"].to_numpy(float)[by]
        self.at = np.concatenate(([0], np.cumsum(np.sort(counts)[::-1])))
        first = self.at[:-1]
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.at))
        self.key = (of << 32) + self.entry
        self.most = np.maximum.reduceat(self.weight, first) if len(by) else self.weight
        self.block_key, start = np.unique((of << 32) + self.entry // BLOCK_ENTRIES, return_index=True)
        self.block_most = np.maximum.reduceat(self.weight, start) if len(by) else self.weight
        self.block_at, self.n_blocks = np.searchsorted(self.block_key >> 32, np.arange(len(self.terms) + 1)), len(self.item) // BLOCK_ENTRIES + 1
        self.width, self.parts = width, []
        for text in items["text"]:
            sentences = [s for s in _SENTENCE.split(text.strip()) if s]
            question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)
            words = [terms_of([t])[0] for t in (question, answer, text)]
            self.parts.append([(min(width, len(w)), shingles(w, width)) for w in words])

    def retrieve(self, terms: np.ndarray, blocks: np.ndarray, need: float) -> Iterator[tuple[int, float]]:
        """(entry, score) of at least `need` for distinct terms (numbers), by block-max WAND: blocks are those whose block
        maxima can reach it, in order."""
        base, most = terms << 32, self.most[terms]
        at, end = self.at[terms], self.at[terms + 1]
        while True:
            live = at < end
            if not live.all():
                base, most, at, end = base[live], most[live], at[live], end[live]
            here = self.entry[at]
            order = np.argsort(here)
            pivot = int(np.searchsorted(np.cumsum(most[order]), need))
            if pivot == len(order):
                return
            e = int(here[order[pivot]])
            k = int(np.searchsorted(blocks, e // BLOCK_ENTRIES))
            if k == len(blocks):
                return
            if blocks[k] > e // BLOCK_ENTRIES:
                e = int(blocks[k]) * BLOCK_ENTRIES - 1  # nothing before that block
            else:
                place = np.minimum(np.searchsorted(self.key, base + e), len(self.key) - 1)
                score = float(self.weight[place[self.key[place] == base + e]].sum())
                if score >= need:
                    yield e, score
            at = np.searchsorted(self.key, base + e + 1)

    def passages(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term) of the distinct known terms of all passages, in order (long lists first), and the passages'
        texts."""
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == words)
        text = np.searchsorted(at, known, side="right") - 1
        # strides: stretches of ENTRY_WORDS words of one text; a passage is a stride and the next one
        n_strides = np.maximum(1, -(-np.diff(at) // ENTRY_WORDS))
        first = np.concatenate(([0], np.cumsum(n_strides)))
        stride, term = first[text] + (known - at[text]) // ENTRY_WORDS, self.number[place[known]]
        begins = np.zeros(first[-1], bool)
        begins[first[:-1]] = True
        lone = np.zeros(first[-1], bool)
        lone[first[:-1][n_strides == 1]] = True
        ends = np.append(begins[1:], True) & ~lone  # the last stride begins no passage of its own
        own, before = ~ends[stride], ~begins[stride]
        keys = np.sort(np.concatenate((stride[own] * len(self.terms) + term[own], (stride[before] - 1) * len(self.terms) + term[before])))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        return keys // len(self.terms), keys % len(self.terms), np.repeat(np.arange(len(n_strides)), n_strides)

    def open_blocks(self, passage: np.ndarray, term: np.ndarray, n: int, need: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block), in order, of the blocks whose block maxima can reach `need` for n passages. The longest lists of a passage are not
        looked at as long as their list maxima stay below half of it together; those count for every block."""
        size = self.block_at[term + 1] - self.block_at[term]
        sums = np.cumsum(self.most[term])
        begin = np.searchsorted(passage, np.arange(n))
        sums -= np.concatenate(([0.0], sums))[begin][passage]
        left_out = sums < need / 2
        slack = np.bincount(passage[left_out], self.most[term[left_out]], minlength=n)
        passage, term, size = passage[~left_out], term[~left_out], size[~left_out]
        out, n_blocks = [], self.n_blocks
        cut = np.searchsorted(passage, np.arange(n + 1))
        rows = np.concatenate(([0], np.cumsum(size)))[cut]
        p = 0
        while p < n:
            q = min(n, p + max(1, 4_000_000 // n_blocks), max(p + 1, int(np.searchsorted(rows, rows[p] + 2_000_000, side="right")) - 1))
            a, b = cut[p], cut[q]
            ends = np.cumsum(size[a:b])
            at = np.repeat(self.block_at[term[a:b]] - (ends - size[a:b]), size[a:b]) + np.arange(ends[-1] if b > a else 0)
            bounds = np.bincount(np.repeat(passage[a:b] - p, size[a:b]) * n_blocks + self.block_key[at] % (1 << 32), self.block_most[at], minlength=(q - p) * n_blocks)
            own, block = np.nonzero(bounds.reshape(q - p, n_blocks) + slack[p:q, None] >= need)
            out.append((own + p, block))
            p = q
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))

    def search(self, words: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(text, place of the item, best score) of all texts given by terms_of."""
        if not len(self.terms) or not len(words):
            return
        passage, term, text_of = self.passages(words, at)
        need = threshold - 1e-9
        may = np.bincount(passage, self.most[term], minlength=len(text_of)) >= need
        number = np.cumsum(may) - 1
        kept = may[passage]
        passage, term, asked = number[passage[kept]], term[kept], np.flatnonzero(may)
        cut = np.searchsorted(passage, np.arange(len(asked) + 1))
        best: dict[tuple[int, int], float] = {}
        owner, block = self.open_blocks(passage, term, len(asked), need)
        edges = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)]), len(owner))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p = owner[a]
            for e, score in self.retrieve(term[cut[p] : cut[p + 1]], block[a:b], need):
                key = int(text_of[asked[p]]), int(self.item[e])
                best[key] = max(best.get(key, 0.0), score)
        for (t, k), score in best.items():
            yield t, k, score

    def overlaps(self, item: int, words: np.ndarray, have: dict[int, np.ndarray]) -> list[float]:
        """Shares of the shingles of question, answer and whole item that the document has; have keeps the document's."""
        out = []
        for width, want in self.parts[item]:
            if not width:
                out.append(1.0)
                continue
            if width not in have:
                have[width] = shingles(words, width) if len(words) >= width else np.zeros(0, np.uint64)
            out.append(float(np.isin(want, have[width], assume_unique=True).mean()))
        return out


def build_index(items: DataFrame, width: int) -> DataFrame:
    """shard, size, index (a pickled Index) of items (item, text), with BM25 statistics over all of them."""

    @tidy
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, at = terms_of(batch["text"].tolist())
            of = np.repeat(np.arange(len(batch)), np.diff(at))
            rows = pd.DataFrame({"item": batch["item"].to_numpy()[of], "entry": (np.arange(len(words)) - at[of]) // ENTRY_WORDS, "term": words.view(np.int64)})
            rows = rows.groupby(["item", "entry", "term"], sort=False).size().rename("tf").reset_index()
            yield rows.assign(words=rows.groupby(["item", "entry"])["tf"].transform("sum")) if len(rows) else rows.assign(words=0)

    rows = staged(items.mapInPandas(entries, "item long, entry long, term long, tf long, words long"), "benchmark-terms")
    n, mean = rows.groupBy("item", "entry").agg(F.first("words").alias("words")).agg(F.count(F.lit(1)), F.avg("words")).first()
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / (mean or 1.0)))
    weighed = rows.join(df, "term").select("item", "entry", "term", (idf * tf).alias("w"))
    best = weighed.groupBy("item", "entry").agg(F.sum("w").alias("best"))
    shard = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n // SHARD_ENTRIES)))).cast("int").alias("shard")
    postings = weighed.join(best, ["item", "entry"]).select(shard, "item", "entry", "term", (F.col("w") / F.col("best")).alias("weight"))

    def build(postings: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if not len(postings):
            return pd.DataFrame({"shard": [], "size": [], "index": []}).astype({"shard": int, "size": int})
        blob = pickle.dumps(Index(postings, texts, width))
        return pd.DataFrame({"shard": postings["shard"].iloc[:1], "size": [len(blob)], "index": [blob]})

    built = postings.groupBy("shard").cogroup(items.select(shard, "item", "text").groupBy("shard")).applyInPandas(tidy(build), "shard int, size long, index binary")
    return staged(built, "benchmark-index")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """found_items without text_key."""
    return found_items(docs, benchmark, threshold, overlap, width, id_col, text_col, item_id_col, item_text_col).drop("text_key")


def found_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, text_key (of the document), item_id, bm25 (share of a perfect
    match), question_overlap, answer_overlap, item_overlap.

    Retrieved from `threshold` on; contained if question and answer both overlap by `overlap`.

    Defined results: null and empty texts contain nothing, and null or wordless items are in nothing; an item that
    occurs twice in a document gives one row; repeated rows of documents or items each give their own; empty tables
    give an empty result; other columns are ignored.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(id_in(id_col), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    wanted = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), text_key(item_text_col).alias("item"))
    index = build_index(wanted.groupBy("item").agg(F.min("text").alias("text")), width)
    waves, held_bytes = [[]], 0
    for r in index.select("shard", "size").orderBy("shard").collect():  # a row per shard
        if waves[-1] and held_bytes + r["size"] > WAVE_BYTES:
            waves, held_bytes = [*waves, []], 0
        waves[-1].append(r["shard"])
        held_bytes += r["size"]
    every = None
    for wave in waves:
        shared = docs.sparkSession.sparkContext.broadcast([bytes(r["index"]) for r in index.where(F.col("shard").isin(wave)).orderBy("shard").collect()])
        found = _search(rows, shared, threshold, overlap)
        if len(waves) > 1:  # one wave after the other, so that executors hold one at a time
            found = staged(found, "found-items")
            shared.unpersist()
        every = found if every is None else every.unionByName(found)
    return every.join(F.broadcast(wanted.select("item", "item_id")) if wanted.count() <= 1_000_000 else wanted.select("item", "item_id"), "item").select(
        id_out(), "text_key", "item_id", "bm25", "question_overlap", "answer_overlap", "item_overlap"
    )


def _search(rows: DataFrame, shared: Broadcast, threshold: float, overlap: float) -> DataFrame:
    """doc_id, text_key, item and scores of the items of a wave in rows; shared has the wave's shards."""
    version = uuid.uuid4().hex
    columns = ["doc_id", "text_key", "item", "bm25", "question_overlap", "answer_overlap", "item_overlap"]

    @tidy(keep="contamination")
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = held("contamination index", lambda: [pickle.loads(b) for b in shared.value], version)
        for batch in batches:
            texts, ids, keys, found = batch["text"].tolist(), batch["doc_id"].tolist(), batch["text_key"].tolist(), []
            for a, b in chunked(texts, 2_000_000):
                words, at = terms_of(texts[a:b])
                have: dict[int, dict[int, np.ndarray]] = {}
                for part in loaded:
                    for t, k, score in part.search(words, at, threshold):
                        q, ans, whole = part.overlaps(k, words[at[t] : at[t + 1]], have.setdefault(t, {}))
                        if q >= overlap and ans >= overlap:
                            found.append((ids[a + t], keys[a + t], int(part.items[k]), round(score, 6), round(q, 6), round(ans, 6), round(whole, 6)))
            yield pd.DataFrame(found, columns=columns)

    return rows.mapInPandas(search, "doc_id long, text_key long, item long, bm25 double, question_overlap double, answer_overlap double, item_overlap double")

"""LM scoring: stupid-backoff scores over n-gram counts of the whole corpus.

Every task explodes the words of its documents into n-grams (one word up to `order`), blocks of documents at a time,
and sums equal ones within the block. The n-grams go to shards by the leading bits of their hash. A shard adds the
counts of all blocks, which makes it one partition of the count tables, and joins them back to each block's n-grams;
a block's texts meet their counts once more and are summed per document. Between shards and blocks n-grams travel
sorted and packed, many to a row: that is what keeps a corpus' worth of n-grams small enough to shuffle.

S(w | context) is count(context w) / count(context) if the n-gram occurs min_count times or more, else `alpha` times S
with a context one word shorter, down to count(w) / all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chain, chunked, id_in, id_out, mix64, pack_frame, staged, tidy, unpack_frame, word_hashes
from .quality import block_key

BLOCK_CHARS = 4_000_000
#: Characters of the corpus to a shard; a shard's n-grams are what one task holds at once.
SHARD_CHARS, LEAST_SHARD_BITS = 16_000_000, 6


def ngrams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the n-grams that end at each word, for n from 1, 0 where the text has fewer words; words' texts)."""
    words, at = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    out, place = [mix64(words + np.uint64(1))], np.arange(len(words)) - at[of]
    for n in range(2, order + 1):
        longer = np.zeros(len(words), np.uint64)
        h = words[: max(0, len(words) - n + 1)]
        for i in range(1, n):
            h = chain(h, words[i : len(words) - n + 1 + i])
        longer[n - 1 :] = mix64(h + np.uint64(n))
        out.append(np.where(place >= n - 1, longer, np.uint64(0)))
    return out, of


def distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, places of all grams among them, counts); the hash 0 stands for no n-gram."""
    hashes, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return hashes, inverse, np.bincount(inverse, minlength=len(hashes))


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes, those of like significance together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def _expand(blob: bytes, dtype: str) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, list[str]]]:
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in chunked(texts, BLOCK_CHARS):
            yield block_key(batch["doc_id"].iloc[a:b], texts[a:b]), batch.iloc[a:b], texts[a:b]


def shard_counts(docs: DataFrame, order: int, shard_bits: int) -> DataFrame:
    """block, shard, counts: for each block and shard, the corpus-wide counts of its distinct n-grams in hash order."""

    @tidy
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, texts in _blocks(batches):
            hashes, _, n = distinct(ngrams(texts, order)[0])
            edges = np.searchsorted(hashes >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1).astype(np.uint64))
            rows = [(s, key, _squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))), _squeeze(n[a:b].astype("<u4"))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pd.DataFrame(rows, columns=["shard", "block", "hashes", "n"])

    @tidy
    def join(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(_expand(h, "<u8"), dtype=np.uint64) for h in group["hashes"]]
        sizes = [len(p) for p in parts]
        table, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(place, np.concatenate([_expand(n, "<u4") for n in group["n"]]), minlength=len(table)).astype("<u8")
        ends = np.cumsum(sizes)
        return pd.DataFrame({"block": group["block"].to_numpy(), "shard": group["shard"].to_numpy(), "counts": [_squeeze(counts[place[e - s : e]]) for e, s in zip(ends, sizes, strict=True)]})

    exploded = docs.mapInPandas(explode, "shard int, block long, hashes binary, n binary")
    return exploded.groupBy("shard").applyInPandas(join, "block long, shard int, counts binary")


def lm_scores(docs: DataFrame, order: int = 2, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_backed_off, score (sum of ln S), mean_score (a word).

    Defined results: words are lower-cased (A-Z) runs of anything but white space; null and empty texts have no words,
    score 0 and a null mean; repeated rows count as often as they stand; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(id_in(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shard_bits = max(LEAST_SHARD_BITS, (chars // SHARD_CHARS).bit_length())
    schema = "doc_id long, n_words long, n_unigrams long, n_backed_off long, partial double"

    @tidy
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, block, _ in _blocks(batches):
            yield pd.DataFrame({"block": [key], "docs": [pack_frame(block)]})

    @tidy
    def score(answers: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("shard")
        given = np.concatenate([_expand(c, "<u8") for c in answers["counts"]]) if len(answers) else np.zeros(0, "<u8")
        if not len(packed):
            raise ValueError("a block's counts came without its texts: the input changed between two reads")
        out = []
        for n, blob in enumerate(packed["docs"]):
            block = unpack_frame(blob)
            grams, of = ngrams(block["text"].tolist(), order)
            hashes, place, _ = distinct(grams)
            # rows that repeat a whole block share its key: each copy asked for the same n-grams
            copies = max(1, len(given) // max(1, len(hashes)))
            if len(given) != copies * len(hashes):
                raise ValueError("a block's counts do not fit its texts: the input changed between two reads")
            mine = given if copies == 1 else _first_copy(answers)
            count = [mine[p].astype(np.float64) for p in np.split(place, order)] if len(hashes) else [np.zeros(0)] * order
            value, open_, off = np.zeros(len(of)), np.ones(len(of), bool), np.zeros(len(of), np.int64)
            for k in range(order, 1, -1):
                there = open_ & (grams[k - 1] != 0)
                use = there & (count[k - 1] >= min_count)
                before = np.concatenate(([1.0], count[k - 2][:-1])) if len(of) else count[k - 2]
                value[use] += np.log(count[k - 1][use] / before[use])
                off += there & ~use
                open_ &= ~use
            value[open_] += np.log(count[0][open_])
            value += off * np.log(alpha)
            size = len(block)
            sums = lambda w, m=size, o=of: np.bincount(o, w, minlength=m)
            out.append(pd.DataFrame({"doc_id": block["doc_id"].to_numpy(), "n_words": np.bincount(of, minlength=size), "n_unigrams": sums(open_).astype(np.int64), "n_backed_off": sums(off).astype(np.int64), "partial": sums(value)}))
        return pd.concat(out)

    def _first_copy(answers: pd.DataFrame) -> np.ndarray:
        return np.concatenate([_expand(c, "<u8") for c in answers.drop_duplicates("shard")["counts"]])

    texts = rows.mapInPandas(pack, "block long, docs binary")
    scored = shard_counts(rows, order, shard_bits).groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(score, schema)
    scored = staged(scored, "lm-partial-scores")
    words = float(scored.agg(F.sum("n_words")).first()[0] or 1)
    total = F.col("partial") - F.col("n_unigrams") * F.log(F.lit(words))
    return scored.select(id_out(), "n_words", "n_backed_off", total.alias("score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"))

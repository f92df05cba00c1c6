"""Token-ID output: whole texts to token ids, in Simple-8b records that Spark writes and reads.

Documents are range-partitioned and sorted by the order columns, so that the files hold them in that order. A record
(one row of a Parquet folder) has the ids of consecutive documents in Simple-8b words with the word offset of every
block, and the documents' ids and lengths. Records are numbered within their file part; a document's global start is
what the earlier parts and records hold, which the reader sums from the records' totals.

The tokenizer's model encodes each distinct piece once: texts are cut where its own pre-tokenizer always cuts, and only
texts of characters on which that is certain; any other text goes through the tokenizer whole. Cutting and looking up
are numpy over a million characters at a time. Pieces are told apart by 64-bit hashes of their characters and length:
with MOST_PIECES of them the chance that any two agree is below 1 in 10^7.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from ._shared import _BASE, _BASE_INVERSE, _powers, chunked, held, id_in, id_out, mix64, shared_dir, tidy

END_ID = 2
RECORD_CHARS = 1_000_000
RECORDS = "part int, seq int, n_docs int, n_ids long, doc_ids binary, lens binary, lens_at binary, words binary, words_at binary"
#: Pieces whose ids a worker keeps; beyond that the half that was not used for longest goes.
MOST_PIECES = 1_000_000
#: Letters, numbers, white space and all others among the characters that are cut here, as ranges.
CLASSES = {
    1: "AZ az ªª µµ ºº ÀÖ Øö øɏ",
    2: "09 ²³ ¹¹ ¼¾",
    3: "\t\r",
    4: "\x00\x08 \x0e\x1f !/ :@ [` {\x7f ¡© «± ´´ ¶¸ »» ¿¿ ×× ÷÷ ‐‧ ₠₿",
}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for letters from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def class_table() -> np.ndarray:
    """The class of each code point; 0 for those that are not cut here, as is the last for all beyond."""
    out = np.zeros(ord("₿") + 2, np.uint8)
    for kind, ranges in CLASSES.items():
        for low, high in ranges.split(" "):
            out[ord(low) : ord(high) + 1] = kind
    out[32] = 3
    return out


TABLE = class_table()


def piece_starts(codes: np.ndarray, classes: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of many texts, which begin at texts_at.

    A piece is a run of one class of characters. Of white space before other characters the last one is a piece of its
    own, or the beginning of the next piece if it is a space. An apostrophe that begins a run (without a space) takes
    along the s, t, m, d, re, ve or ll behind it.
    """
    n = len(codes)
    edge = np.zeros(n + 1, bool)  # where texts begin and end
    edge[texts_at] = edge[n] = True
    starts = edge.copy()
    starts[1:n] |= classes[1:] != classes[:-1]
    begin = np.flatnonzero(starts[:n])
    end = np.append(begin[1:], n)
    space = (classes[begin] == 3) & ~edge[end]
    starts[end[space] - 1] = True
    starts[end[space & (codes[end - 1] == 32)]] = False
    mark = (codes[begin] == 39) & (end - begin == 1) & starts[begin] & ~edge[end]
    at = end[mark]
    at = at[classes[at] == 1]
    one = np.isin(codes[at], [ord(c) for c in "stmd"])
    second = np.where(edge[at + 1], 0, codes[np.minimum(at + 1, n - 1)])
    two = np.isin(codes[at] * 256 + second, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (second < 256)
    starts[at[one | two]] = False
    starts[at[one] + 1] = starts[at[two] + 2] = True
    return np.flatnonzero(starts[:n])


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer file, keeping the ids of pieces seen before by their hash."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        pre = self.whole.pre_tokenizer
        self.cuts = self.whole.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        self.letters, self.tick = byte_letters(), 0
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at = self.n = self.used = np.zeros(0, np.int64)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Keep the ids that the tokenizer's model gives pieces; keys are sorted and not yet kept."""
        ends = np.cumsum([len(p.encode()) for p in pieces]).tolist()
        shown, tokenize = "".join(pieces).encode().decode("latin-1").translate(self.letters), self.whole.model.tokenize
        ids, n, a = array("I"), array("q"), 0
        for b in ends:
            found = [t.id for t in tokenize(shown[a:b])]
            ids.extend(found)
            n.append(len(found))
            a = b
        n = np.array(n, np.int64)
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(n) - n)
        self.n, self.used = np.insert(self.n, where, n), np.insert(self.used, where, self.tick)
        self.keys, self.flat = np.insert(self.keys, where, keys), np.concatenate((self.flat, np.array(ids, np.uint32)))

    def forget(self) -> None:
        """Drop the half of the pieces that was not used for longest, but none of the last call's."""
        keep = self.used >= min(self.tick, int(np.median(self.used)) + 1)
        self.flat = _gathered(self.flat, self.at[keep], self.n[keep])
        self.keys, self.n, self.used = self.keys[keep], self.n[keep], self.used[keep]
        self.at = np.cumsum(self.n) - self.n

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all pieces of the texts among those kept, pieces of each text)."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        at = piece_starts(codes, TABLE[codes], begin[sizes > 0])
        end = np.append(at[1:], len(codes))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), dtype=np.uint64)))
        hashes = mix64((sums[end] - sums[at]) * _powers(_BASE_INVERSE, len(codes))[at] + (end - at).astype(np.uint64))
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn(keys[new], [joined[a:b] for a, b in zip(at[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        self.used[place] = self.tick
        return place[inverse], np.diff(np.searchsorted(at, np.append(begin, len(codes))))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; the texts' lengths with it)."""
        self.tick += 1
        if len(self.keys) > MOST_PIECES:
            self.forget()
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        odd = np.bincount(np.repeat(np.arange(len(texts)), sizes)[TABLE[np.minimum(codes, len(TABLE) - 1)] == 0], minlength=len(texts)) > 0
        del codes
        short = [i for i, t in enumerate(texts) if self.cuts and not odd[i] and not any(s in t for s in self.special)]
        others = sorted(set(range(len(texts))) - set(short))
        place, counts = self.cut([texts[i] for i in short])
        flat, at, n = self.flat, self.at[place], self.n[place]
        held = np.concatenate(([0], np.cumsum(n)))
        lens = np.zeros(len(texts), np.int64)
        lens[short] = np.diff(held[np.concatenate(([0], np.cumsum(counts)))])
        whole = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)] if others else []
        lens[others] = [len(w) for w in whole]
        ends = np.cumsum(lens + 1)
        out = np.full(int(ends[-1]) if len(texts) else 0, end_id, np.uint32)
        mine = np.zeros(len(out), bool)
        for i in short:
            mine[ends[i] - lens[i] - 1 : ends[i] - 1] = True
        out[mine] = _gathered(flat, at, n)
        for i, w in zip(others, whole, strict=True):
            out[ends[i] - lens[i] - 1 : ends[i] - 1] = w
        return out, lens + 1


def _gathered(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at `at` and are n long, one after the other."""
    before = np.cumsum(n) - n
    return flat[np.repeat(at - before, n) + np.arange(int(n.sum()))]


def encoder_for(tokenizer_json: str) -> Encoder:
    """The worker's encoder of a tokenizer file, kept until a task of another kind runs there."""
    return held("encoder", lambda: Encoder(tokenizer_json), hashlib.sha256(tokenizer_json.encode()).hexdigest())


def write_tokens(docs: DataFrame, path: str, order: list[str], tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text and the order columns) and write their records to the folder `path`."""
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver: executors need not have the file
        tokenizer_json = f.read()

    @tidy(keep="encoder")
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seq = encoder_for(tokenizer_json), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts, RECORD_CHARS):
                ids, lens = encoder.encode(texts[a:b], end_id)
                words, words_at = simple8b.encode(ids)
                packed, packed_at = simple8b.encode(lens)
                doc_ids = batch["doc_id"].iloc[a:b]
                yield pd.DataFrame([(int(batch["part"].iloc[a]), seq, b - a, len(ids), doc_ids.astype("<i8").to_numpy().tobytes(), packed.tobytes(), packed_at.astype("<u4").tobytes(), words.tobytes(), words_at.astype("<u4").tobytes())], columns=[c.split()[0] for c in RECORDS.split(", ")])
                seq += 1

    placed = docs.select(id_in("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"order_{i}") for i, c in enumerate(order)))
    # rows of equal order are dealt out by a hash of the text, and rows that repeat that too by where they stand
    placed = placed.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    by = [*(f"order_{i}" for i in range(len(order))), "tie", "row"]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    placed.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInPandas(encode, RECORDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the folder `path`: doc_id, start, n_tokens, ids_crc32, ids (array of long)."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    records = spark.read.schema(RECORDS).parquet(path)
    totals = records.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", before(Window.orderBy("part")).alias("part_start"))  # a row per file part
    seqs = records.select("part", "seq", F.col("n_ids").alias("held"))
    seqs = seqs.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("seq_start"))
    starts = seqs.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    @tidy
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                words = lambda x: np.frombuffer(x, "<u8")
                at = lambda x: np.frombuffer(x, "<u4").astype(np.int64)
                lens = simple8b.decode(words(r.lens), at(r.lens_at), r.n_docs).astype(np.int64)
                ids = simple8b.decode(words(r.words), at(r.words_at), r.n_ids).astype("<u4")
                ends, raw = np.cumsum(lens), ids.tobytes()
                out = pd.DataFrame({"part": r.part, "seq": r.seq, "doc_id": np.frombuffer(r.doc_ids, "<i8"), "inside": ends - lens, "n_tokens": lens, "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, lens, strict=True)]})
                if with_ids:
                    out["ids"] = [ids[e - n : e].astype(np.int64) for e, n in zip(ends, lens, strict=True)]
                yield out

    out = records.mapInPandas(decode, schema).join(starts, ["part", "seq"])
    return out.select(id_out(), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, order: list[str] | None = None, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back: doc_id, start, n_tokens, ids_crc32, a row per row of docs.

    Defined results: null and empty texts have the end id alone; rows of equal order follow each other by a hash of the text, however
    many they are; a null
    id comes first; an empty table gives an empty result; other columns are ignored.
    """
    import uuid

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    order = order or [id_col]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"by_{i}") for i, c in enumerate(order)))
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(chosen, path, [f"by_{i}" for i in range(len(order))], tokenizer_path)
    return _decoded(docs.sparkSession, path, False)

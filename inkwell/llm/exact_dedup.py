"""Exact dedup with counting quotient filters.

Every task builds counting quotient filters over the 64-bit fingerprints of its partition, one per fingerprint range. The
filters of a range merge losslessly: their sorted remainders are merged and the counts of equal ones added.
Fingerprints with a count above one go on to byte verification: only rows with such a fingerprint have their texts
grouped, by the whole normalised text, so a fingerprint collision cannot join two texts.

Defined results: null text counts as empty; null ids lose to any other; rows that repeat both id and text count
separately in group_size and one of them is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ascii_lower, join_skewed, staged, tidy

#: Fingerprints that one merged range holds at most on average, that a task gathers for its filters, and repeated
#: fingerprints that may be broadcast.
RANGE_ROWS, TASK_ROWS, BROADCAST_ROWS = 2_000_000, 4_000_000, 2_000_000


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted, distinct fingerprints of so many bits, with about as many quotients.

    Layout: slots, counters, quotient bits; a bit per quotient (occupied); a bit per slot (end of its run); remainders
    in slot order; then (slot, count) of the slots that count more than one.
    """
    quotient_bits = len(fingerprints).bit_length()
    remainder_bits = bits - quotient_bits
    quotients = (fingerprints >> np.uint64(remainder_bits)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotients] = True
    run_end = np.append(quotients[1:] != quotients[:-1], True)[: len(quotients)]
    width = -(-remainder_bits // 8)
    remainders = (fingerprints & np.uint64((1 << remainder_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    return b"".join((struct.pack("<IIB", len(fingerprints), len(many), quotient_bits), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), remainders.tobytes(), many.astype("<u4").tobytes(), counts[many].astype("<u8").tobytes()))


def read_filter(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    slots, many, quotient_bits = struct.unpack_from("<IIB", blob)
    remainder_bits = bits - quotient_bits
    at, width = struct.calcsize("<IIB"), -(-remainder_bits // 8)

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype, n, at)
        at += out.nbytes
        return out

    occupied = np.flatnonzero(np.unpackbits(take("u1", -(-(1 << quotient_bits) // 8))))
    run_end = np.unpackbits(take("u1", -(-slots // 8)))[:slots].astype(np.int64)
    remainders = np.zeros((slots, 8), np.uint8)
    remainders[:, :width] = take("u1", slots * width).reshape(slots, width)
    counts = np.ones(slots, np.int64)
    where = take("<u4", many)
    counts[where] = take("<u8", many).astype(np.int64)
    quotients = occupied[np.cumsum(run_end) - run_end].astype(np.uint64)
    return (quotients << np.uint64(remainder_bits)) | remainders.reshape(-1).view("<u8"), counts


def merge_filters(blobs: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge filters by their sorted fingerprints, adding the counts of equal ones."""
    parts = [read_filter(b, bits) for b in blobs]
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """fp, copies of the fingerprints that occur more than once; prints has one column fp (long)."""
    range_bits = max(6, (max(1, rows) // RANGE_ROWS).bit_length())
    bits = 64 - range_bits
    low = np.uint64((1 << bits) - 1)

    def filters(prints: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(prints).view(np.uint64), return_counts=True)
        ranges = (values >> np.uint64(bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        return pd.DataFrame([(int(ranges[a]), build_filter(values[a:b] & low, counts[a:b], bits)) for a, b in zip(first, np.append(first[1:], len(ranges)), strict=True)], columns=["part", "filter"])

    @tidy
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch["fp"].to_numpy(np.int64))
            n += len(batch)
            if n >= TASK_ROWS:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, counts = merge_filters(list(group["filter"]), bits)
        many = counts > 1
        full = (values[many] | (np.uint64(key[0]) << np.uint64(bits))).view(np.int64)
        return pd.DataFrame({"fp": full, "copies": counts[many]})

    return prints.mapInPandas(build, "part int, filter binary").groupBy("part").applyInPandas(merge, "fp long, copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows, n_rows = rows.select("doc_id", "norm", F.xxhash64("norm").alias("fp")), docs.count()
    repeated = staged(repeated_fingerprints(rows.select("fp"), n_rows), "repeated-fingerprints")
    if repeated.count() <= BROADCAST_ROWS:
        routed = rows.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:
        routed = join_skewed(rows, repeated.withColumnRenamed("copies", "n"), "fp", n_rows, "doc_id", how="left_semi")
    groups = routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = staged(groups.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "n", F.col("n").alias("group_size")), "equal-texts")
    hashed = rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    out = join_skewed(hashed, groups, "text_sha256", n_rows, "doc_id", how="left")
    alone = F.col("group_size").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # Rows that repeat id and text of the one that stays: one of them does.
    candidates = out.where(stays & (F.col("group_size") > 1))
    repeats = staged(candidates.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    if repeats.isEmpty():
        return out.withColumn("kept", stays).select(columns)
    marked = join_skewed(out, repeats.withColumn("twice", F.lit(True)), "text_sha256", n_rows, "doc_id", how="left")
    several = staged(marked.where(stays & F.col("twice")).withColumn("part", F.spark_partition_id()), "rows-that-stay")
    first = several.groupBy("text_sha256").agg(F.min("part").alias("first"))
    nth = F.row_number().over(Window.partitionBy("text_sha256", "part").orderBy("doc_id"))
    several = several.join(first, "text_sha256").withColumn("kept", (F.col("part") == F.col("first")) & (nth == 1))
    return marked.where(~(stays & F.coalesce("twice", F.lit(False)))).withColumn("kept", stays).select(columns).unionByName(several.select(columns))

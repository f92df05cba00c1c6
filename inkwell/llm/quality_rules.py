"""Quality rules: counts with fixed limits, and a calibrated logistic regression of hashed n-grams.

The rules count words, symbols, repeated lines and repeated stretches of each whole text. The model reads words, pairs of
words and four-letter stretches, hashed to 2^BITS features; each kind's features are divided by the root of how many the
text has. It is trained by MLlib on labelled documents: all of them up to TRAIN_ROWS, beyond that about TRAIN_ROWS whose
ids have the smallest hashes. One labelled document in HELD_OUT takes no part in training: on those, a second regression
turns the model's margin into a probability (Platt scaling).

All documents are then scored in Arrow batches, each occurrence's weight looked up in the table of 2^BITS weights, and
held against fixed thresholds of the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chain, chunked, id_in, id_out, mix64, staged, text_key, tidy, word_hashes

BITS, LETTERS = 17, 4
#: Labelled documents that the model is fitted on at most (about); one in HELD_OUT of them calibrates it.
TRAIN_ROWS, HELD_OUT = 12_000, 4
CHUNK_CHARS = 1_000_000
#: Rules: least words, and the share of words in repeated stretches of REPEAT_WORDS words that a text may have at most.
LEAST_WORDS, REPEAT_WORDS, MOST_REPEATED = 20, 8, 0.3
#: Documents below the first probability are dropped; from the second on they are surely good.
DROP_BELOW, SURE_FROM = 0.5, 0.9

_CODES = np.arange(256)
_IS_SPACE = np.isin(_CODES, [32, 9, 10, 11, 12, 13])
_IS_SYMBOL = np.isin(_CODES, list(b"#*$%&|<>"))
_BEGINS_LETTER = (_CODES & 0xC0) != 0x80
_SPACES = " \t\n\x0b\x0c\r"


def sums_by(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive places."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])


def repeated_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of REPEAT_WORDS words that it holds more than once."""
    n = len(words) - REPEAT_WORDS + 1
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if n < 1:
        return np.zeros(len(at) - 1, np.int64)
    window = words[:n]
    for i in range(1, REPEAT_WORDS):
        window = chain(window, words[i : n + i])
    whole = np.flatnonzero(of[:n] == of[REPEAT_WORDS - 1 :])
    keys = chain(window[whole], of[whole].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = whole[order[np.append(same, False) | np.append(False, same)]] if len(order) else whole
    change = np.zeros(len(words) + 1, np.int64)
    change[twice] += 1
    np.add.at(change, twice + REPEAT_WORDS, -1)
    return sums_by(np.cumsum(change[:-1]) > 0, at)


def rule_counts(texts: list[str], words: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; words are the texts' word hashes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    lines = ([x for x in t.split("\n") if x.strip(_SPACES)] if "\n" in t else [] for t in texts)
    return pd.DataFrame({
        "n_words": np.diff(at), "word_chars": sums_by(_BEGINS_LETTER[data] & ~_IS_SPACE[data], edges), "n_symbols": sums_by(_IS_SYMBOL[data], edges),
        "n_dup_lines": [len(x) - len(set(x)) for x in lines], "n_repeat_words": repeated_words(words, at),
    })


def features(texts: list[str], words: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, the buckets of all occurrences and the texts they are in."""
    shift = np.uint64(64 - BITS)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    pair = np.flatnonzero(of[1:] == of[:-1])
    pairs = chain(words[pair], words[pair + 1])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = max(0, len(codes) - LETTERS + 1)
    packed = codes[:n]
    for i in range(1, LETTERS):
        packed = packed * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
    whole = letter_of[:n] == letter_of[LETTERS - 1 :] if n else np.zeros(0, bool)
    letters = mix64(packed[whole] + np.uint64(0x5851F42D4C957F2D))
    return [((np.concatenate((mix64(words + np.uint64(1)), pairs)) >> shift).astype(np.int64), np.concatenate((of, of[pair]))), ((letters >> shift).astype(np.int64), letter_of[:n][whole])]


def margins(texts: list[str], words: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(texts))
    for bucket, of in features(texts, words, at):
        total += np.bincount(of, weights[bucket], len(texts)) / np.sqrt(np.maximum(np.bincount(of, minlength=len(texts)), 1))
    return total


def feature_rows(rows: DataFrame) -> DataFrame:
    """doc_id, label, held, buckets, values of rows (doc_id, label, held, text): sparse vectors as packed arrays."""

    @tidy
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts, CHUNK_CHARS):
                words, at = word_hashes(texts[a:b], lower=False)
                keys, values = [], []
                for bucket, of in features(texts[a:b], words, at):
                    found, n = np.unique(of << BITS | bucket, return_counts=True)
                    keys.append(found)
                    values.append(n / np.sqrt(np.bincount(of, minlength=b - a))[found >> BITS])
                keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                values = np.bincount(inverse, np.concatenate(values), len(keys))
                cut = np.searchsorted(keys >> BITS, np.arange(b - a + 1))
                bucket = (keys & ((1 << BITS) - 1)).astype(np.int32)
                out = batch.iloc[a:b][["label", "held"]].copy()
                out["buckets"] = [bucket[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                out["weights"] = [values[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield out

    return rows.mapInPandas(vectors, "label double, held boolean, buckets binary, weights binary")


class Model:
    """Weights of the features, and the calibration of the margin: probability 1 / (1 + exp(-(slope * margin + offset)))."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, regularisation: float = 1e-3, rounds: int = 60) -> Model | None:
    """The model of docs (doc_id, text_key, text) with labels (doc_id, quality 0 or 1); None unless both labels occur. A
    document with both labels counts as 0; of rows that share an id the one with the smallest text key is taken."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < TRAIN_ROWS * 1_000_000 // n)
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", "text_key").alias("text"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0)
    rows = staged(feature_rows(rows), "training-features")
    seen = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}  # at most 4
    if {(False, 0.0), (False, 1.0)} - seen:
        return None
    sparse = F.udf(lambda buckets, weights: Vectors.sparse(1 << BITS, np.frombuffer(buckets, np.int32), np.frombuffer(weights, np.float64)), VectorUDT())
    model = LogisticRegression(maxIter=rounds, regParam=regularisation, standardization=False).fit(rows.where("not held").select("label", sparse("buckets", "weights").alias("features")))
    weights, intercept = model.coefficients.toArray(), float(model.intercept)
    if {(True, 0.0), (True, 1.0)} - seen:
        return Model(weights, 1.0, intercept)

    @F.pandas_udf("double")
    def margin(buckets: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([float(weights[np.frombuffer(b, np.int32)] @ np.frombuffer(v, np.float64)) for b, v in zip(buckets, values, strict=True)])

    platt = LogisticRegression(maxIter=100, regParam=1e-4, standardization=False).fit(rows.where("held").select("label", array_to_vector(F.array(margin("buckets", "weights"))).alias("features")))
    return Model(weights, float(platt.coefficients[0]), float(platt.intercept))


def quality_rules(docs: DataFrame, labels: DataFrame, drop_below: float = DROP_BELOW, sure_from: float = SURE_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    probability (of good quality), band (drop, doubtful or sure; by the two thresholds), text_key.

    Defined results: null text counts as empty; texts with no feature have the probability of an average text of no
    evidence; without labels of both kinds there is no model: probability and band are null and the rules alone decide;
    repeated rows each have their own result, labels may repeat and may name no document; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", text_key("text"))
    model = fit(rows, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    @tidy
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts, CHUNK_CHARS):
                words, at = word_hashes(texts[a:b], lower=False)
                out = rule_counts(texts[a:b], words, at)
                out.insert(0, "doc_id", batch["doc_id"].to_numpy()[a:b])
                out["probability"] = model.probability(margins(texts[a:b], words, at, model.weights)) if model else np.nan
                out["text_key"] = batch["text_key"].to_numpy()[a:b]
                yield out

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = rows.mapInPandas(score, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, probability double, text_key long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    probability = F.nanvl("probability", F.lit(None).cast("double"))
    band = F.when(probability < drop_below, "drop").when(probability < sure_from, "doubtful").when(probability.isNotNull(), "sure")
    kept = ~failed & F.coalesce(probability >= drop_below, F.lit(True))
    return scored.select(id_out(), *counts, failed.alias("base_failed"), kept.alias("kept"), probability.alias("probability"), band.alias("band"), "text_key")

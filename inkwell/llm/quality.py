"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Documents are read in blocks. Each block gives its distinct n-grams (map-side pre-aggregation) with their counts in
trusted documents. Summed over blocks these are the model's counts; every lower order, its continuation counts and
the discounts follow from them in grouped tables, and the probability of each distinct n-gram of the corpus from joins
of those tables by n-gram, order by order, all partitioned by hash. The log-probabilities are then joined back to the
blocks' n-grams, and meet the block's texts once for the perplexity of each document.

The threshold of a language is a quantile of the perplexities of its trusted documents that were held out from
training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chain, chunked, id_in, id_out, mix64, pack_frame, staged, text_key, tidy, unpack_frame

ORDER = 4
BLOCK_CHARS, CHUNK_CHARS = 32_000_000, 500_000
#: One in HELD_OUT trusted documents calibrates thresholds; languages with fewer than LEAST_HELD of them use all languages' threshold.
HELD_OUT, LEAST_HELD = 5, 20
MOST_BROADCAST = 2_000_000


def block_key(ids: pd.Series, texts: list[str]) -> int:
    """Names a block by the ids and texts it holds, so that two passes agree on it or fail to meet. Blocks of the same
    name hold the same."""
    h = xxhash.xxh64(ids.to_numpy(np.int64).tobytes())
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        h.update(len(raw).to_bytes(8, "little"))
        h.update(raw)
    return h.intdigest() >> 1


def gram_hashes(texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first character, text) of every n-gram of every text; the hash covers the language."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(of[: len(of) - ORDER + 1] == of[ORDER - 1 :])
    packed = codes[at]
    for i in range(1, ORDER):
        packed = packed * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
    salt = np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64)
    return chain(mix64(packed), salt[of[at]]), at, of[at]


def tally(texts: list[str], train: np.ndarray, lang: str) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of texts of one language and their counts in those to train on.

    Chunks are merged as sorted hashes; only the distinct n-grams of all become strings, at the end.
    """
    keys, counts, letters = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), "<u4")
    for a, b in chunked(texts, CHUNK_CHARS):
        hashes, at, of = gram_hashes(texts[a:b], [lang] * (b - a))
        found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, train[a:b][of], minlength=len(found)).astype(np.int64)
        codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), "<u4")
        merged, begin, back = np.unique(np.concatenate((keys, found)), return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, n)), minlength=len(merged)).astype(np.int64)
        letters = np.concatenate((letters, codes[at[first][:, None] + np.arange(ORDER)]))[begin]
        keys = merged
    joined = letters.tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], counts


def _blocks(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    texts = batch["text"].tolist()
    for a, b in chunked(texts, BLOCK_CHARS):
        yield block_key(batch["doc_id"].iloc[a:b], texts[a:b]), batch.iloc[a:b]


def block_grams(docs: DataFrame) -> DataFrame:
    """block, lang, gram, trusted: the distinct n-grams of each block of docs (doc_id, lang, text, train) with their
    count in the documents to train on."""

    @tidy
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, block in _blocks(batch):
                for lang, docs_of in block.groupby("lang", sort=False):
                    found, counts = tally(docs_of["text"].tolist(), docs_of["train"].to_numpy(bool), lang)
                    if found:
                        yield pd.DataFrame({"block": key, "lang": lang, "gram": found, "trusted": counts})

    return docs.mapInPandas(grams, "block long, lang string, gram string, trusted long")


def block_texts(docs: DataFrame) -> DataFrame:
    """block, docs: the same blocks' documents, compressed."""

    @tidy
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, block in _blocks(batch):
                yield pd.DataFrame({"block": [key], "docs": [pack_frame(block[["doc_id", "text_key", "lang", "text", "trusted"]])]})

    return docs.mapInPandas(pack, "block long, docs binary")


def model(counts: DataFrame) -> DataFrame:
    """lang, gram, logp for every row of counts (lang, gram, c): Kneser-Ney over the grams with c > 0, scoring all.

    Every lower-order table has distinct suffixes, so a join key never has more rows than there are characters. Only
    the discounts, one row a language and order, are broadcast.
    """
    wanted = {ORDER: counts.select("lang", "gram")}
    seen = {ORDER: counts.where("c > 0")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram")).distinct()
        seen[k] = seen[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
        seen[k] = staged(seen[k], "continuation-counts")
    lower = None
    for k in range(1, ORDER + 1):
        n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = "n1 / (n1 + 2 * n2)"
        discounts = seen[k].groupBy("lang").agg(*n, F.count(F.lit(1)).alias("types")).select(
            "lang", "types",
            F.expr(f"if(n1 > 0 and n2 > 0, least(0.95D, greatest(0.05D, 1 - 2 * ({y}) * n2 / n1)), 0.5D)").alias("d1"),
            F.expr(f"if(n1 > 0 and n2 > 0 and n3 > 0, least(1.9D, greatest(0.1D, 2 - 3 * ({y}) * n3 / n2)), 1D)").alias("d2"),
            F.expr(f"if(n1 > 0 and n3 > 0 and n4 > 0, least(2.85D, greatest(0.15D, 3 - 4 * ({y}) * n4 / n3)), 1.5D)").alias("d3"),
        )
        off = "case when c = 1 then d1 when c = 2 then d2 else d3 end"
        taken = seen[k].join(F.broadcast(discounts), "lang").select("lang", "gram", "c", F.expr(off).alias("d"), F.expr(f"left(gram, {k - 1})").alias("context"))
        contexts = taken.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        rows = wanted[k].withColumn("context", F.expr(f"left(gram, {k - 1})")).withColumn("suffix", F.expr("substring(gram, 2)"))
        if k == 1:  # one context a language
            rows = rows.join(F.broadcast(contexts.drop("context")), "lang", "left").join(F.broadcast(discounts.select("lang", (1 / (F.col("types") + 1)).alias("below"))), "lang", "left")
        else:
            rows = rows.join(contexts, ["lang", "context"], "left").join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"], "left")
        rows = rows.join(taken.select("lang", "gram", (F.col("c") - F.col("d")).alias("own")), ["lang", "gram"], "left")
        lower = rows.select("lang", "gram", F.expr("if(total is null, below, (coalesce(own, 0D) + freed * below) / total)").alias("p"))
    return lower.select("lang", "gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, trusted, n_grams, logp of docs (doc_id, lang, text, trusted, train)."""
    docs = docs.withColumn("text_key", text_key("text"))
    grams = staged(block_grams(docs), "block-grams")
    probability = model(staged(grams.groupBy("lang", "gram").agg(F.sum("trusted").alias("c")), "gram-counts"))
    answers = grams.select("block", "lang", "gram").join(probability, ["lang", "gram"]).where("logp is not null")
    schema = "doc_id long, text_key long, lang string, trusted boolean, n_grams long, logp double"

    @tidy
    def score(known: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        hashes = np.zeros(0, np.uint64)
        values = known["logp"].to_numpy()
        if len(known):
            hashes, _, _ = gram_hashes(known["gram"].tolist(), known["lang"].tolist())
            order = np.argsort(hashes)
            hashes, values = hashes[order], values[order]
        out = []
        for blob in packed["docs"]:
            block = unpack_frame(blob)
            texts, langs = block["text"].tolist(), block["lang"].tolist()
            for a, b in chunked(texts, CHUNK_CHARS):
                asked, _, of = gram_hashes(texts[a:b], langs[a:b])
                n = total = np.zeros(b - a)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
                    there = hashes[place] == asked
                    n = np.bincount(of[there], minlength=b - a)
                    total = np.bincount(of[there], values[place[there]], minlength=b - a)
                out.append(pd.DataFrame({"doc_id": block["doc_id"].to_numpy()[a:b], "text_key": block["text_key"].to_numpy()[a:b], "lang": langs[a:b], "trusted": block["trusted"].to_numpy(bool)[a:b], "n_grams": n.astype(np.int64), "logp": total}))
        if not out:
            raise ValueError("a block's n-grams came without its texts: the input changed between two reads")
        return pd.concat(out)

    return answers.groupBy("block").cogroup(block_texts(docs).groupBy("block")).applyInPandas(score, schema)


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, width: float = 3.0, least_grams: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, text_key, lang, n_grams, perplexity, threshold, keep.

    Trusted are the documents labelled quality 1 and not toxic. A document is rejected if its perplexity exceeds the
    quantile of its language's held-out trusted documents (of least_grams n-grams or more) times exp(width / sqrt(n)),
    n being its n-grams: the mean of few log-probabilities strays further.

    Defined results: null text counts as empty, null lang as ''; texts without n-grams, and those of a language without
    trusted text, are not judged and stay (perplexity null where there is none); repeated rows
    each have their own result and labels may repeat; without any labels all stay; an empty table gives an empty
    result; other columns are ignored.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    rows = docs.select(id_in(id_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    small = good.count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(good) if small else good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    if not small:  # blocks are read twice, and a shuffle may deal rows out otherwise the second time
        rows = staged(rows, "labelled-documents")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    scored = perplexities(rows.withColumn("train", F.col("trusted") & ~held)).withColumn("perplexity", F.expr("if(n_grams > 0, exp(-logp / n_grams), null)"))
    scored = staged(scored.select("doc_id", "text_key", "lang", "trusted", "n_grams", "perplexity"), "perplexities")
    calibrate = scored.where(F.col("trusted") & held & (F.col("n_grams") >= least_grams))
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = calibrate.groupBy("lang").agg(cut.alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_HELD)
    overall = calibrate.agg(cut).first()[0]
    out = scored.join(F.broadcast(by_lang.select("lang", "own")), "lang", "left")  # one row a language
    threshold = F.coalesce("own", F.lit(overall).cast("double")) * F.exp(width / F.sqrt(F.greatest("n_grams", F.lit(1))))
    judged = (F.col("n_grams") > 0) & threshold.isNotNull()
    return out.select(id_out(), "text_key", "lang", "n_grams", "perplexity", threshold.alias("threshold"), (~judged | (F.col("perplexity") <= threshold)).alias("keep"))

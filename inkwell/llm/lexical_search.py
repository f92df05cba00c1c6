"""Ranked lexical search: impact lists and the Best Position Algorithm, for a set of queries against all documents.

Tasks cut the texts of their partition into terms and keep, of each document, its length and the counts of the terms that
any query asks for. These rows are the index; a term's weight and a document's length factor need statistics over all
documents (documents, terms, document frequencies), which are summed from it. A second pass turns blocks of the index into
impact lists, one per term, by falling impact.

A query is answered on a block by the Best Position Algorithm. Every round reads the next places of its lists that no
document seen so far holds; each document found there is looked up in all lists by direct access (the block's forward
index has a document's impacts and its places), which marks all its places as seen and completes its score. The best
position of a list is the end of the stretch from its top that is seen throughout, whether its places were read or came by
direct access. No unseen document scores above the sum of the impacts at the best positions, so a query stops once that
sum is strictly below the k-th best score so far: at equality an unseen document could still tie and have a smaller id.
The k best so far are carried from block to block within a task, so later blocks stop earlier, often at once.

Every task gives k rows a query; the k best of all are taken per query, cut before the shuffle. Queries go to the tasks in
waves of at most WAVE_TERMS terms; the documents are read once for each wave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import _BASE, _BASE_INVERSE, _LOWER_TABLE, _powers, NO_ID, chunked, id_in, id_out, mix64, staged, text_key, tidy

#: Terms of the queries of a wave (16 bytes each in a task), characters that are cut at a time, counts that make a block.
WAVE_TERMS, CHUNK_CHARS, BLOCK_COUNTS = 2_000_000, 2_000_000, 1_000_000
#: Places that a first round reads of every list; each round reads twice as many as the one before.
FIRST_PLACES = 8
SCHEMA = "ids binary, text_keys binary, lengths binary, at binary, terms binary, counts binary, n_documents long, n_terms long"

_IS_TERM = np.ones(256, bool)
_IS_TERM[:128] = False
_IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = True


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts (runs of ASCII letters, digits and all that is beyond ASCII; only A-Z are
    lower-cased), and each text's first as an offset into them."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]).translate(_LOWER_TABLE), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    edge = np.flatnonzero(np.diff(_IS_TERM[data].view(np.int8), prepend=0))
    begin, end = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    hashes = mix64((sums[end] - sums[begin]) * _powers(_BASE_INVERSE, len(data))[begin] + (end - begin).astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(begin, np.cumsum([len(t) + 1 for t in encoded]))))


def index_documents(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Blocks of rows (doc_id, text_key, text): for each document with a wanted term its id, key, length in terms, and the
    counts of its wanted terms (numbers into `wanted`, sorted hashes); with the block's documents and terms in all."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, parts, held, n_documents, n_terms = shared.value, [], 0, 0, 0

        def block() -> pd.DataFrame:
            ids, keys, lengths, sizes, terms, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.concatenate(([0], np.cumsum(sizes)))
            return pd.DataFrame([(ids.tobytes(), keys.tobytes(), lengths.tobytes(), at.astype(np.int64).tobytes(), terms.tobytes(), counts.tobytes(), n_documents, n_terms)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            texts, ids, keys = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64), batch["text_key"].to_numpy(np.int64)
            for a, b in chunked(texts, CHUNK_CHARS):
                hashes, at = terms_of(texts[a:b])
                lengths = np.diff(at)
                n_documents, n_terms = n_documents + int((lengths > 0).sum()), n_terms + len(hashes)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                pairs, counts = np.unique(np.repeat(np.arange(b - a), lengths)[known] * len(vocabulary) + place[known], return_counts=True)
                of, term = np.divmod(pairs, max(len(vocabulary), 1))
                sizes = np.bincount(of, minlength=b - a)
                some = sizes > 0
                parts.append((ids[a:b][some], keys[a:b][some], lengths[some], sizes[some], term.astype(np.int32), counts.astype(np.int64)))
                held += len(term)
                if held >= BLOCK_COUNTS:
                    yield block()
                    parts, held, n_documents, n_terms = [], 0, 0, 0
        if parts:
            yield block()

    return rows.mapInPandas(cut, SCHEMA)


class Block:
    """Documents with their impact lists. Lists follow each other by term, each by falling impact; `place` has, for each
    entry of the forward index (document after document), its place in them."""

    def __init__(self, blocks: list[tuple], weights: np.ndarray, n: int, total: int):
        arrays = [[np.frombuffer(b[i], kind) for b in blocks] for i, kind in enumerate((np.int64, np.int64, np.int64, np.int64, np.int32, np.int64))]
        self.ids, self.keys, lengths = (np.concatenate(arrays[i]) for i in range(3))
        sizes = np.concatenate([np.diff(x) for x in arrays[3]])
        term, tf = np.concatenate(arrays[4]), np.concatenate(arrays[5])
        if len(lengths) and 90 * int(lengths.max()) * n >= 1 << 63:
            factor = np.array([10 + 90 * int(x) * n // total for x in lengths], np.int64)
        else:
            factor = 10 + 90 * lengths * n // max(total, 1)
        document = np.repeat(np.arange(len(sizes)), sizes)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * factor[document]))
        kept = impact > 0
        self.term, self.impact, document = term[kept], impact[kept], document[kept]
        self.at = np.searchsorted(document, np.arange(len(sizes) + 1))
        order = np.lexsort((document, -self.impact, self.term))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.listed, self.listed_impact = document[order], self.impact[order]
        self.list_at = np.searchsorted(self.term[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, k: int, known: list[tuple]) -> list[tuple]:
        """The k best of the block and of `known`, as sorted (-score, id, key, nth) of at most k; nth tells apart rows
        that repeat id and text."""
        begin, end = self.list_at[terms], self.list_at[terms + 1]
        terms, begin, end = terms[end > begin], begin[end > begin], end[end > begin]
        if not len(terms):
            return known
        wanted = np.zeros(len(self.list_at), bool)
        wanted[terms] = True
        seen, met = np.zeros(len(self.place), bool), np.zeros(len(self.ids), bool)
        next_place, step = begin.copy(), FIRST_PLACES  # the place after each list's best position
        while True:
            # before anything is read the top of each list stands for its best position
            at = np.maximum(next_place - 1, begin)
            bound = int(self.listed_impact[at][next_place < end].sum())
            if not bound or (len(known) == k and bound < -known[-1][0]):
                return known
            places = (next_place[:, None] + np.arange(step)).ravel()
            places = places[places < np.repeat(end, step)]
            found = self.listed[places[~seen[places]]]
            found = np.unique(found[~met[found]])
            met[found] = True
            sizes = self.at[found + 1] - self.at[found]
            ends = np.cumsum(sizes)
            entries = np.repeat(self.at[found] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            mine = wanted[self.term[entries]]
            seen[self.place[entries[mine]]] = True
            sums = np.concatenate(([0], np.cumsum(np.where(mine, self.impact[entries], 0))))
            scores = sums[ends] - sums[ends - sizes]
            if len(found) > k:  # those that can't be among the k best are left out before ids are compared
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                if len(known) == k:
                    least = max(least, -known[-1][0])
                found, scores = found[scores >= least], scores[scores >= least]
            ids = self.ids[found]
            order = np.lexsort((self.keys[found], np.where(ids == NO_ID, 1 << 62, ids), ids == NO_ID, -scores))[:k]
            known = sorted([*known, *((-int(scores[i]), bool(ids[i] == NO_ID), int(ids[i]), int(self.keys[found[i]])) for i in order)])[:k]
            # best positions: over all places that are seen from there on
            moving = next_place < end
            while moving.any():
                ahead = next_place[moving, None] + np.arange(2 * step)
                there = ahead < end[moving, None]
                run = np.logical_and.accumulate(there & seen[np.where(there, ahead, 0)], axis=1).sum(axis=1)
                next_place[moving] += run
                moving[moving] = run == 2 * step
            step *= 2


def search_index(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """query (place in `queries`, each the numbers of its terms), score, doc_id, text_key: the k best of every task."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    @tidy
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, weight = shared.value
        best: list[list[tuple]] = [[] for _ in asked]

        def answer(blocks: list[tuple]) -> None:
            block = Block(blocks, weight, n, total)
            for q, terms in enumerate(asked):
                best[q] = block.best(terms, k, best[q])

        held, counts = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                held.append(row[:6])
                counts += len(row[4]) // 4
                if counts >= BLOCK_COUNTS:
                    answer(held)
                    held, counts = [], 0
        if held:
            answer(held)
        found = [(q, -s, i, key) for q, rows in enumerate(best) for s, _, i, key in rows]
        yield pd.DataFrame(found, columns=["query", "score", "doc_id", "text_key"]).astype({"query": "int64", "score": "int64", "doc_id": "int64", "text_key": "int64"})

    return index.mapInPandas(search, "query long, score long, doc_id long, text_key long")


def query_waves(items: DataFrame) -> list[list[tuple[int, int]]]:
    """(item_id, text key) of the items of each wave; only keys and sizes go through the driver, not the texts."""
    waves, held = [[]], 0
    for r in items.select("item_id", "item_key", F.length("text").alias("size")).orderBy("item_id", "item_key").toLocalIterator():
        if waves[-1] and held + r["size"] > WAVE_TERMS:
            waves, held = [*waves, []], 0
        waves[-1].append((r["item_id"], r["item_key"]))
        held += r["size"]
    return waves


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score, text_key (of the document), item_key (of the item's
    text).

    Terms, weights and scores are those of the module's queries: weight floor(1000 * ln((2N + 2) / (2 df + 1))), length
    factor 10 + 90 n N div L, impact weight * (10^9 tf div (1000 tf + 8 factor)); equal scores by ascending doc_id.

    Defined results: null and termless texts of documents count nowhere and are never found, null and termless items find
    nothing; documents with a null doc_id come last among equal scores, then those that share an id by the hash of their
    text; rows of documents that repeat id and text are documents of their own; rows of items that repeat id and text are
    one item, items that share an id with other texts are items of their own (item_key tells them apart); empty tables
    give an empty result; other columns are ignored.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(id_in(id_col), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    asked = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), text_key(item_text_col).alias("item_key"), F.col(item_text_col).alias("text"))
    asked = staged(asked.groupBy("item_id", "item_key").agg(F.min("text").alias("text")), "search-items")
    out = None
    for wave in query_waves(asked):
        found = _search_wave(rows, asked, wave, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_wave(rows: DataFrame, asked: DataFrame, wave: list[tuple[int, int]], k: int) -> DataFrame:
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, *x) for i, x in enumerate(wave)], "query long, item_id long, item_key long")
    matched = asked.join(F.broadcast(names), (asked["item_id"].eqNullSafe(names["item_id"])) & (asked["item_key"] == names["item_key"]))  # a wave's size is bounded
    texts = {r["query"]: r["text"] for r in matched.select("query", "text").toLocalIterator()}
    hashes, at = terms_of([texts[i] for i in range(len(wave))])
    wanted, number = np.unique(hashes, return_inverse=True)
    queries = [np.unique(number[at[i] : at[i + 1]]) for i in range(len(wave))]
    index = staged(index_documents(rows, wanted), "search-index")
    n, total = index.agg(F.coalesce(F.sum("n_documents"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    @tidy
    def document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                df += np.bincount(np.frombuffer(terms, np.int32), minlength=len(wanted))
        yield pd.DataFrame({"term": np.flatnonzero(df), "df": df[df > 0]})

    df = index.select("terms").mapInPandas(document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1).cast("double"))).alias("weight")
    weights = np.zeros(len(wanted), np.int64)
    for r in df.select("term", weight).toLocalIterator():  # at most WAVE_TERMS
        weights[r["term"]] = r["weight"]
    found = search_index(index, queries, weights, n, total, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id") == NO_ID, "doc_id", "text_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), id_out(), "score", "text_key", "item_key")

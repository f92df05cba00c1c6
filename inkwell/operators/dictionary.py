"""Reference dictionaries: substring joins, exports and merges."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import letters, starts_of, stretches
from ..functions.automaton import Automaton
from .texts import occurrences


#: Letters of headwords to a shard of the dictionary (some 30 bytes each once it is built), and letters searched at a time.
SHARD_LETTERS, CHUNK_LETTERS = 2_000_000, 500_000


def positions_of(text: Column, needle: Column) -> Column:
    """array<int>: starts of all occurrences of needle in text, overlaps included."""
    return starts_of(text, needle, overlapping=True)


def build_automata(words: DataFrame, word_col: str = "headword") -> DataFrame:
    """shard, automaton (pickled): the distinct non-empty headwords, dealt over shards by their hash and built in tasks."""
    heads = words.select(F.col(word_col).alias("headword")).where("headword <> ''").distinct()
    letters_held = heads.agg(F.sum(F.char_length("headword"))).first()[0] or 0
    shards = max(1, -(-letters_held // SHARD_LETTERS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        patterns = sorted(group["headword"])
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "automaton": [pickle.dumps((patterns, Automaton(patterns)))]})

    return heads.withColumn("shard", F.pmod(F.xxhash64("headword"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, automaton binary")


def substring_join(texts: DataFrame, words: DataFrame, key: str, text_col: str = "text", word_col: str = "headword") -> DataFrame:
    """key, headword, start, end of every occurrence of every headword, overlaps included; empty headwords and null texts
    occur nowhere.

    Each text is read once for each shard of the dictionary, by an automaton of all the shard's headwords; only
    occurrences become rows. Shards go to the tasks one at a time and are bounded by SHARD_LETTERS.
    """
    spark = texts.sparkSession
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("headword", T.StringType()), T.StructField("start", T.IntegerType())])
    rows, found = texts.select(key, F.col(text_col).alias("text_")), spark.createDataFrame([], schema)
    for shard in build_automata(words, word_col).toLocalIterator():
        shared = spark.sparkContext.broadcast(bytes(shard["automaton"]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns, automaton = pickle.loads(shared.value)
            names = pa.array(patterns, pa.string())
            for batch in batches:
                # only the texts of a chunk are made strings
                ends, at = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_LETTERS, side="right")))
                    of, pattern, start = automaton.find([t or "" for t in batch.column(1).slice(at, to - at).to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + at)), names.take(pa.array(pattern)), pa.array(start, pa.int32())], names=[key, "headword", "start"])
                    at = to

        found = found.unionByName(rows.mapInArrow(search, schema))
    return found.withColumn("end", F.col("start") + F.char_length("headword") - 1)


def merge_matches(matches: DataFrame, headword: str = "headword") -> DataFrame:
    """headword, n, positions: matches of all blocks gathered per headword, in order of block and place."""
    return matches.groupBy(headword).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("block", "start"))), lambda x: F.concat_ws(":", x["block"], x["start"])).alias("positions"))


def dedup_entries(entries: DataFrame) -> DataFrame:
    """One row per headword of entries (headword, pos, meaning, related, place): the meaning of the first by pos, all
    places in order, and related terms in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "meaning", "related", "place")))
    return entries.groupBy("headword").agg(rows.alias("r")).select(
        "headword", F.get("r", F.lit(0))["meaning"].alias("meaning"), F.transform("r", lambda x: x["place"]).alias("places"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["related"], F.expr("cast(array() as array<string>)"))))).alias("related"),
    )


def import_entries(existing: DataFrame, incoming: DataFrame, strategy: str) -> DataFrame:
    """headword, meaning, action after an import: `merge` takes the incoming meaning where the old one is empty,
    `skip_existing` leaves old entries, any other strategy appends all."""
    new = incoming.join(existing.select("headword"), "headword", "left_anti")
    if strategy not in ("merge", "skip_existing"):
        return existing.select("headword", "meaning", F.lit("kept").alias("action")).unionByName(incoming.select("headword", "meaning", F.lit("added").alias("action")))
    added = new.select("headword", "meaning", F.lit("added").alias("action"))
    if strategy == "skip_existing":
        return existing.select("headword", "meaning", F.lit("kept").alias("action")).unionByName(added)
    last = incoming.groupBy("headword").agg(F.max_by("meaning", "pos").alias("given"))
    merged = existing.join(last, "headword", "left").select("headword", F.coalesce(F.nullif("meaning", F.lit("")), "given", "meaning").alias("meaning"), F.when(F.col("given").isNull(), "kept").otherwise("merged").alias("action"))
    return merged.unionByName(added)


def context_text(matches: DataFrame, group: str) -> DataFrame:
    """group, context: one line `headword: meaning` per match, in the order of pos."""
    line = F.concat_ws(": ", "headword", "meaning")
    return matches.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def ngram_index(texts: DataFrame, key: str, n: int = 5, text_col: str = "text") -> DataFrame:
    """key, gram, positions of every character n-gram of each text."""
    grams = F.transform(stretches(letters(F.col(text_col)), n), lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    return texts.select(key, F.inline(grams)).groupBy(key, "gram").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def anchor_votes(texts: DataFrame, anchors: DataFrame, key: str, n: int = 5, text_col: str = "text") -> DataFrame:
    """key, est_start, votes: where the anchor of a text (key, anchor) would begin by each of its n-grams found there,
    with at least max(1, length div 2) votes, else the most voted place alone."""
    index = ngram_index(texts, key, n, text_col).select(key, "gram", F.explode("positions").alias("at"))
    grams = anchors.select(key, F.char_length("anchor").alias("len"), F.inline(F.transform(stretches(letters(F.col("anchor")), n), lambda g, i: F.struct(g.alias("gram"), i.alias("offset")))))
    votes = grams.join(index, [key, "gram"]).groupBy(key, (F.col("at") - F.col("offset")).alias("est_start")).agg(F.count(F.lit(1)).alias("votes"), F.max("len").alias("len"))
    best = votes.groupBy(key).agg(F.max(F.struct("votes", (-F.col("est_start")).alias("neg"))).alias("b"))
    rows = votes.join(best, key)
    enough = F.col("votes") >= F.greatest(F.lit(1), F.expr("len div 2"))
    any_enough = F.col("b.votes") >= F.greatest(F.lit(1), F.expr("len div 2"))
    return rows.where(enough | (~any_enough & (F.col("est_start") == -F.col("b.neg")))).select(key, "est_start", "votes")


__all__ = ["anchor_votes", "build_automata", "context_text", "dedup_entries", "import_entries", "merge_matches", "ngram_index", "occurrences", "positions_of", "substring_join"]

"""Which part of a long text each page of a document holds, for documents of any length.

Pages and text are reduced to the letters of one script. Up to three anchors of a page meet the text's n-grams in a join;
each n-gram votes for where its anchor begins. Of all places of all anchors of a document the heaviest chain is taken
that keeps the anchors' order (a longest increasing subsequence by weight), so one wrong place costs itself alone. Pages
without an anchor in the chain are searched between their found neighbours, each in a task of its own; what is nowhere
is interpolated. Only places, not texts, are gathered per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import letters, piece, stretches
from . import alignment as al
from . import parsing as pa

HAN, GRAM = r"\p{IsHan}", 5
#: Confidence of a page with one anchor only, and of one found between its neighbours, by the likeness.
ONE_ANCHOR, BETWEEN = 0.8, 0.9


def anchors_of(length: Column, size: int) -> Column:
    """array<struct<k, off, n>>: a page's anchors by place and length: begin, middle and end; begin and end where three
    would not fit in twice an anchor's length, all of it where it is shorter than one."""
    one = lambda k, off, n: F.struct(F.lit(k).alias("k"), off.cast("int").alias("off"), n.cast("int").alias("n"))
    begin, end = one(0, F.lit(0), F.lit(size)), one(2, length - size, F.lit(size))
    middle = one(1, F.floor(length / 2) - size // 2, F.lit(size))
    return F.when(length == 0, F.slice(F.array(begin), 1, 0)).when(length < size, F.array(one(0, F.lit(0), length))).when(length < 2 * size, F.array(begin, end)).otherwise(F.array(begin, middle, end))


def least_likeness(n: Column) -> Column:
    return F.when(n > 2, F.greatest(F.lit(0.6), 1 - 2 / n)).otherwise(0.6)


def heaviest_chain(order: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the heaviest choice of rows whose order and place both rise; rows of equal order exclude each other. Of
    equally heavy chains the one with earlier places."""
    rows = np.lexsort((-place, order))
    levels, rank = np.unique(place, return_inverse=True)
    none = (0.0, 1, -1)
    tree = [none] * (len(levels) + 1)  # heaviest chain that ends before a place, by prefix: weight, -place of its end, row
    before = np.full(len(place), -1)

    def heaviest(k: int) -> tuple[float, int, int]:
        best = none
        while k > 0:
            if tree[k][:2] > best[:2]:
                best = tree[k]
            k &= k - 1
        return best

    for i in rows.tolist():
        best, k = heaviest(int(rank[i])), int(rank[i]) + 1
        before[i], mine = best[2], (best[0] + float(weight[i]), -int(place[i]), i)
        while k < len(tree):
            if mine[:2] > tree[k][:2]:
                tree[k] = mine
            k += k & -k
    best = heaviest(len(levels))
    chain, at = [], best[2]
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return np.array(chain[::-1], np.int64)


def chained(candidates: DataFrame, doc: str) -> DataFrame:
    """doc, page, k, place, n, ratio, anchor of the candidates in their document's heaviest chain."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows["page"].to_numpy(np.int64) * 3 + rows["k"].to_numpy(np.int64)
        return rows.iloc[heaviest_chain(order, rows["place"].to_numpy(np.int64), rows["votes"].to_numpy(float) * rows["ratio"].to_numpy(float))]

    return candidates.groupBy(doc).applyInPandas(chain, candidates.schema)


@F.pandas_udf(al.row_type(place="int", ratio="double"))
def nearest_in(anchor: pd.Series, stretch: pd.Series) -> pd.DataFrame:
    """Where in a stretch of text the anchor is most alike, and how much; place -1 without a stretch."""
    out = []
    for a, text in zip(anchor, stretch, strict=True):
        starts = np.arange(max(0, len(text) - len(a) + 1))
        if a and len(starts):
            ratio, _, start, _ = al._most_alike(a, text, starts, al.Counter())
            out.append((-start, ratio))
        else:
            out.append((-1, 0.0))
    return pd.DataFrame(out, columns=["place", "ratio"])


def _cut_out(rows: DataFrame, texts: DataFrame, doc: str, source: str, start: str, size: str, out: str) -> DataFrame:
    """rows with `out`, the letters of their document's text from `start` on. A document's text is met once, whatever the
    number of its rows, and the pieces are dealt out again."""
    gathered = rows.groupBy(doc).agg(F.collect_list(F.struct(*(F.col(c) for c in rows.columns if c != doc))).alias("rows_"))
    met = gathered.join(texts.select(doc, letters(F.col(source)).alias("letters_")), doc).select(doc, "letters_", F.explode("rows_").alias("r"))
    others = [c for c in rows.columns if c != doc]
    return met.select(doc, *(F.col(f"r.{c}").alias(c) for c in others), piece(F.col("letters_"), F.col(f"r.{start}"), F.greatest(F.col(f"r.{size}"), F.lit(0))).alias(out)).repartition(doc, "page")


def align_pages(pages: DataFrame, texts: DataFrame, doc: str, script: str = HAN, anchor: int = 15) -> DataFrame:
    """doc, page, start, end, matched_text, preview, confidence, anchor: the part of the document's text (doc, text) that
    belongs to each of its pages (doc, page, text).

    Texts are put in composed form first. A page's place is the upper median of its anchors' places, and pages part in
    the middle between their places; the first begins the text and the last ends it. Pages that are not found share the
    gap between their neighbours evenly. confidence is the anchors' mean likeness, less for one anchor alone and for
    pages found between neighbours; for those not found it is the best likeness there was. A text without a letter of
    the script belongs to the first page, with a confidence of 0.
    """
    t = texts.select(doc, al.nfc(F.coalesce("text", F.lit(""))).alias("text")).withColumn("p", pa.project_script(F.col("text"), script))
    t = t.select(doc, "text", F.col("p.text").alias("own"), F.col("p.places").alias("places"))
    p = pages.select(doc, F.col("page").cast("int").alias("page"), al.nfc(F.coalesce("text", F.lit(""))).alias("body")).withColumn("own", pa.project_script(F.col("body"), script)["text"])
    p = p.select(doc, "page", F.substring(F.trim("body"), 1, 80).alias("preview"), "own")
    wanted = p.select(doc, "page", letters(F.col("own")).alias("l"), F.explode(anchors_of(F.char_length("own"), anchor)).alias("a"))
    wanted = wanted.select(doc, "page", "a.k", "a.off", "a.n", piece(F.col("l"), F.col("a.off"), F.col("a.n")).alias("anchor"))

    grams = wanted.select(doc, "page", "k", "n", "anchor", F.posexplode(stretches(letters(F.col("anchor")), GRAM)).alias("o", "gram"))
    held = t.select(doc, F.posexplode(stretches(letters(F.col("own")), GRAM)).alias("at", "gram"))
    votes = grams.join(held, [doc, "gram"]).withColumn("place", F.col("at") - F.col("o")).where("place >= 0").groupBy(doc, "page", "k", "n", "anchor", "place").agg(F.count(F.lit(1)).alias("votes"))
    most = F.max(F.struct("votes", (-F.col("place")).alias("back")))
    best = votes.groupBy(doc, "page", "k").agg(most.alias("b"))
    enough = F.greatest(F.lit(1), F.floor((F.col("n") - GRAM + 1) / 2))
    likely = votes.join(best, [doc, "page", "k"]).where((F.col("votes") >= enough) | ((F.col("b.votes") < enough) & (F.col("place") == -F.col("b.back")))).drop("b")
    tried = _cut_out(likely, t, doc, "own", "place", "n", "window").withColumn("ratio", al.similarity("anchor", "window"))
    good = tried.where(F.col("ratio") >= least_likeness(F.col("n"))).select(doc, "page", "k", F.col("place").cast("long").alias("place"), "n", "votes", "ratio", "anchor")
    found = chained(good, doc).groupBy(doc, "page").agg(F.sort_array(F.collect_list("place")).alias("at"), F.avg("ratio").alias("ratio"), F.max_by("anchor", F.struct("ratio", -F.col("k"))).alias("anchor"))
    found = found.select(doc, "page", F.get("at", F.floor(F.size("at") / 2).cast("int")).alias("place"), (F.col("ratio") * F.when(F.size("at") > 1, 1.0).otherwise(ONE_ANCHOR)).alias("confidence"), "anchor")

    every = p.select(doc, "page", "preview").join(found, [doc, "page"], "left").join(t.select(doc, F.char_length("own").alias("letters"), F.char_length("text").alias("length")), doc)
    w = Window.partitionBy(doc).orderBy("page")
    around = every.withColumn("low", F.coalesce(F.last("place", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    around = around.withColumn("high", F.coalesce(F.first("place", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("letters").cast("long")))
    lost = around.where("place is null").select(doc, "page", "low", "high").join(wanted, [doc, "page"]).withColumn("size", F.col("high") - F.col("low") + F.col("n")).where("high - low >= 3")
    lost = lost.withColumns({"low": F.col("low").cast("int"), "size": F.col("size").cast("int")})
    searched = _cut_out(lost, t, doc, "own", "low", "size", "stretch").withColumn("hit", nearest_in("anchor", "stretch"))
    again = searched.withColumn("fits", (F.col("hit.ratio") >= least_likeness(F.col("n"))) & (F.col("hit.place") >= 0)).groupBy(doc, "page")
    again = again.agg(F.max(F.struct("fits", F.col("hit.ratio").alias("ratio"), (-F.col("k")).alias("first"), (F.col("low") + F.col("hit.place")).cast("long").alias("place"), "anchor")).alias("h"))
    both = around.join(again, [doc, "page"], "left")
    late = F.when(F.col("h.fits"), F.col("h.place"))
    both = both.select(doc, "page", "preview", "length", "letters", F.coalesce("place", late).alias("place"), F.coalesce("confidence", F.col("h.ratio") * F.when(F.col("h.fits"), BETWEEN).otherwise(1.0), F.lit(0.0)).alias("confidence"), F.coalesce("anchor", "h.anchor", F.lit("")).alias("anchor"))

    in_text = both.groupBy(doc).agg(F.collect_list(F.struct("page", "preview", "length", "letters", "place", "confidence", "anchor")).alias("r")).join(t.select(doc, "places"), doc)
    at = F.get("places", F.col("x.place").cast("int"))
    rows = in_text.select(doc, "places", F.explode("r").alias("x")).select(doc, "x.*", at.alias("known"))
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("known", F.when((F.col("i") == 1) & F.col("known").isNull(), 0).otherwise(F.col("known")))
    mark = F.when(F.col("known").isNotNull(), F.struct("i", "known"))
    rows = rows.withColumn("a", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    total = F.count(F.lit(1)).over(Window.partitionBy(doc))
    step = (F.coalesce("b.known", "length") - F.col("a.known")) / (F.coalesce("b.i", total + 1) - F.col("a.i"))
    rows = rows.withColumn("anchor_at", F.coalesce("known", F.floor(F.col("a.known") + step * (F.col("i") - F.col("a.i"))).cast("int")))
    rows = rows.withColumn("start", F.when(F.col("i") == 1, 0).otherwise(F.floor((F.lag("anchor_at").over(w) + F.col("anchor_at")) / 2).cast("int")))
    rows = rows.withColumn("end", F.coalesce(F.lead("start").over(w), "length"))
    alone = F.col("letters") == 0
    rows = rows.where(~alone | (F.col("i") == 1)).withColumn("end", F.when(alone, F.col("length")).otherwise(F.col("end"))).withColumn("size", F.col("end") - F.col("start"))
    out = _cut_out(rows.select(doc, "page", "start", "end", "size", "preview", F.when(alone, 0.0).otherwise(F.col("confidence")).alias("confidence"), "anchor"), t, doc, "text", "start", "size", "matched_text")
    return out.select(doc, "page", "start", "end", F.regexp_replace("matched_text", r"(?U)^\s+|\s+$", "").alias("matched_text"), "preview", "confidence", "anchor")

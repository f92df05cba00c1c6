"""Exact n-gram Jaccard join: a size-aware join with subsets for small sets and inverted lists for large ones.

Two sets of m and n shingles link when 100 * intersection >= `percent` * union, which is an upper bound on their
symmetric difference, (m + n) * slack. The sizes decide how a set finds its partners:

* small sets (up to a boundary) enumerate their fixed-size subsets: sets of s and t shingles that link share a subset
  of exactly the overlap they need, so equal keys (s, t, subset) find each other;
* large sets go into inverted lists. A list of a single shingle of a popular passage would pair all documents with it,
  so lists are keyed by segments: the hash range is cut into more segments than linked sets of that size can differ
  in, so at least one segment is equal in both, and a list holds the sets with the same content of one segment.

The boundary is where the enumerated subsets of the corpus' sizes would cost more than its segments.

Documents with equal sets form one class first. A class is named by a doc_id of its own or, where it has none (null ids,
ids that rows of different sets share), by eight bytes of its digest, chosen so that all names differ. Linked sets share
not one list but many: at least as many as one of them uses beyond those in which they can differ. So lists are read
once, in order of their keys:

* a set that is sure of enough shared lists gives up its longest ones, in an order of lists that is the same for all
  sets: a passage that many documents share makes long lists, but only a small part of a document's;
* a short list gives its pairs, which are counted over all lists; pairs that share enough short lists are verified;
* in a long list every class is paired with the list's smallest class only (its pivot), never all with all. Long lists
  that touch form a group with one pivot. Classes within the bound of their pivot are one component. What remains are
  links of classes away from it: a set is then described by its difference from the pivot, those differences (small,
  and rarely shared) are joined by prefix-filtered inverted lists in order of rising frequency, and pairs are verified.

A linked pair that shares too few short lists to be counted in shares a long one, so it is in one group. No link
between different texts is lost, and no bound caps lists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import NO_ID, chain, chunked, id_in, id_out, join_skewed, keep_rows, mix64, shared_ids, staged, text_key, tidy, word_hashes
from .components import components

#: Cost of one key of a large set against one enumerated subset: it also leads to classes that don't link.
LIST_COST = 4
#: Largest size for which subsets are ever considered.
MOST_SMALL = 40
#: Segments beyond those that can differ, so that an equal one is hardly ever an empty one: at least, and as a share.
SPARE, SPARE_SHARE = 2, 0.35
#: A shingle is popular if at least 1/POPULAR of all documents have it: at most POPULAR times the mean set size of them.
POPULAR = 500
#: Groups of up to so many classes are compared pair by pair; larger ones go through lists.
FEW = 8
#: Lists of up to so many classes give all their pairs; of longer ones the members are paired with the smallest.
SHORT = 8
#: Share of the spare segments that a set must have left to give up its longest lists, and bounds of what tags hold.
SURE_SHARE, SPARED_BITS, MOST_NEED = 0.7, 12, 1 << 14
MOST_SPARED = (1 << SPARED_BITS) - 1


class Bounds:
    """Integer arithmetic of the threshold percent / 100."""

    def __init__(self, percent: int):
        self.t = Fraction(percent, 100)
        self.slack = (1 - self.t) / (1 + self.t)  # symmetric difference <= (m + n) * slack

    def differ(self, both: int) -> int:
        return math.floor(both * self.slack)

    def overlap(self, m: int, n: int) -> int:
        return math.ceil((m + n) * self.t / (1 + self.t))

    def largest(self, n: int) -> int:
        return math.floor(n / self.t)

    def smallest(self, n: int) -> int:
        return math.ceil(n * self.t)

    def classes(self, most: int) -> list[int]:
        """Lower edges of size classes: partners are in the same class or in neighbours."""
        edges = [1]
        while edges[-1] <= most:
            edges.append(self.largest(edges[-1]) + 1)
        return edges

    def damaged(self, edges: list[int], k: int) -> int:
        """Most segments in which linked sets of size class k differ."""
        return self.differ(2 * (edges[k + 1] - 1))

    def spare(self, edges: list[int], k: int) -> int:
        return max(SPARE, math.ceil(SPARE_SHARE * (self.damaged(edges, k) + 1)))

    def segments(self, edges: list[int], k: int) -> int:
        return self.damaged(edges, k) + 1 + self.spare(edges, k)

    def subsets(self, s: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, removed) of the subsets that a set of s shingles enumerates."""
        return [(min(s, t), max(s, t), s - c) for t in range(self.smallest(s), min(self.largest(s), boundary) + 1) if (c := self.overlap(s, t)) <= min(s, t)]


def choose_boundary(sizes: dict[int, int], bounds: Bounds) -> int:
    """The boundary with the least cost over the corpus' sizes up to MOST_SMALL."""
    edges = bounds.classes(4 * MOST_SMALL)

    def by_lists(n: int) -> int:
        k = np.searchsorted(edges, n, side="right") - 1
        return LIST_COST * (bounds.segments(edges, k) + bounds.segments(edges, k + 1))

    def cost(boundary: int) -> int:
        return sum(c * (sum(math.comb(n, r) for _, _, r in bounds.subsets(n, boundary)) if n <= boundary else by_lists(n)) for n, c in sizes.items() if n <= MOST_SMALL)

    return min(range(MOST_SMALL + 1), key=cost)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for a, b in chunked(texts, 1_000_000):
        words, at = word_hashes(texts[a:b])
        h = words[: max(0, len(words) - width + 1)]
        for i in range(1, width):
            h = chain(h, words[i : len(words) - width + 1 + i])
        for i in range(b - a):
            n = at[i + 1] - at[i]
            if n >= width:
                yield np.unique(h[at[i] : at[i + 1] - width + 1])
            elif n:
                short = words[at[i]]
                for w in words[at[i] + 1 : at[i + 1]]:
                    short = chain(np.array([short]), np.array([w]))[0]
                yield np.array([mix64(np.array([short ^ np.uint64(n)]))[0]])
            else:
                yield np.zeros(0, np.uint64)


def set_keys(tokens: np.ndarray, boundary: int, bounds: Bounds, edges: list[int], popular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set looks for partners, and what it knows of each; popular is sorted.

    A segment tells if it has a shingle that is not popular. A set with more telling segments than can differ uses
    those alone: as many of them as that are equal in a linked set, and tell there too. Other sets use all segments that
    are not empty, and the empty ones too if they have more of them than are spare. So linked sets share at least `need`
    keys, the smaller number of the two, and documents that have just a popular passage in common share none.

    A telling set that is sure of `sure` shared keys in a scheme can do without its `spared` longest lists there, as
    long as all sets agree on the order of lists: of the shared ones at most the `spared` longest are given up. What it
    knows is tag_of(need, spared, scheme).
    """
    n, keys, schemes = len(tokens), [], []
    if n <= boundary:
        mixed = mix64(tokens)
        whole = mixed.sum(dtype=np.uint64)
        found = []
        for s, t, removed in bounds.subsets(n, boundary):
            gone = np.array([sum(int(mixed[i]) for i in c) % (1 << 64) for c in combinations(range(n), removed)], np.uint64)
            found.append(mix64((whole - gone) ^ np.uint64((s << 20) + t)))
        if found:
            keys.append(np.concatenate(found))
            schemes.append((1, 0, 0))
    if bounds.largest(n) > boundary:
        k = int(np.searchsorted(edges, n, side="right")) - 1
        high = (tokens >> np.uint64(32)).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(tokens), dtype=np.uint64)))
        known = np.zeros(n, bool)
        if len(popular):
            known = popular[np.minimum(np.searchsorted(popular, tokens), len(popular) - 1)] == tokens
        rare = np.concatenate(([0], np.cumsum(~known)))
        for scheme in (k, k + 1):
            p, damaged = bounds.segments(edges, scheme), bounds.damaged(edges, scheme)
            segment = ((high * np.uint64(p)) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(segment, np.arange(p + 1))
            telling = rare[cut[1:]] > rare[cut[:-1]]
            empty = cut[1:] == cut[:-1]
            sure = math.ceil(SURE_SHARE * (1 + bounds.spare(edges, scheme)))
            if telling.sum() - damaged >= sure:
                use, spared = np.flatnonzero(telling), min(sure // 2, MOST_SPARED)
                need = sure - spared
            elif telling.sum() > damaged:
                use, spared = np.flatnonzero(telling), 0
                need = len(use) - damaged
            else:
                use, spared = np.arange(p) if empty.sum() > bounds.spare(edges, scheme) else np.flatnonzero(~empty), 0
                need = len(use) - damaged
            content = sums[cut[use + 1]] - sums[cut[use]]
            keys.append(mix64(content + mix64((np.uint64(scheme) << np.uint64(32)) + use.astype(np.uint64) + np.uint64(1 << 63))))
            schemes.append((need, spared, scheme))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = max(1, min(min(x for x, _, _ in schemes), MOST_NEED))
    return np.concatenate(keys).view(np.int64), np.concatenate([np.full(len(k), tag_of(need, spared, scheme)) for k, (_, spared, scheme) in zip(keys, schemes, strict=True)])


def tag_of(need: int, spared: int, scheme: int) -> int:
    """need, spared and whether the scheme's number is odd (a set uses one of either kind) in one number."""
    return ((need << SPARED_BITS) + spared << 1) + scheme % 2


def listed(lists: DataFrame) -> DataFrame:
    """key, node, n, tag of the rows of lists (key, node, tag, kind) in lists of two members or more; n is SHORT + 1
    for all longer ones. Lists are read in one pass in order of their keys.

    kind is 0 for a member, 1 for one of a list known to be long, 2 for a member of such a list that need not be looked
    up: those are dealt by their nodes, all others by their keys."""

    @tidy
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            done = batch[batch["kind"] == 2]
            batch = batch[batch["kind"] != 2]
            rows = [batch["key"].to_numpy(), batch["node"].to_numpy(), batch["tag"].to_numpy(), batch["kind"].to_numpy() == 1]
            if rest is not None:
                rows = [np.concatenate(pair) for pair in zip(rest, rows, strict=True)]
            key = rows[0]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            out = [_in_lists(*(r[:whole] for r in rows)), pd.DataFrame({"key": done["key"], "node": done["node"], "n": SHORT + 1, "tag": done["tag"]})]
            rest = [r[whole:] for r in rows]
            if len(rest[0]) > SHORT:  # known to be long by now: one member stays to say so
                out.append(_in_lists(*(r[1:] for r in rest[:3]), np.ones(len(rest[0]) - 1, bool)))
                rest = [r[:1] for r in rest[:3]] + [np.array([True])]
            yield pd.concat(out, ignore_index=True)
        if rest is not None:
            yield _in_lists(*rest)

    dealt = lists.repartition(F.when(F.col("kind") == 2, F.xxhash64("node")).otherwise(F.col("key")))
    return dealt.sortWithinPartitions("key", "node").mapInPandas(read, "key long, node long, n int, tag int")


def _in_lists(key: np.ndarray, node: np.ndarray, tag: np.ndarray, long: np.ndarray) -> pd.DataFrame:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(first, len(key)))
    if len(key):
        size = np.where(np.logical_or.reduceat(long, first), SHORT + 1, np.minimum(size, SHORT + 1))
    n = np.repeat(size, np.diff(np.append(first, len(key))))
    return pd.DataFrame({"key": key, "node": node, "n": n, "tag": tag})[n > 1]


def _per_set(docs: DataFrame, width: int, schema: str, make, chars: int = 1_500_000) -> DataFrame:
    """mapInPandas over docs (with text): make(rows, sets) gives the frame of a chunk of about so many characters."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunked(texts, chars):
                yield make(batch.iloc[a:b], list(shingle_sets(texts[a:b], width)))

    return docs.mapInPandas(run, schema)


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _digest_name(at: int) -> Column:
    """The name that eight bytes of a class's digest from `at` on give it."""
    return F.conv(F.hex(F.substring("digest", at + 1, 8)), 16, -10).cast("long")


def _names_from(classes: DataFrame) -> int:
    """The first place in the digests from where eight bytes name all classes apart, beside those named by an id."""
    named = classes.where("any_odd")
    for at in range(9):
        names = named.select(_digest_name(at).alias("x")).unionByName(classes.where("plain is not null").select(F.col("plain").alias("x")))
        if names.groupBy("x").count().where("count > 1").isEmpty():
            return at
    raise ValueError("no eight bytes of the digests tell all classes apart")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Defined results: null and empty texts, and texts of white space, have no shingles and link with nothing; texts with
    fewer than `width` words have one shingle, their whole word sequence; repeated rows fall in one class; rows that
    share a doc_id, or have none, link by their own texts; a null doc_id names a component only if all its rows have
    none; an empty table gives an empty result; other columns are ignored.
    """
    return linked_rows(docs, id_col, text_col, width, percent).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """jaccard_components with text_key (of the row's text) and component, which is equal for rows that links connect
    whatever their ids, and null for rows without shingles."""
    docs = docs.select(id_in(id_col), F.coalesce(text_col, F.lit("")).alias("text"), text_key(text_col).alias("text_key"))
    bounds = Bounds(percent)

    def digests(rows: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame({"popular": False, "id": rows["doc_id"].to_numpy(), "text_key": rows["text_key"].to_numpy(), "n": [len(s) for s in sets], "digest": [digest_of(s) for s in sets]})
        tokens, seen = np.unique(np.concatenate(sets), return_counts=True)
        often = seen >= max(4, 0.003 * len(sets))
        if not often.any():
            return out
        return pd.concat((out, pd.DataFrame({"popular": True, "id": tokens[often].view(np.int64), "text_key": 0, "n": seen[often], "digest": b""})), ignore_index=True)

    both = staged(_per_set(docs, width, "popular boolean, id long, text_key long, n long, digest binary", digests, 4_000_000), "shingle-sets")
    sets = both.where("not popular").select(F.col("id").alias("doc_id"), "text_key", F.col("n").alias("n_shingles"), "digest")
    shared = shared_ids(sets, "doc_id", "digest")
    n_shared = shared.count()

    def with_odd(rows: DataFrame, spread: str) -> DataFrame:
        """Marks the rows whose doc_id does not name their set: null ids, and ids of several sets."""
        odd = F.col("doc_id") == NO_ID
        if not n_shared:
            return rows.withColumn("odd", odd)
        held = shared.withColumn("held_", F.lit(True))
        rows = rows.join(F.broadcast(held.drop("n")), "doc_id", "left") if n_shared <= 2_000_000 else join_skewed(rows, held, "doc_id", n_rows, spread, how="left")
        return rows.withColumn("odd", odd | F.col("held_").isNotNull()).drop("held_")

    n_rows = sets.count()
    sets = with_odd(sets, "text_key")
    classes = sets.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.when(~F.col("odd"), F.col("doc_id"))).alias("plain"), F.min(F.nullif(F.col("doc_id"), F.lit(NO_ID))).alias("rep"), F.bool_or("odd").alias("any_odd"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"),
    )
    classes = staged(classes, "classes")
    any_odd = not classes.where("any_odd").isEmpty()
    names_at = _names_from(classes) if any_odd else 0
    sizes = {r["size"]: r["count"] for r in classes.where(f"size <= {MOST_SMALL}").groupBy("size").count().collect()}
    boundary = choose_boundary(sizes, bounds)
    known = both.where("popular").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, n_rows // POPULAR))
    popular = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.id for r in known.select("id").collect()], np.int64).view(np.uint64)))
    edges_of = bounds.classes(2 * (classes.agg(F.max("size")).first()[0] or 1))

    repeated = classes.where("n > 1").select("digest", "plain", "n")
    copies = join_skewed(sets.where("not odd"), repeated, "digest", n_rows, "doc_id").where("doc_id <> plain").select("doc_id")
    reps = keep_rows(with_odd(docs, "text_key"), staged(copies, "copies"), "doc_id", "left_anti")

    def names(rows: pd.DataFrame, found: list[np.ndarray]) -> np.ndarray:
        out = rows["doc_id"].to_numpy(np.int64, copy=True)
        for i in np.flatnonzero(rows["odd"].to_numpy(bool)):
            out[i] = int.from_bytes(digest_of(found[i])[names_at : names_at + 8], "big", signed=True)
        return out

    def keys(rows: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
        named = names(rows, found)
        first = ~pd.Series(named).duplicated().to_numpy()
        made = [set_keys(s, boundary, bounds, edges_of, popular.value) if len(s) and f else (np.zeros(0, np.int64),) * 2 for s, f in zip(found, first, strict=True)]
        key, tag = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        node = np.repeat(named, [len(k) for k, _ in made])
        order = np.lexsort((node, key))
        key, node, tag = key[order], node[order], tag[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        size = np.diff(np.append(begin, len(key)))
        # of lists that are long within the chunk one member tells the others' readers so
        kind = np.repeat(np.where(size > SHORT, 2, 0), size)
        kind[begin[size > SHORT]] = 1
        return pd.DataFrame({"key": key, "node": node, "tag": tag, "kind": kind})

    rows = staged(listed(_per_set(reps, width, "key long, node long, tag int, kind tinyint", keys)), "lists")
    longest = Window.partitionBy("node", F.col("tag") % 2).orderBy(F.desc("n"), "key")
    used = rows.withColumn("place", F.row_number().over(longest)).where(F.col("place") > F.expr(f"shiftright(tag, 1) & {MOST_SPARED}"))
    used = staged(used.select("key", "node", "n", F.shiftright("tag", SPARED_BITS + 1).alias("need")), "used-lists")
    long = used.where(F.col("n") > SHORT)
    pivots = staged(long.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1").withColumnRenamed("members", "n"), "long-lists")
    stars = join_skewed(long.select("key", "node"), pivots, "key", pivots.agg(F.sum("n")).first()[0] or 0, "node").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    groups = staged(components(stars), "groups")
    # A linked pair shares `need` lists at least: half of them short ones, or it is in one group.
    gathered = used.where(F.col("n") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "need"))).alias("m"))  # SHORT members at most
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SHORT)), lambda y: F.struct(y["node"].alias("a"), x["node"].alias("b"), F.least(x["need"], y["need"]).alias("need")))))
    close = gathered.where("size(m) > 1").select(F.inline(each)).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    close = staged(close.where("2 * n >= need").select("a", "b"), "close-pairs")

    def arrays(rows: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"node": names(rows, found), "tokens": [s.view(np.int64) for s in found]})

    ends = close.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node")).distinct()
    some = keep_rows(reps.where("not odd"), staged(ends.select(F.col("node").alias("doc_id")), "ends"), "doc_id")
    members = _per_set(some.unionByName(reps.where("odd")) if any_odd else some, width, "node long, tokens array<long>", arrays)
    members = staged(members.where("size(tokens) > 0").dropDuplicates(["node"]), "members")
    links = _linked_pairs(close, members, percent).unionByName(_links_within(staged(members.join(groups, "node"), "grouped"), bounds))
    linked = components(staged(links, "links"))
    named = classes.withColumn("node", F.coalesce("plain", _digest_name(names_at))).join(linked, "node", "left")
    named = named.select("digest", "rep", "n", F.coalesce("component", "node").alias("component"))
    if any_odd:  # names are no longer the smallest ids
        named = staged(named, "named-classes")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
        named = join_skewed(named.withColumnRenamed("n", "rows"), least, "component", n_rows, "digest").withColumnRenamed("rows", "n")
    else:
        named = named.withColumn("component_id", F.col("component"))
    joined = join_skewed(sets, named.select("digest", "n", "component", "component_id"), "digest", n_rows, "doc_id", how="left")
    return joined.select(id_out(), "text_key", "n_shingles", F.coalesce(F.col("component_id"), id_out()).alias("component_id"), "component")


def _linked_pairs(close: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The linked ones of close (a, b); members are node, tokens."""
    side = lambda c: members.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = close.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return both.where(f"100 * both >= {percent} * (size(tokens_a) + size(tokens_b) - both)").select("a", "b")


def _links_within(members: DataFrame, bounds: Bounds) -> DataFrame:
    """Links (a, b) that connect all linked classes of each group; members are node, tokens, component."""
    num, den = bounds.slack.numerator, bounds.slack.denominator

    def links(differ: str, both: str):
        return F.expr(f"({differ}) * {den} <= ({both}) * {num}")

    pivot = members.where("node = component").select("component", F.col("tokens").alias("base"))
    pivot = pivot.join(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    diff = join_skewed(members, pivot, "component", members.count(), "node", parts=500)
    diff = diff.select("component", "node", F.size("tokens").alias("size"), F.size("base").alias("base_size"), F.concat(F.array_except("tokens", "base"), F.array_except("base", "tokens")).alias("diff"))
    diff = diff.withColumn("nd", F.size("diff"))
    diff = staged(diff.withColumn("near", links("nd", "size + base_size")), "differences")
    direct = diff.where("near and node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    side = lambda c, rows, *more: rows.select(*(F.col(x).alias(f"{x}_{c}") for x in ("node", "size", "nd", "diff", *more)))
    alike = links("nd_a + nd_b - 2 * size(array_intersect(diff_a, diff_b))", "size_a + size_b")
    sized = F.expr(f"least(size_a, size_b) * {bounds.t.denominator} >= greatest(size_a, size_b) * {bounds.t.numerator}")

    far = diff.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.bool_and("near").alias("all_near")).where("n > 2 and not all_near")
    open_ = join_skewed(diff, far.select("component", "n", F.col("n").alias("members")), "component", diff.count(), "node")
    few = open_.where(F.col("members") <= FEW)
    few_pairs = side("a", few, "component", "near").join(side("b", few, "component", "near"), F.col("component_a") == F.col("component_b"))
    few_links = few_pairs.where((F.col("node_a") < F.col("node_b")) & ~(F.col("near_a") & F.col("near_b")) & sized & alike)

    tokens = open_.where(F.col("members") > FEW).select("component", "node", "size", "nd", "near", F.explode("diff").alias("token"))
    tokens = staged(tokens.select("node", "size", "nd", "near", "token", F.xxhash64("component", "token").alias("key")), "difference-tokens")
    counts = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("df", F.col("n"))
    shared = join_skewed(tokens, counts, "key", tokens.count(), "node")
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("pos", F.col("nd") - F.count(F.lit(1)).over(by_node) + F.row_number().over(by_node.orderBy("df", "key")) - 1)
    most = F.floor(F.col("size") * (1 + 1 / F.lit(float(bounds.t))) * float(bounds.slack) + 1e-9)
    prefix = staged(ranked.where(F.col("pos") <= most).select("key", "node", "size", "nd", "near", "pos"), "prefixes")
    left, right = prefix.select(*(F.col(c).alias(f"{c}_a") for c in prefix.columns)), prefix.select(*(F.col(c).alias(f"{c}_b") for c in prefix.columns))
    pairs = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("node_a") < F.col("node_b")) & ~(F.col("near_a") & F.col("near_b")) & sized & F.expr(
        f"2 * least(nd_a - pos_a, nd_b - pos_b) >= nd_a + nd_b - floor((size_a + size_b) * {num} / {den})"
    ))
    pairs = pairs.select("node_a", "node_b").distinct()
    found = pairs.join(side("a", diff), "node_a").join(side("b", diff), "node_b").where(alike)
    found = found.select("node_a", "node_b").unionByName(few_links.select("node_a", "node_b"))
    return direct.unionByName(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))

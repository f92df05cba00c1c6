"""Character alignment of two versions of a text, and of a long text with pages."""

from __future__ import annotations

import difflib
import functools
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import glosses
from ..functions.answers import salvage
from ..functions.likeness import ratio as ratio_of
from ..functions.line_diff import line_operations

#: The arrays that models answer with.
ANSWER_KEYS = ("annotations", "marks")
KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def row_type(**fields: object) -> T.StructType:
    """A struct type of named fields; types as objects, so that modules import without a session."""
    return T.StructType([T.StructField(k, KINDS.get(v, v)) for k, v in fields.items()])


#: Letters of the texts whose results are made at a time. A batch is 10,000 texts, and what is told of a text's lines and
#: marks is many times its size.
PIECE_LETTERS = 500_000


def pieces(texts: pd.Series) -> Iterator[slice]:
    """Slices of texts that follow each other, of PIECE_LETTERS letters or of one text."""
    ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_LETTERS, side="right")))
        yield slice(at, to)
        at = to


PAIRS = T.ArrayType(row_type(kind="string", ocr="string", ref="string", ocr_at="int", ref_at="int"))
PLACES = T.ArrayType(row_type(pos="int", text="string"))


def _pairs(ocr: str, ref: str) -> list[tuple]:
    out = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, ocr, ref).get_opcodes():
        common = min(b - a, d - c) if op in ("equal", "replace") else 0
        kind = "exact" if op == "equal" else "mismatch"
        out += [(kind, ocr[a + i], ref[c + i], a + i, c + i) for i in range(common)]
        out += [("insertion", ocr[i], None, i, None) for i in range(a + common, b)]
        out += [("deletion", None, ref[i], None, i) for i in range(c + common, d)]
    return out


@F.pandas_udf(PAIRS)
def align_chars(ocr: pd.Series, ref: pd.Series) -> pd.Series:
    """Pairs of characters: exact, mismatch, insertion (in ocr alone), deletion (in ref alone)."""
    return pd.Series([_pairs(a or "", b or "") for a, b in zip(ocr, ref, strict=True)])


@F.pandas_udf(row_type(total="int", n_exact="int", n_insertion="int", n_deletion="int", mismatches=T.ArrayType(row_type(ocr="string", ref="string"))))
def align_counts(ocr: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """How many pairs align_chars gives, by kind, and the mismatched ones."""

    def one(a: str, b: str) -> tuple:
        if a == b:  # SequenceMatcher takes them as one stretch too, but in quadratic time
            return len(a), len(a), 0, 0, []
        exact = inserted = deleted = 0
        wrong: list[tuple] = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
            common = min(j - i, m - k)
            if op == "equal":
                exact += common
            else:
                wrong += zip(a[i : i + common], b[k : k + common], strict=True)
                inserted += j - i - common
                deleted += m - k - common
        return exact + len(wrong) + inserted + deleted, exact, inserted, deleted, wrong

    return pd.DataFrame([one(a or "", b or "") for a, b in zip(ocr, ref, strict=True)], columns=["total", "n_exact", "n_insertion", "n_deletion", "mismatches"])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.ArrayType(row_type(op="string", line="string")))
def diff_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Lines of both texts in order: unchanged (a longest common subsequence), removed, added."""
    for old, new in batches:
        for s in pieces(old):
            yield pd.Series([line_operations((a or "").split("\n"), (b or "").split("\n")) for a, b in zip(old[s], new[s], strict=True)])


def relabel_variants(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """Mismatches whose two characters are variants (a, b, in either order) become `variant`. The dictionary meets the
    distinct mismatched pairs by an equi-join."""
    v = variants.select(F.least("a", "b").alias("va"), F.greatest("a", "b").alias("vb")).distinct().withColumn("known", F.lit(True))
    rows = pairs.join(v, (F.least("ocr", "ref") == F.col("va")) & (F.greatest("ocr", "ref") == F.col("vb")), "left")
    return rows.withColumn("kind", F.when((F.col("kind") == "mismatch") & F.col("known"), "variant").otherwise(F.col("kind"))).drop("va", "vb", "known")


def alignment_stats(pairs: DataFrame, group: str) -> DataFrame:
    """group, total, a count per kind, accuracy (exact and variant pairs of all; 0 without pairs)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    right = F.count_if(F.col("kind").isin("exact", "variant"))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *(n(k) for k in ("exact", "variant", "mismatch", "insertion", "deletion")), F.round(F.coalesce(F.try_divide(right, F.count(F.lit(1))), F.lit(0.0)), 4).alias("accuracy"))


def text_stats(rows: DataFrame, keys: list[str], variants: DataFrame) -> DataFrame:
    """keys and alignment_stats of the texts ocr and ref of each row. Only mismatched pairs become rows, to meet the
    variants (a, b, in either order)."""
    v = variants.select(F.least("a", "b").alias("va"), F.greatest("a", "b").alias("vb")).distinct().withColumn("known", F.lit(True))
    counted = rows.select(*keys, align_counts("ocr", "ref").alias("c")).select(*keys, "c.*").select(*keys, "total", "n_exact", "n_insertion", "n_deletion", F.explode_outer("mismatches").alias("m"))
    low, high = F.least("m.ocr", "m.ref"), F.greatest("m.ocr", "m.ref")
    met = counted.join(v, (low == F.col("va")) & (high == F.col("vb")), "left").groupBy(*keys)
    out = met.agg(*(F.first(c).cast("bigint").alias(c) for c in ("total", "n_exact", "n_insertion", "n_deletion")), F.count_if(F.col("known")).alias("n_variant"), F.count_if(F.col("m").isNotNull() & F.col("known").isNull()).alias("n_mismatch"))
    accuracy = F.round(F.coalesce(F.try_divide(F.col("n_exact") + F.col("n_variant"), F.col("total")), F.lit(0.0)), 4)
    return out.select(*keys, "total", "n_exact", "n_variant", "n_mismatch", "n_insertion", "n_deletion", accuracy.alias("accuracy"))


def _most_alike(needle: str, text: str, starts: np.ndarray, votes: Counter) -> tuple[float, bool, int, int]:
    """(ratio, voted for, -start, -length) of the window most like needle, of those that begin at starts. Starts with
    votes come before others as much alike; those with most are tried first.

    No window is left out but by a bound: the ratio (difflib's) matches no more characters than both have in common.
    """
    chars, n, size = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(text), len(needle)
    lengths = [size]
    shared = np.zeros((len(lengths), len(starts)), np.int64)
    for c, k in Counter(needle).items():
        seen = np.concatenate(([0], np.cumsum(chars == ord(c), dtype=np.int64)))
        for row, length in zip(shared, lengths, strict=True):
            row += np.minimum(seen[np.minimum(starts + length, n)] - seen[starts], k)
    bound = np.concatenate([2.0 * row / (size + np.minimum(length, n - starts)) for row, length in zip(shared, lengths, strict=True)])
    best = (0.0, False, 0, 0)
    tried = [(2.0, s, length) for s, _ in votes.most_common(8) for length in lengths]
    rest = np.argsort(-bound, kind="stable")
    for upper, s, length in chain(tried, ((bound[i], int(starts[i % len(starts)]), lengths[i // len(starts)]) for i in rest)):
        if upper < best[0]:
            break
        window = text[s : s + length]
        best = max(best, (ratio_of(needle, window), s in votes, -s, -length))
    return best


#: The likeness below which a text is nowhere, and letters a window may grow on either side.
LEAST_LIKENESS, MARGIN = 0.3, 2


def _window(needle: str, text: str) -> tuple[int, int, float]:
    """(start, length, ratio) of the part of text most like needle: as long as the needle, or with MARGIN letters more on
    both sides where that is more alike. The whole text where it is no longer than the needle, or nothing in it is like
    it. Looked for around all places of three probes of 5 characters, else of 3, else everywhere."""
    if not needle or len(text) <= len(needle):
        return 0, len(text), ratio_of(needle, text) if needle and text else 0.0
    size, last = len(needle), len(text) - len(needle)
    if (found := text.find(needle)) >= 0:  # nothing is more alike, and of places as much alike the first counts
        return found, size, 1.0
    votes, around = Counter(), np.zeros(len(text) + 2, np.int64)
    for n in (5, 3):
        probes = [0] * (size >= n) + [size // 2] * (size >= 2 * n) + [size - n] * (size >= 3 * n)
        for at in probes:
            i = -1
            while (i := text.find(needle[at : at + n], i + 1)) >= 0:
                votes[min(max(0, i - at), last)] += 1
                if (low := max(0, i - size + 5)) <= (high := min(i, last)):
                    around[low] += 1
                    around[high + 1] -= 1
        if votes:
            break
    near = np.cumsum(around[:-2])[: last + 1] > 0 if votes else np.ones(last + 1, bool)
    near[list(votes)] = True
    ratio, _, start, _ = _most_alike(needle, text, np.flatnonzero(near), votes)
    if ratio < LEAST_LIKENESS:
        return 0, len(text), ratio
    start = -start
    low, high = max(0, start - MARGIN), min(len(text), start + size + MARGIN)
    wider = ratio_of(needle, text[low:high])
    return (low, high - low, wider) if wider > ratio else (start, size, ratio)


@F.pandas_udf(row_type(start="int", length="int", ratio="double"))
def best_window(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Places count in the text as it is given; callers compose both (nfc) first."""
    return pd.DataFrame([_window(a or "", b or "") for a, b in zip(needle, text, strict=True)], columns=["start", "length", "ratio"])


def anchors_of(text: Column, length: int) -> Column:
    """Start, middle and end anchors: three from 3 lengths on, two from 2, else one."""
    n = F.char_length(text)
    part = lambda at: F.substring(text, at + 1, F.lit(length))
    middle = F.expr("1") * F.floor((n - length) / 2).cast("int")
    return F.when(n >= 3 * length, F.array(part(F.lit(0)), part(middle), part(n - length))).when(n >= 2 * length, F.array(part(F.lit(0)), part(n - length))).otherwise(F.array(F.substring(text, 1, length)))


def _grams(text: str, n: int = 5) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i in range(len(text) - n + 1):
        out.setdefault(text[i : i + n], []).append(i)
    return out


def _likeness(anchor: str, window: str) -> float:
    """difflib's ratio, or that of the letters equal in their places: difflib may pair letters that repeat with others."""
    return max(ratio_of(anchor, window), 2 * sum(a == b for a, b in zip(anchor, window, strict=False)) / (len(anchor) + len(window)))


def _anchor_place(anchor: str, whole: str, at: int, near: int, grams: Callable[[], dict], n: int = 5) -> tuple[int, float]:
    """(place of the anchor from `at` on, ratio): exact, else where most of its n-grams say; place -1 if not alike. Of
    places as much alike the one nearest to `near` counts: a passage may stand within an earlier page as well."""
    nearest = lambda i: (-abs(i - near), -i)
    if exact := [i for i in (whole.rfind(anchor, at, max(0, near + len(anchor) - 1)), whole.find(anchor, max(at, near))) if i >= 0]:
        return max(exact, key=nearest), 1.0
    if len(anchor) < n:
        return _anchor_between(anchor, whole, at, len(whole))
    offsets, votes = range(0, len(anchor) - n + 1, n // 2 + 1), Counter()
    for k in offsets:
        votes.update(i - k for i in grams().get(anchor[k : k + n], ()) if i - k >= at)
    places = sorted(i for i, v in votes.items() if v >= max(1, len(offsets) // 2)) or [i for i, _ in votes.most_common(1)]
    alike = {i: _likeness(anchor, whole[i : i + len(anchor)]) for i in places}
    # letters that the text lacks at its end count as unlike
    best = max(places, key=lambda i: (alike[i] * (len(anchor) + min(len(anchor), len(whole) - i)), *nearest(i)), default=-1)
    ratio = alike.get(best, 0.0)
    return (best if ratio >= max(0.6, 1.0 - 2.0 / len(anchor)) else -1), ratio


def _anchor_between(anchor: str, whole: str, low: int, high: int) -> tuple[int, float]:
    """(place most like the anchor of all from low to high, ratio); place -1 if not alike."""
    starts = np.arange(low, min(high, len(whole) - len(anchor)) + 1)
    if not len(starts):
        return -1, 0.0
    ratio, _, start, _ = _most_alike(anchor, whole, starts, Counter())
    return (-start, ratio) if ratio >= (max(0.6, 1.0 - 2.0 / len(anchor)) if len(anchor) > 2 else 0.6) else (-1, ratio)


def _place_pages(texts: list[str], whole: str, anchor: int) -> list[tuple[int, float]]:
    """(start, confidence) of each page."""
    grams = functools.cache(lambda: _grams(whole))
    cuts = [sorted({0, max(0, (len(t) - anchor) // 2), max(0, len(t) - anchor)}) if t else [] for t in texts]
    placed: list[tuple[int, float] | None] = []
    at = near = 0  # a page begins no earlier than `at`, and near where the pages before it end
    for text, offsets in zip(texts, cuts, strict=True):
        hits = [(i - k, r) for k in offsets for i, r in [_anchor_place(text[k : k + anchor], whole, at, near + k, grams)] if i >= 0]
        if not hits:
            placed.append(None)
            near += len(text)
            continue
        start = max(0, sorted(i for i, _ in hits)[len(hits) // 2])
        placed.append((start, sum(r for _, r in hits) / len(offsets)))
        at, near = start + min(anchor, len(text)), start + len(text)
    found = list(placed)
    for p, (text, offsets) in enumerate(zip(texts, cuts, strict=True)):
        if found[p] is None and text:
            low = max((f[0] for f in found[:p] if f), default=0)
            high = next((f[0] for f in found[p + 1 :] if f), len(whole))
            hits = [(r, -max(0, i - k)) for k in offsets for i, r in [_anchor_between(text[k : k + anchor], whole, low, high)] if i >= 0]
            if hits:
                placed[p] = (-max(hits)[1], 0.9 * max(hits)[0] / len(offsets))
    p = 0
    while p < len(placed):
        if placed[p] is None:
            end = next((q for q in range(p, len(placed)) if placed[q]), len(placed))
            low, high = placed[p - 1][0] if p else 0, placed[end][0] if end < len(placed) else len(whole)
            # The first page begins the text; others that are nowhere share the gap evenly.
            first = p - 1 if p else p
            placed[p:end] = [(int(low + (high - low) / (end - first) * (q - first)), 0.0) for q in range(p, end)]
        p += 1
    return [(start, round(confidence, 4)) for start, confidence in placed]


def map_pages(pages: DataFrame, texts: DataFrame, doc: str, anchor: int = 15) -> DataFrame:
    """doc, page, start, confidence: where each page's text begins in the document's whole text.

    Pages are looked up in order, each after the one before it, so this is a kernel per document. Of each page up to
    three anchors are looked up: exactly, else by the votes of their n-grams and a ratio; of places as much alike the
    nearest to the end of the page before counts. The page begins at the median of what they say. Pages not found so are
    looked up at every place between their found neighbours (confidence times 0.9). Pages that are nowhere have
    confidence 0 and share the gap between their neighbours evenly.
    """
    both = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages")).join(texts.select(doc, F.col("text").alias("whole")), doc)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, parts, whole in zip(batch[doc], batch["pages"], batch["whole"], strict=True):
                placed = _place_pages([p["text"] or "" for p in parts], whole or "", anchor)
                out += [(d, p["page"], *at) for p, at in zip(parts, placed, strict=True)]
            yield pd.DataFrame(out, columns=[doc, "page", "start", "confidence"])

    return both.mapInPandas(place, f"{doc} long, page int, start long, confidence double")


@F.pandas_udf(T.StringType())
def salvage_json_under(raw: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([salvage(r, list(k)) for r, k in zip(raw, keys, strict=True)])


def salvage_json(raw: Column | str, keys: tuple[str, ...] = ANSWER_KEYS) -> Column:
    """The JSON value in a model's answer: thinking and fences off; where it is cut off, {key: items} with the whole
    objects of the array under the first of `keys` that has any."""
    return salvage_json_under(raw, F.array(*(F.lit(k) for k in keys)))


@F.pandas_udf(row_type(clean="string", marks=T.ArrayType(row_type(pos="int", text="string", original="string")), glosses=PLACES, raised=T.ArrayType(row_type(raw_pos="int", spaces="int", letter="string", context="string"))))
def clean_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text without marks of `punctuation` (a set of characters; empty: marks stay), glosses and white space, and where
    those were: the place of a mark or gloss is that of the clean character before it (0 at the beginning). raised has
    the characters raised by spaces, by their place in the raw text."""
    for raw, punctuation, take_glosses in batches:
        for s in pieces(raw):
            rows = [glosses.clean(text or "", marks, bool(marks), take) for text, marks, take in zip(raw[s], punctuation[s], take_glosses[s], strict=True)]
            yield pd.DataFrame(rows, columns=["clean", "marks", "glosses", "raised"])


@F.pandas_udf(T.ArrayType(row_type(raw_pos="int", text="string", before="string", after="string")))
def find_glosses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Glosses of up to four syllables that stand between an ideograph and another one, a mark, white space or the end."""
    for raw in batches:
        for s in pieces(raw):
            yield pd.Series([glosses.find_glosses(text or "") for text in raw[s]])

"""Secret scans in DataFrame operations alone: patterns, and a randomness test battery for what they miss.

Base spans are the leftmost non-overlapping matches of three patterns. The battery looks at maximal runs of encoding
characters that mix letters and digits. For each the encoding is inferred (the smallest alphabet that holds the run),
and uniformity over that alphabet is tested: chi-squared, runs about the alphabet's middle, and lag-one serial
correlation, combined by Fisher's method. Benjamini-Hochberg is applied to all runs of one length class (short runs
have weak tests, so they are not pooled with long ones): runs rejected as random at rate `fdr` are ordinary identifiers
and go; the rest are added as spans of kind `random` where no base span overlaps them. What is controlled is thus the
share of random runs (keys) among those that go, not the share of identifiers among those that stay: that depends on
the tests' power, which grows with a run's length.

Every step is linear in a text's length but for running sums and maxima over its matches (n log n).

The rejection threshold of a class comes from a histogram of -log2(p) in steps of 1/16, which is of bounded size and
exact up to the step; the same steps decide at every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged

#: The base patterns and, by group or length, what they need.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 characters or more
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: Alphabets from the smallest.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Lower ends of the length classes, and steps of the p-value histogram to a halving.
LENGTHS, STEPS, MOST_STEPS = (20, 28, 40, 64, 128), 16, 4800
KINDS = "assign:access:hex:random"


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each element of an int array and all before it: in step k elements take in those 2^k before them."""

    def step(acc: Column, k: Column) -> Column:
        s = F.pow(F.lit(2), k).cast("int")
        moved = F.concat(F.transform(F.slice(acc, F.lit(1), s), lambda _: F.lit(None).cast("int")), F.slice(acc, F.lit(1), F.size(acc) - s))
        return F.when(s < F.size(acc), F.zip_with(acc, moved, lambda a, b: F.when(b.isNull(), a).otherwise(op(a, b)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), x, step)


def found(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, rank, kind, end, hit>> of the matches whose group has `least` characters or more.

    The text split at the matches gives what lies between them, so running sums of lengths are code point offsets.
    """
    rank, none = KINDS.split(":").index(kind), F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,hit:string>>)")
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), group).alias("g"))
    parts = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(x["hit"].alias("hit"), F.char_length(x["hit"]).alias("n"), F.char_length(x["gap"]).alias("gap"), (F.char_length(x["g"]) >= least).alias("keep")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(p, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"), x["keep"].alias("keep")))

    kept = F.filter(F.transform(F.array(parts), placed)[0], lambda x: x["keep"])
    return F.when(text.rlike(pattern), F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "kind", "end", "hit"))))).otherwise(none)


def apart(base: Column, runs: Column) -> Column:
    """The runs that no base span overlaps: with all in order of their starts, no earlier base span ends behind a run's
    start, and no later one starts before its end."""
    rank = KINDS.split(":").index("random")

    def kept(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: F.when(x["rank"] < rank, x["end"]).otherwise(0)), F.greatest)
        coming = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["rank"] < rank, x["start"]).otherwise((1 << 31) - 1))), F.least))
        alone = F.filter(F.arrays_zip(s.alias("s"), reach.alias("reach"), coming.alias("coming")), lambda x: (x["s"]["rank"] == rank) & (x["reach"] <= x["s"]["start"]) & (x["coming"] >= x["s"]["end"]))
        return F.transform(alone, lambda x: x["s"])

    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(F.transform(F.array(F.array_sort(F.concat(base, runs))), kept)[0])


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (logistic approximation, within 0.0002)."""
    return f"(1 / (1 + exp(least(700D, 1.5976 * ({z}) + 0.07056 * pow({z}, 3)))))"


def with_steps(runs: str) -> str:
    """SQL: the runs (array of structs with hit) with enc, a, codes and the test steps."""
    case = " ".join(f"when translate(r.hit, '{letters}', '') = '' then '{letters}'" for letters in ALPHABETS.values())
    coded = f"transform({runs}, r -> named_struct('start', r.start, 'end', r.end, 'letters', case {case} else '{ALPHABETS['base64']}-_' end, 'hit', r.hit))"
    coded = f"transform({coded}, r -> named_struct('start', r.start, 'end', r.end, 'a', double(length(r.letters)), 'n', double(length(r.hit)), 'codes', transform(split(r.hit, ''), c -> double(locate(c, r.letters) - 1))))"
    sums = (
        "transform({x}, r -> named_struct('start', r.start, 'end', r.end, 'a', r.a, 'n', r.n, 'codes', r.codes,"
        " 'chi', r.a / r.n * aggregate(array_distinct(r.codes), 0D, (s, c) -> s + pow(size(filter(r.codes, y -> y = c)), 2)) - r.n,"
        " 'mean', aggregate(r.codes, 0D, (s, c) -> s + c) / r.n,"
        " 'high', double(size(filter(r.codes, c -> c >= r.a / 2))),"
        " 'turns', 1D + size(filter(sequence(2, int(r.n)), i -> (element_at(r.codes, i) >= r.a / 2) <> (element_at(r.codes, i - 1) >= r.a / 2)))))"
    ).format(x=coded)
    moments = (
        "transform({x}, r -> named_struct('start', r.start, 'end', r.end, 'n', r.n, 'df', r.a - 1, 'chi', r.chi, 'high', r.high, 'low', r.n - r.high, 'turns', r.turns,"
        " 'var', aggregate(r.codes, 0D, (s, c) -> s + pow(c - r.mean, 2)),"
        " 'lag', aggregate(sequence(2, int(r.n)), 0D, (s, i) -> s + (element_at(r.codes, i) - r.mean) * (element_at(r.codes, i - 1) - r.mean))))"
    ).format(x=sums)
    chi_z = "((pow(r.chi / r.df, 1D / 3) - (1 - 2 / (9 * r.df))) / sqrt(2 / (9 * r.df)))"
    even = "(2 * r.high * r.low / r.n)"
    runs_z = f"(abs(r.turns - {even} - 1) / sqrt(greatest(1e-9D, {even} * ({even} - 1) / (r.n - 1))))"
    lag_z = "(if(r.var > 0, abs(r.lag / r.var + 1 / r.n), 1D) * sqrt(r.n))"
    logs = f"transform({moments}, r -> named_struct('start', r.start, 'end', r.end, 'n', r.n, 'x', -ln(greatest(1e-290D, {_tail(chi_z)})) - ln(greatest(1e-290D, least(1D, 2 * {_tail(f'if(r.high * r.low > 0, {runs_z}, r.n)')}))) - ln(greatest(1e-290D, least(1D, 2 * {_tail(lag_z)})))))"
    # Fisher: the sum x of three -ln(p) has the upper tail exp(-x) (1 + x + x^2 / 2)
    return f"transform({logs}, r -> named_struct('start', r.start, 'end', r.end, 'n', int(r.n), 'step', int(least({MOST_STEPS}, floor({STEPS} * (r.x - ln(1 + r.x + r.x * r.x / 2)) / ln(2D))))))"


def length_class(n: str) -> str:
    return "case " + " ".join(f"when {n} >= {low} then {low}" for low in reversed(LENGTHS)) + " end"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans lists kind:start:end by start, then kind as listed (code points, end exclusive), comma-joined; base_sha256 is
    the SHA-256 of the list of base spans alone.

    Defined results: null and empty texts have no spans; repeated rows each have their own result; offsets count code
    points in the whole text however long; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(found(text, ASSIGN, "assign", 8, 2), found(text, ACCESS, "access"), found(text, HEX, "hex")).alias("base"), found(text, RUN, "random").alias("runs"))
    rows = rows.select("doc_id", "base", apart(F.col("base"), F.col("runs")).alias("runs"))
    bare = F.transform("base", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "rank", "kind", "end"))))
    rows = rows.select("doc_id", F.array_sort(bare).alias("base"), F.expr("if(size(runs) = 0, null, " + with_steps("runs") + ")").alias("runs"))
    rows = staged(rows, "secret-spans")  # spans without texts: patterns and tests run once

    tested = rows.where("size(runs) > 0").selectExpr("inline(runs)").selectExpr(f"{length_class('n')} as class", "step")
    bins = tested.groupBy("class", "step").count()
    ranked = bins.selectExpr("class", "step", "sum(count) over (partition by class order by step desc) as rank", "sum(count) over (partition by class) as m")
    passed = ranked.where(F.expr(f"pow(2D, -step / {float(STEPS)}D) <= {fdr}D * rank / m"))
    cuts = {r["class"]: r["cut"] for r in passed.groupBy("class").agg(F.min("step").alias("cut")).collect()}  # a row per length class
    case = "case " + " ".join(f"when r.n >= {low} then {cuts.get(low, MOST_STEPS + 1)}" for low in reversed(LENGTHS)) + " end"
    added = F.expr(f"transform(filter(coalesce(runs, array()), r -> r.step < {case}), r -> named_struct('start', r.start, 'rank', {KINDS.split(':').index('random')}, 'kind', 'random', 'end', r.end))")
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", added)))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS.split(":")), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))

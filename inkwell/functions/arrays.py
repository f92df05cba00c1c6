"""Arrays and texts by position, linear in their length (but for a logarithm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(x: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """op (a sum) over each element of an int array and all before it: step k takes in the 2^k elements before."""

    def step(acc: Column, k: Column) -> Column:
        s = F.pow(F.lit(2), k).cast("int")
        moved = F.concat(F.transform(F.slice(acc, F.lit(1), s), lambda _: F.lit(None).cast("int")), F.slice(acc, F.lit(1), F.size(acc) - s))
        return F.when(s < F.size(acc), F.zip_with(acc, moved, lambda a, b: F.when(b.isNull(), a).otherwise(op(a, b)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), x, step)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once, however often use names it."""
    return F.transform(F.array(x), use)[0]


def letters(text: Column) -> Column:
    return F.split(text, "")


def piece(chars: Column, start: Column, n: Column | int) -> Column:
    """The text of n letters from start (0-based) on; substring would walk the text from its beginning."""
    return F.array_join(F.slice(chars, start + 1, n if isinstance(n, Column) else F.lit(n)), "")


def starts_of(text: Column, needle: Column, overlapping: bool = False) -> Column:
    """array<int>: where needle occurs in text; null needles occur nowhere. The text is cut before every occurrence, or
    at it, and the lengths of the parts add up to the places."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    none = F.expr("cast(array() as array<int>)")
    if overlapping:
        # no empty part comes before an occurrence at the very beginning
        sizes = F.transform(F.split(text, F.concat(F.lit("(?="), quoted, F.lit(")")), -1), F.char_length)
        sizes = F.when(F.startswith(text, needle), F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)
        found = once(sizes, lambda s: F.slice(running(s), F.lit(1), F.size(s) - 1))
    else:
        n = F.char_length(needle)
        gaps = F.transform(F.split(text, quoted, -1), F.char_length)
        found = once(gaps, lambda g: F.transform(running(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), lambda x: x + n)), lambda end: end - n))
    return F.when(F.contains(text, needle) & (needle != ""), found).otherwise(none)


def stretches(chars: Column, n: int) -> Column:
    """array<string>: all stretches of n letters, in order of their places; none if there are fewer letters."""

    def cut(c: Column) -> Column:
        last = F.size(c) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: piece(c, i, n))

    return once(chars, cut)

"""difflib's ratio of two strings, by searching stretches in them where difflib walks over all pairs of equal letters."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

#: difflib's rule: letters that are more than 1 % of a second text of so many letters only prolong a match.
LONG, SHARE = 200, 100


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio()."""
    if a == b:
        return 1.0
    searched, most = b, len(b) // SHARE + 1
    if len(b) >= LONG and (often := [c for c, n in Counter(b).items() if n > most]):
        nowhere = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in a and c not in b)
        searched = b.translate({ord(c): nowhere for c in often})
    there = set(searched)
    usable = [i for i, c in enumerate(a) if c in there]
    matched, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        a_low, a_high, b_low, b_high = parts.pop()
        at, place, n = a_low, b_low, 0
        for i in usable[bisect_left(usable, a_low) : bisect_left(usable, a_high)]:
            # of the longest stretches the first in a, and of those the first in b
            while i + n < a_high and (j := searched.find(a[i : i + n + 1], b_low, b_high)) >= 0:
                at, place, n = i, j, n + 1
            if i + n >= a_high:
                break
        while at > a_low and place > b_low and a[at - 1] == b[place - 1]:
            at, place, n = at - 1, place - 1, n + 1
        while at + n < a_high and place + n < b_high and a[at + n] == b[place + n]:
            n += 1
        if n:
            matched += n
            if at > a_low and place > b_low:
                parts.append((a_low, at, b_low, place))
            if at + n < a_high and place + n < b_high:
                parts.append((at + n, a_high, place + n, b_high))
    return 2.0 * matched / (len(a) + len(b))

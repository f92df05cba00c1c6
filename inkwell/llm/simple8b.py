"""Simple-8b: varying counts of unsigned integers in 64-bit words, vectorised over blocks.

A word has a 4-bit selector (lowest bits) and 60 bits of payload. Selectors 1 to 15 give how many values of how many
bits it holds. Selector 0 is the escape: the next word is one raw 64-bit value. Values are coded in blocks of
BLOCK_VALUES that start on a word of their own, so blocks are packed side by side, and a reader with the blocks' word
offsets unpacks all words of one selector at once. The last word of a block may hold fewer values than it has room for.
"""

from __future__ import annotations

import numpy as np

BLOCK_VALUES = 256
#: Values to a word and bits to a value, by selector from 1.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """The first selector whose bits hold each value; 15 (beyond all) for values that need the escape."""
    limits = (np.uint64(1) << BITS[1:].astype(np.uint64)) - np.uint64(1)
    return (np.searchsorted(limits, values, side="left") + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the words of all blocks, and each block's first word with the total at the end."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    begin = np.arange(0, n, BLOCK_VALUES)
    end = np.minimum(begin + BLOCK_VALUES, n)
    width = _widths(values)
    wide, used = {}, []
    for s in range(1, 15):
        if n and (width <= s).any():
            sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(width > s, dtype=np.int32)))
            k = int(COUNTS[s])
            if n < k or s > 12 or (sums[k:] == sums[:-k]).any():  # else no word could be full
                wide[s] = sums
                used.append(s)
    at, made = begin.copy(), []
    active = np.arange(len(begin))
    while len(active):
        pos, stop = at[active], end[active]
        chosen = np.zeros(len(active), np.int64)
        upto = pos + 1
        for s in used:
            to = np.minimum(pos + COUNTS[s], stop)
            fits = (chosen == 0) & (wide[s][to] == wide[s][pos])
            chosen[fits], upto[fits] = s, to[fits]
        made.append((active, pos, chosen, upto))
        at[active] = upto
        active = active[upto < stop]
    if not made:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    block, pos, chosen, upto = (np.concatenate([m[i] for m in made]) for i in range(4))
    order = np.lexsort((pos, block))
    block, pos, chosen, upto = block[order], pos[order], chosen[order], upto[order]
    takes = 1 + (chosen == 0)
    first = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[first[rows] + 1] = values[pos[rows]]
            continue
        held = np.full(len(rows), s, np.uint64)
        for k in range(COUNTS[s]):
            there = pos[rows] + k < upto[rows]
            held[there] |= values[pos[rows][there] + k] << np.uint64(4 + k * BITS[s])
        words[first[rows]] = held
    offsets = np.concatenate((np.searchsorted(block, np.arange(len(begin))), [len(block)]))
    return words, np.concatenate((first, [len(words)]))[offsets]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode()'s words."""
    out = np.zeros(n + 64, np.uint64)
    if not n:
        return out[:0]
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):  # escapes are rare; a raw word is not itself read as a selector
        if not raw[i]:
            raw[i + 1 : i + 2] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    count = np.where(selector == 0, 1, COUNTS[selector])
    block = np.searchsorted(offsets, heads, side="right") - 1
    total = np.concatenate(([0], np.cumsum(count)))
    starts = block * BLOCK_VALUES + total[:-1] - total[np.searchsorted(heads, offsets[:-1])][block]
    stop = np.minimum((block + 1) * BLOCK_VALUES, n)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[starts[rows]] = words[heads[rows] + 1]
            continue
        payload, low = words[heads[rows]] >> np.uint64(4), np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            to = starts[rows] + k
            there = to < stop[rows]
            out[to[there]] = (payload[there] >> np.uint64(k * BITS[s])) & low
    return out[:n]

"""Differences of two sequences by their longest common subsequence, in O((n + m) d) steps for d differences."""

from __future__ import annotations

import numpy as np

KINDS = ("unchanged", "removed", "added")


def line_operations(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(kind, line) in order. Of equally short scripts the one is given that, read from the end, keeps equal lines
    first, else adds before it removes.

    reach[d] has for each diagonal (place in old less place in new) how far into old d differences lead. Lines of the
    end are kept as long as they are equal; at a difference, the script with one difference less that comes from the
    line above in new is taken if it leads there at all.
    """
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(x, len(names)) for x in lines], np.int64) for lines in (old, new))
    n, m = len(a), len(b)
    reach: list[np.ndarray] = []
    while True:
        d = len(reach)
        diagonal = np.arange(-d, d + 1, 2)
        far = np.zeros(d + 1, np.int64)
        if d:  # one line of old more, from the diagonal below, or one of new, from the diagonal above
            far[1:] = reach[-1] + 1
            far[:-1] = np.maximum(far[:-1], reach[-1])
        live = np.arange(len(far))
        while len(live):
            x, y = far[live], far[live] - diagonal[live]
            inside = (x < n) & (y < m) & (y >= 0)
            live, x, y = live[inside], x[inside], y[inside]
            same = a[x] == b[y] if len(live) else np.zeros(0, bool)
            live = live[same]
            far[live] += 1
        reach.append(far)
        goal = (n - m + d) // 2
        if (n - m + d) % 2 == 0 and 0 <= goal <= d and far[goal] >= n:
            break
    out, i, j, d = [], n, m, len(reach) - 1
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((KINDS[0], old[i]))
            continue
        d -= 1
        slot = i - j + 1 + d  # twice the place of the diagonal of (i, j - 1)
        if j and slot % 2 == 0 and 0 <= slot // 2 <= d and reach[d][slot // 2] >= i:
            j -= 1
            out.append((KINDS[2], new[j]))
        else:
            i -= 1
            out.append((KINDS[1], old[i]))
    return out[::-1]

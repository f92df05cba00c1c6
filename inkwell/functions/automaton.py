"""Many patterns in one pass: an Aho-Corasick automaton in flat arrays, stepped for many stretches of text at once."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Letters of a stretch; stretches of a batch are stepped side by side.
STRETCH = 2048


class Automaton:
    """All occurrences of patterns (non-empty, distinct strings).

    States are slots of a double array: the successor of state s by a letter of class c is base[s] + c if check of that
    slot is s. fail leads to the longest proper suffix that is a state, output to the pattern that ends in a state (-1:
    none), shorter to the next state on the way along fail in which a pattern ends (0: none).
    """

    def __init__(self, patterns: list[str]):
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        self.alphabet = np.array(sorted({ord(c) for p in patterns for c in p}), np.int64)
        class_of = {chr(c): i + 1 for i, c in enumerate(self.alphabet)}
        children: list[dict[int, int]] = [{}]
        ends = {}
        for number, pattern in enumerate(patterns):
            node = 0
            for c in pattern:
                step = class_of[c]
                if step not in children[node]:
                    children[node][step] = len(children)
                    children.append({})
                node = children[node][step]
            ends[node] = number
        width = len(self.alphabet) + 1
        taken, free = bytearray(len(children) + 2 * width), 1
        taken[0] = 1
        slot, base = [0] * len(children), [0] * len(children)
        queue, order = deque([0]), []
        while queue:
            node = queue.popleft()
            order.append(node)
            if not children[node]:
                continue
            steps = sorted(children[node])
            at = max(0, free - steps[0])
            while any(taken[at + s] for s in steps):
                at += 1
                if at + width >= len(taken):
                    taken.extend(bytes(len(taken)))
            base[node] = at
            for s in steps:
                taken[at + s] = 1
                slot[children[node][s]] = at + s
                queue.append(children[node][s])
            while taken[free]:
                free += 1
                if free + width >= len(taken):
                    taken.extend(bytes(len(taken)))
        size = max(slot) + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size + width, -1, np.int32)
        self.fail, self.output, self.shorter = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        suffix = [0] * len(children)
        for node in order:
            own = slot[node]
            self.base[own] = base[node]
            self.output[own] = ends.get(node, -1)
            back = slot[suffix[node]]
            if node:
                self.fail[own] = back
                self.shorter[own] = back if self.output[back] >= 0 else self.shorter[back]
            for s, child in children[node].items():
                self.check[base[node] + s] = own
                at = suffix[node]
                while node and at and s not in children[at]:
                    at = suffix[at]
                suffix[child] = children[at].get(s, 0) if node else 0
        self.ends = (self.output >= 0) | (self.shorter > 0)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, start) of all occurrences, overlaps included, in order of text, end and falling length."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))  # a letter of no class parts the texts
        codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not len(codes):
            return none, none, none
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        classes = np.where(self.alphabet[place] == codes, place + 1, 0).astype(np.int32)
        classes[begin[1:] - 1] = 0
        ahead = int(self.sizes.max()) - 1  # letters before a stretch in which an occurrence may begin
        stretch = max(STRETCH, 2 * ahead)
        n = -(-len(classes) // stretch)
        padded = np.zeros(ahead + n * stretch, np.int32)
        padded[ahead : ahead + len(classes)] = classes
        lanes = np.lib.stride_tricks.as_strided(padded, (ahead + stretch, n), (padded.itemsize, stretch * padded.itemsize))
        state, where, states = np.zeros(n, np.int32), [], []
        for i in range(ahead + stretch):
            c = lanes[i]
            old = np.where(c > 0, state, 0)
            state = self.base[old] + c
            left = np.flatnonzero(self.check[state] != old)
            while len(left):
                up = old[left]
                state[left[up == 0]] = 0
                left, up = left[up > 0], up[up > 0]
                old[left] = self.fail[up]
                state[left] = self.base[old[left]] + c[left]
                left = left[self.check[state[left]] != old[left]]
            if i >= ahead and len(hit := np.flatnonzero(self.ends[state])):
                where.append(hit * stretch + i - ahead)
                states.append(state[hit])
        if not where:
            return none, none, none
        at, state, found = np.concatenate(where), np.concatenate(states), []
        while len(at):
            own = self.output[state] >= 0
            found.append((at[own], self.output[state[own]].astype(np.int64)))
            state = self.shorter[state]
            at, state = at[state > 0], state[state > 0]
        end, pattern = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-self.sizes[pattern], end))
        end, pattern = end[order], pattern[order]
        of = np.searchsorted(begin, end, side="right") - 1
        return of, pattern, end - begin[of] - self.sizes[pattern] + 1

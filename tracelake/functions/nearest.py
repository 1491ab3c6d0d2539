"""Texts within some edits of each other, found in the tree of prefixes of sorted texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Most places in the tree that are looked at together, for one part of the texts asked.
PLACES = 1 << 18
SLACK = 1e-9


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters one after the other, where each text begins, and its length."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(size) - size, size


class Level:
    """The prefixes of one length: the last letter, what is below, and the text that ends here."""

    def __init__(self, letter, first, children, text, shortest, longest):
        self.letter, self.first, self.children, self.text = letter, first, children, text
        self.shortest, self.longest = shortest, longest
        self.key: np.ndarray | None = None


class Tree:
    """Prefixes of distinct texts in ascending order, by length."""

    def __init__(self, texts: list[str]):
        flat, begin, size = _letters(texts)
        #: Letters are numbered from 1; 0 is any other letter, and no letter.
        self.alphabet = np.unique(flat)
        code = np.searchsorted(self.alphabet, flat).astype(np.int32) + 1
        self.radix = len(self.alphabet) + 1
        self.size = size
        rows, node, letter, parent = np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(1, np.int32), None
        self.levels: list[Level] = []
        for depth in range(int(size.max(initial=0)) + 1):
            n = len(letter)
            begins = np.searchsorted(node, np.arange(n))
            text, ends = np.full(n, -1, np.int64), size[rows] == depth
            text[node[ends]] = rows[ends]
            self.levels.append(Level(letter, np.zeros(n, np.int64), np.zeros(n, np.int64), text,
                                     np.minimum.reduceat(size[rows], begins), np.maximum.reduceat(size[rows], begins)))
            rows, above = rows[~ends], node[~ends]
            if not len(rows):
                break
            letters = code[begin[rows] + depth]
            new = np.r_[True, (above[1:] != above[:-1]) | (letters[1:] != letters[:-1])]
            node, letter, parent = np.cumsum(new) - 1, letters[new], above[new]
            last = self.levels[-1]
            last.first = np.searchsorted(parent, np.arange(n))
            last.children = np.searchsorted(parent, np.arange(n), "right") - last.first
            last.key = parent * self.radix + letter

    def near(self, asked: list[str], edits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (number of the text asked, number of the text here, edits between them), for at most as many edits as given.

        A place is a text asked, a prefix, and the edits between the prefix and each start of the text asked whose length
        is near its own. Places are followed letter by letter while something below can still be near enough, at most
        ``PLACES`` at a time and the longest prefixes first, so that what is held does not grow with what is found.
        """
        most = int(edits.max(initial=0))
        band, none = 2 * most + 1, np.int16(most + 1)
        flat, begin, size = _letters(asked)
        at = np.searchsorted(self.alphabet, flat)
        at[at == len(self.alphabet)] = 0
        code = np.where(self.alphabet[at] == flat, at + 1, 0).astype(np.int32) if len(self.alphabet) else np.zeros(len(flat), np.int32)
        # Letters of each text asked, with room for starts shorter than none and longer than all of it.
        wide = int(size.max(initial=0)) + 3 * most + 3
        sheet = np.zeros(len(asked) * wide, np.int32)
        row = np.repeat(np.arange(len(asked)), size)
        sheet[row * wide + most + np.arange(len(flat)) - begin[row]] = code
        edits = edits.astype(np.int16)

        start = np.arange(-most, most + 1)
        first = np.where(start >= 0, start, none).astype(np.int16)[:, None]
        who = np.arange(len(asked))
        state = np.where((start[:, None] <= size[who]), first, none).astype(np.int16)
        todo = [(0, who, np.zeros(len(asked), np.int64), state)]
        empty = self.levels[0].text[0]
        if empty >= 0:
            hit = size <= edits
            yield who[hit], np.full(int(hit.sum()), empty), size[hit].astype(np.int16)
        while todo:
            depth, who, node, state = todo.pop()
            if len(who) > PLACES:
                half = len(who) // 2
                todo += [(depth, who[s], node[s], state[:, s]) for s in (slice(half, None), slice(None, half))]
                continue
            level = self.levels[depth]
            if level.key is None or not len(who):
                continue
            below = self.levels[depth + 1]
            budget = edits[who]
            # With no edit left only the letter that is asked for can follow; else any can.
            free = state.min(axis=0) < budget
            some = np.flatnonzero(free)
            many = level.children[node[some]]
            place = np.repeat(some, many)
            child = np.repeat(level.first[node[some]] - (np.cumsum(many) - many), many) + np.arange(len(place))
            tight = np.flatnonzero(~free)
            if len(tight):
                offset, which = np.nonzero(state[:, tight] == budget[tight])
                which = tight[which]
                wants = node[which] * self.radix + sheet[who[which] * wide + depth + offset]
                found = np.searchsorted(level.key, wants)
                found[found == len(level.key)] = 0
                ok = level.key[found] == wants
                pair = np.unique(which[ok] * len(level.key) + found[ok])
                place, child = np.r_[place, pair // len(level.key)], np.r_[child, pair % len(level.key)]
            for s in range(0, len(place), 4 * PLACES):
                step = self._step(below, depth + 1, who, state, place[s:s + 4 * PLACES], child[s:s + 4 * PLACES], sheet, wide, size, edits, most)
                who2, node2, state2 = step
                text = below.text[node2]
                offset = size[who2] - (depth + 1) + most
                ends = np.flatnonzero((text >= 0) & (offset >= 0) & (offset < band))
                cost = state2[offset[ends], ends]
                hit = cost <= edits[who2[ends]]
                ends = ends[hit]
                if len(ends):
                    yield who2[ends], text[ends], cost[hit]
                todo.append((depth + 1, who2, node2, state2))

    @staticmethod
    def _step(below: Level, depth: int, who, state, place, child, sheet, wide: int, size, edits, most: int):
        """Places one letter longer, those left out from which nothing near enough can be reached."""
        who, old, letter = who[place], state[:, place], below.letter[child]
        base = who * wide + depth - 1
        band, rest = 2 * most + 1, (size[who] - depth + most).astype(np.int32)
        low, high = (below.shortest[child] - depth).astype(np.int32), (below.longest[child] - depth).astype(np.int32)
        new, alive, budget = np.empty_like(old), np.zeros(len(place), bool), edits[who]
        for t in range(band):
            cost = old[t] + (sheet[base + t] != letter)
            if t + 1 < band:
                np.minimum(cost, old[t + 1] + 1, out=cost)
            if t:
                np.minimum(cost, new[t - 1] + 1, out=cost)
            left = rest - t                     # letters of the text asked behind this start
            np.minimum(cost, most + 1, out=cost)
            cost[left < 0] = most + 1
            new[t] = cost
            alive |= cost + np.maximum(np.maximum(low - left, left - high), 0) <= budget
        keep = np.flatnonzero(alive)
        return who[keep], child[keep], new[:, keep]


def nearest(asked: list[str], tree: Tree, edits: int, cutoff: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text asked, number of the text in the tree) of the ``most`` best for each text asked.

    Only pairs within ``edits`` edits count, and with 1 - edits / longer length of at least ``cutoff``; the
    higher goes first, of equal ones the earlier text.
    """
    none = np.zeros(0, np.int64)
    if not asked or not len(tree.size):
        return none, none
    size = np.fromiter(map(len, asked), np.int64, len(asked))
    # A pair that is near enough is no longer than this.
    longest = np.maximum(size, np.minimum(tree.size.max(), np.floor(size / cutoff + SLACK)))
    budget = np.minimum(edits, np.floor((1 - cutoff) * longest + SLACK)).astype(np.int64)
    who, what, score = [none], [none], [np.zeros(0)]
    kept = held = 0

    def best() -> None:
        nonlocal kept, held
        a, b, s = (np.concatenate(x) for x in (who, what, score))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else none
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        top = rank < most
        who[:], what[:], score[:] = [a[top]], [b[top]], [s[top]]
        kept = held = int(top.sum())

    for a, b, cost in tree.near(asked, budget):
        longer = np.maximum(size[a], tree.size[b])
        near = 1 - cost / np.maximum(longer, 1)
        ok = (near >= cutoff) & (longer > 0)
        who.append(a[ok])
        what.append(b[ok])
        score.append(near[ok])
        held += int(ok.sum())
        if held > 4 * kept + 1_000_000:
            best()
    best()
    return who[0], what[0]

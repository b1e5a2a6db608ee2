"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, search.

A shard's text is a row of pieces, each followed by a separator below every byte. Only
prefixes of ``depth`` bytes matter: refinement stops there, common prefixes are counted
up to there.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # of nine bits in a word
_BITS = 9
_SHIFTS = np.arange(_SYMBOLS - 1, -1, -1, dtype=np.uint64) * np.uint64(_BITS)  # first symbol first
_SYMBOL = np.uint64((1 << _BITS) - 1)


class SuffixArray:
    """``order``: suffixes sorted by their first ``depth`` symbols; ``rank``: equal where those are."""

    def __init__(self, pieces: list[bytes], depth: int) -> None:
        self.depth = depth
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        n = int((self.lengths + 1).sum())
        text = np.zeros(n + _SYMBOLS, np.uint64)
        inside = np.ones(n, bool)
        inside[self.starts + self.lengths] = False
        text[:n][inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64) + np.uint64(1)
        self.words = np.zeros(n + depth + _SYMBOLS, np.uint64)
        for j in range(_SYMBOLS):
            self.words[:n] |= text[j : j + n] << np.uint64(_BITS * (_SYMBOLS - 1 - j))
        self.n = n
        self._refine()

    def _refine(self) -> None:
        """Sort by words, then by the ranks ``h`` symbols on, doubling ``h``, where still tied."""
        n = self.n
        order = np.argsort(self.words[:n], kind="stable")
        key = self.words[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((first, [n])))
        rank = np.full(n + self.depth + 1, -1, np.int64)
        rank[order] = np.repeat(first, size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        h = _SYMBOLS
        while h < self.depth and len(tied):
            at = order[tied]
            key = (rank[at] << 32) | (rank[np.minimum(at + h, n)] + 1)
            move = np.argsort(key, kind="stable")
            at, key = at[move], key[move]
            order[tied] = at
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((new, [len(at)])))
            rank[at] = np.repeat(tied[new], size)
            tied = tied[np.repeat(size > 1, size)]
            h *= 2
        self.order, self.rank = order, rank[:n]

    def common_prefixes(self) -> np.ndarray:
        """For each place in the order, symbols shared with the suffix before, up to ``depth``.

        Only for suffixes with ``depth`` symbols in their piece; others have zero.

        Kasai's walk in order of the text, where a prefix shrinks by one at most from a
        position to the next. All pieces walk at once. Neighbours that refinement left
        tied share ``depth`` symbols; as their order is open, the walk begins anew after
        the last of them.
        """
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        before = np.full(self.n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        tied = (before >= 0) & (self.rank == self.rank[before])
        shared = np.zeros(self.n, np.int64)
        pieces = np.argsort(-self.lengths, kind="stable")
        starts, lengths = self.starts[pieces], self.lengths[pieces]
        held = np.zeros(len(pieces), np.int64)
        loose = np.zeros(len(pieces), bool)
        for t in range(int(lengths[0]) - self.depth + 1 if len(lengths) else 0):
            going = int(np.searchsorted(-lengths, -(t + self.depth), side="right"))
            at = starts[:going] + t
            other = before[at]
            even = tied[at]
            h = np.where(even, self.depth, np.where(loose[:going], 0, np.maximum(held[:going] - 1, 0)))
            h[other < 0] = 0
            loose = even
            todo = np.flatnonzero((other >= 0) & ~even & (h < self.depth))
            while len(todo):
                step = self._agree(at[todo] + h[todo], other[todo] + h[todo])
                h[todo] += step
                todo = todo[(step == _SYMBOLS) & (h[todo] < self.depth)]
            held[:going] = np.minimum(h, self.depth)
            shared[place[at]] = held[:going]
        return shared

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Leading symbols that two words share; a separator agrees with nothing."""
        return _leading(self.words[a], self.words[b])

    def find(self, other: SuffixArray, at: np.ndarray) -> np.ndarray:
        """Places in this order of suffixes whose first ``depth`` symbols are those at ``other``'s positions ``at`` (-1: none).

        Binary search, all positions at once.
        """
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self._compare(self.order[middle], other, at[todo]) < 0
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        inside = np.minimum(low, self.n - 1)
        return np.where((low < self.n) & (self._compare(self.order[inside], other, at) == 0), inside, -1)

    def _compare(self, mine: np.ndarray, other: SuffixArray, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 by the first ``depth`` symbols."""
        out = np.zeros(len(mine), np.int64)
        todo, h = np.arange(len(mine)), 0
        while h < self.depth and len(todo):
            a, b = self.words[mine[todo] + h], other.words[theirs[todo] + h]
            rest = self.depth - h
            if rest < _SYMBOLS:
                cut = np.uint64(_BITS * (_SYMBOLS - rest))
                a, b = a >> cut, b >> cut
            out[todo] = np.where(a < b, -1, np.where(a > b, 1, 0))
            todo, h = todo[a == b], h + _SYMBOLS
        return out

    def repeated(self) -> np.ndarray:
        """Flags of positions whose ``depth`` symbols start at another position too."""
        equal = self.common_prefixes() >= self.depth
        flags = np.zeros(self.n, bool)
        flags[self.order[equal]] = True
        flags[self.order[:-1][equal[1:]]] = True
        return flags


def _leading(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading symbols of words, none counted from the first separator on."""
    same = (((a ^ b)[:, None] >> _SHIFTS) == 0) & ((a[:, None] >> _SHIFTS & _SYMBOL) != 0)
    return np.where(same.all(axis=1), _SYMBOLS, same.argmin(axis=1))

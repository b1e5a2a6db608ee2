"""An n-gram trie (two or three words) in Elias-Fano code with quantised probabilities, in memory-mapped levels."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping

import numpy as np

_ONE = np.uint64(1)
_MASKS = [(np.uint64(s), np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]
ABSENT = 255
_STEPS = 20.0  # codes per unit of log10
_MANY = 32  # a pass over a level is cheaper from one question for so many values
_RUN = 1 << 20  # values decoded at once


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-_STEPS * log10_p), 0, ABSENT - 1).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    return code / -_STEPS


def encode_monotone(values: np.ndarray) -> dict[str, np.ndarray]:
    """Elias-Fano: low bits packed, high parts as ones in a bit vector, ones before each word of it."""
    values = values.astype(np.uint64)
    n = len(values)
    bits = max(0, int(int(values[-1]) // max(1, n)).bit_length() - 1) if n else 0
    low = values & np.uint64((1 << bits) - 1)
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    packed = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits:
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(packed, word, low << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(packed, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    spots = ((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    length = int(spots[-1]) + 2 if n else 1
    vector = np.zeros(-(-length // 64) * 64, np.uint8)
    vector[spots] = 1
    high = np.packbits(vector, bitorder="little").view(np.uint64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
    return {"low": packed, "high": high, "ones": ones, "shape": np.array([n, bits], np.int64)}


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one number ``rank`` (from 0) in each 64-bit word."""
    place = np.zeros(len(word), np.uint64)
    rank = rank.astype(np.uint64)
    for shift, mask in _MASKS:
        below = np.bitwise_count(word & mask).astype(np.uint64)
        up = rank >= below
        place += np.where(up, shift, 0).astype(np.uint64)
        rank -= np.where(up, below, 0).astype(np.uint64)
        word = np.where(up, word >> shift, word)
    return place.astype(np.int64)


class Monotone:
    """Random access and successor search on an Elias-Fano sequence, many places at once."""

    def __init__(self, arrays: Mapping[str, np.ndarray], name: str) -> None:
        self.packed, self.high, self.ones = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones"))
        self.n, bits = map(int, arrays[f"{name}.shape"])
        self.bits = np.uint64(bits)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.bits
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.packed[word] >> shift
        rest = np.where(shift > 0, self.packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), 0)
        return (value | rest.astype(np.uint64)) & ((_ONE << self.bits) - _ONE)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        spot = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((spot - i).astype(np.uint64) << self.bits) | self.low(i)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``part``."""
        rank = part - 1
        rank = np.minimum(rank, self.zeros[-1] - 1)  # beyond the last part: all of them
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        word = np.maximum(word, 0)
        spot = word * 64 + _select_in_word(~self.high[word], np.maximum(rank - self.zeros[word], 0))
        return np.where(part <= 0, 0, np.where(part - 1 >= self.zeros[-1], self.n, np.minimum(self.n, spot - rank)))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't below ``x`` (the length, if there is none)."""
        part = (x >> self.bits).astype(np.int64)
        at, to = self._before(part), self._before(part + 1)
        low = x & ((_ONE << self.bits) - _ONE)
        todo = np.flatnonzero(at < to)
        while len(todo):
            middle = (at[todo] + to[todo]) >> 1
            less = self.low(middle) < low[todo]
            at[todo[less]] = middle[less] + 1
            to[todo[~less]] = middle[~less]
            todo = todo[at[todo] < to[todo]]
        return at

    def run(self, start: int, stop: int) -> np.ndarray:
        """The values from ``start`` to ``stop``, decoded in one pass over their words."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.ones, [start, stop - 1], side="right") - 1
        bits = np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little")
        rank = start - int(self.ones[first])
        spots = np.flatnonzero(bits)[rank : rank + stop - start] + 64 * int(first)
        places = np.arange(start, stop)
        return ((spots - places).astype(np.uint64) << self.bits) | self.low(places)

    def take(self, i: np.ndarray) -> np.ndarray:
        """The values at ``i``: one by one, or from a pass over the level where many are wanted."""
        return self[i] if len(i) * _MANY < self.n else self.run(0, self.n)[i]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor's place of each ``x``, and whether it equals ``x``; values are distinct.

        Few are looked for one by one. Many are sorted and meet the level in runs, each
        decoded once from the mapped file.
        """
        if len(x) * _MANY < self.n or not self.n:
            at = self.successor(x) if self.n else np.zeros(len(x), np.int64)
            same = np.zeros(len(x), bool)
            inside = at < self.n
            same[inside] = self[at[inside]] == x[inside]
            return at, same
        order = np.argsort(x, kind="stable")
        rising = x[order]
        found, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        done = 0
        for start in range(0, self.n, _RUN):
            values = self.run(start, min(self.n, start + _RUN))
            upto = int(np.searchsorted(rising, values[-1], side="right"))
            here = np.searchsorted(values, rising[done:upto])
            found[done:upto] = here + start
            equal[done:upto] = values[here] == rising[done:upto]
            done = upto
        at, same = np.empty_like(found), np.empty_like(equal)
        at[order], same[order] = found, equal
        return at, same


class Children:
    """The children of one level's nodes: pointers to each node's, their words relative to the node, codes.

    Words of one node grow; each node's begin where the ones before ended, so the whole
    level is one monotone sequence. Nodes may have no children.
    """

    def __init__(self, arrays: Mapping[str, np.ndarray], name: str) -> None:
        self.pointers, self.words = (Monotone(arrays, f"{name}.{x}") for x in ("pointers", "words"))
        self.codes = arrays[f"{name}.codes"]

    @staticmethod
    def levels(name: str, starts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Begin of each node's children (and the end), their words, ascending in a node, and their codes."""
        sizes = np.diff(starts)
        some = sizes > 0
        last = words[starts[1:][some] - 1] + 1
        relative = words + np.repeat(np.cumsum(last) - last, sizes[some])
        out = {f"{name}.codes": codes.astype(np.uint8)}
        for part, values in (("pointers", starts), ("words", relative)):
            out |= {f"{name}.{part}.{k}": v for k, v in encode_monotone(values).items()}
        return out

    def find(self, nodes: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each word among the children of its node, -1 where there is none.

        Each of ``nodes`` (-1: unknown) has the next ``lengths`` of ``words``.
        """
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not self.words.n:
            return out
        known = np.maximum(nodes, 0)
        begin, end = (self.pointers.take(n).astype(np.int64) for n in (known, known + 1))
        base = np.where(begin > 0, self.words.take(np.maximum(begin - 1, 0)) + _ONE, 0).astype(np.uint64)
        parent = (nodes >= 0) & (begin < end)
        ask = np.flatnonzero(np.repeat(parent, lengths))
        owner = np.repeat(np.arange(len(nodes)), lengths)[ask]
        found, same = self.words.search(base[owner] + words[ask].astype(np.uint64))
        hit = same & (found < end[owner])
        out[ask[hit]] = found[hit]
        return out


class Trie:
    """Contexts, their following words, and (three words) the words after those, with codes at each level.

    A bigram has a code for its probability and one for what it leaves to shorter
    contexts. ``close`` removes the mapped file, whose size is a shard's: a few bytes for
    each of its n-grams.
    """

    def __init__(
        self,
        contexts: np.ndarray,
        starts: np.ndarray,
        successors: np.ndarray,
        codes: np.ndarray,
        thirds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None,
    ) -> None:
        """Sorted context ids, begin of each context's successors (and the end), their ids, codes.

        ``thirds``: begin of each bigram's following words (and the end), their ids,
        their codes, and each bigram's code of what it leaves.
        """
        levels = Children.levels("seconds", starts, successors, codes)
        levels |= {f"contexts.{k}": v for k, v in encode_monotone(contexts).items()}
        if thirds:
            levels |= Children.levels("thirds", *thirds[:3]) | {"left": thirds[3].astype(np.uint8)}
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as file:
            places = {}
            for name, array in levels.items():
                file.write(b"\0" * (-file.tell() % 8))
                places[name] = (file.tell(), array.dtype, len(array))
                file.write(array.tobytes())
            file.write(b"\0" * 8)
        whole = np.memmap(self.path, np.uint8, "r")
        mapped = {k: whole[a : a + d.itemsize * n].view(d) for k, (a, d, n) in places.items()}
        self.contexts = Monotone(mapped, "contexts")
        self.seconds = Children(mapped, "seconds")
        self.thirds = Children(mapped, "thirds") if thirds else None
        self.left = mapped.get("left")

    def close(self) -> None:
        os.unlink(self.path)

    def places_of(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Places of the pairs of each context with its next ``lengths`` successors; -1 where unseen."""
        place, known = self.contexts.search(contexts.astype(np.uint64))
        return self.seconds.find(np.where(known, place, -1), lengths, successors)

    @staticmethod
    def _at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.full(len(places), ABSENT, np.uint8)
        seen = places >= 0
        out[seen] = codes[places[seen]]
        return out

    def codes_at(self, places: np.ndarray) -> np.ndarray:
        """Codes of bigrams by their places; 255 at -1."""
        return self._at(self.seconds.codes, places)

    def codes_of(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of the pairs of each context with its next ``lengths`` successors; 255 where unseen."""
        return self.codes_at(self.places_of(contexts, lengths, successors))

    def codes_after(self, places: np.ndarray, lengths: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each bigram (its place, or -1) leaves, and the codes of its next ``lengths`` words; 255 where unseen."""
        return self._at(self.left, places), self._at(self.thirds.codes, self.thirds.find(places, lengths, thirds))

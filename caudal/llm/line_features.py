"""Features of text lines, counted on whole Arrow buffers instead of line by line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Byte classes: 0 space, 1 upper, 2 lower and all beyond ASCII, 3 digit, 4 sentence punctuation, 5 other symbols.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*b" \t\n\x0b\x0c\r"]] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[[*b".,;:'\"()-?"]] = 4
_PIECE = 4_000_000  # bytes looked at in one go; longer lines are counted in pieces

_SHARES = np.array([0.01, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6])
_WORD_BYTES = np.array([2.0, 3.0, 4.0, 5.0, 6.5, 9.0, 14.0])
_LINE_BYTES = np.array([20.0, 60.0, 150.0, 400.0, 1000.0, 3000.0])
_NEAR = 4 * len(_SHARES) + 1  # of a neighbour: the share features and the repeated-line flag
WIDTH = 5 * len(_SHARES) + 1 + len(_WORD_BYTES) + len(_LINE_BYTES) + 2 * (_NEAR + 1) + 1

_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_B, inverse)]
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any stretch ``a:b`` is ``(sums[b] - sums[a]) * inverse[a]``."""
    powers, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])))
    return sums, inverse


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The array's bytes, begin and end of every line in them, and the lines of each text (one at least)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    breaks = np.flatnonzero(data[first:last] == 10) + first
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return data, begin, end, counts


def _sums(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[begin]


def _counts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line: five class counts, words, words equal to the one before; and the line's hash."""
    kind = _CLASS[data]
    out = np.zeros((len(begin), 7), np.int64)
    for k in range(1, 6):
        out[:, k - 1] = _sums(kind == k, begin, end)
    solid = np.concatenate(([False], kind > 0, [False]))
    cut = np.zeros(len(data) + 1, bool)  # texts lie end to end: a word ends with its line
    cut[begin] = cut[end] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    stops = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    sums, inverse = prefix_hashes(data)
    with np.errstate(over="ignore"):
        words = (sums[stops] - sums[starts]) * inverse[starts]
        whole = (sums[end] - sums[begin]) * inverse[begin]
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (stops[:-1] + 1 == starts[1:])))[: len(words)]
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    again[first[first < last]] = False
    out[:, 5] = last - first
    out[:, 6] = _sums(again, first, last)
    return out, whole


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, bytes of all lines, and the lines of each text.

    Shares are coded by the thresholds they reach. A line knows the lines beside it.
    A word cut where a line of over four million bytes is cut counts as two.
    """
    data, begin, end, counts = lines_of(texts)
    n, size = len(begin), end - begin
    pieces = np.maximum(1, -(-size // _PIECE))
    line = np.repeat(np.arange(n), pieces)
    step = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = begin[line] + step * _PIECE
    b = np.minimum(end[line], a + _PIECE)
    total, marks = np.zeros((n, 7), np.int64), np.zeros(n, np.uint64)
    at = 0
    while at < len(line):
        to = max(at + 1, int(np.searchsorted(b, a[at] + 2 * _PIECE, side="right")))
        found, whole = _counts(data[a[at] : b[to - 1]], a[at:to] - a[at], b[at:to] - a[at])
        np.add.at(total, line[at:to], found)
        with np.errstate(over="ignore"):
            np.add.at(marks, line[at:to], whole * (step[at:to].astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        at = to
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((marks, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (marks[order][1:] == marks[order][:-1])
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= size > 60

    upper, lower, digits, stops, symbols, words, again = total.T.astype(np.float64)
    solid = np.maximum(1, upper + lower + digits + stops + symbols)
    shares = [upper / np.maximum(1, upper + lower), symbols / solid, again / np.maximum(1, words), digits / solid]
    near = np.concatenate([*(x[:, None] >= _SHARES for x in shares), twice[:, None]], axis=1)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(counts)
    opens[ends - counts] = True
    closes[ends - 1] = True
    before = np.concatenate((np.zeros((1, _NEAR), bool), near[:-1])) & ~opens[:, None] if n else near
    after = np.concatenate((near[1:], np.zeros((1, _NEAR), bool))) & ~closes[:, None] if n else near
    rows = np.concatenate(
        [
            near,
            (stops / solid)[:, None] >= _SHARES,
            ((upper + lower + digits) / np.maximum(1, words))[:, None] >= _WORD_BYTES,
            size[:, None] >= _LINE_BYTES,
            before,
            opens[:, None],
            after,
            closes[:, None],
            np.ones((n, 1), bool),
        ],
        axis=1,
    )
    return rows, size, counts

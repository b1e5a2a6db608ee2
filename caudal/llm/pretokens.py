"""Splitting blocks of texts into pre-tokens by a pattern, each distinct stretch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from caudal.llm.blocks import mix
from caudal.llm.line_features import prefix_hashes


def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``begins[i] .. begins[i] + lengths[i] - 1``, one span after the other."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.arange(total) + np.repeat(begins - (stops - lengths), lengths)


def in_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of each block: rows in order until they hold ``block_bytes``, the last one whole."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = min(len(ends), int(np.searchsorted(ends, before + block_bytes - held)) + 1)
            ids.append(batch.column(0).slice(start, stop - start))
            texts.append(column.slice(start, stop - start))
            held += int(ends[stop - 1]) - before
            start = stop
            if held >= block_bytes:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _white(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each part begins, and ends, with white space; an empty one does both."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    flags = []
    for edge, here in ((offsets[:-1], 0), (offsets[1:] - 1, -1)):
        white = offsets[1:] == offsets[:-1]
        full = np.flatnonzero(~white)
        byte = data[edge[full]]
        white[full] = byte <= 32
        beyond = full[byte >= 128]
        white[beyond] = [p[here].isspace() for p in _listed(parts.take(pa.array(beyond)))]
        flags.append(white)
    return flags[0], flags[1]


def _listed(parts: pa.Array) -> list[str]:
    """The parts, none of which holds a space, as a list."""
    return _joined(parts).split(" ") if len(parts) else []


def _joined(parts: pa.Array) -> str:
    lists = pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), parts)
    return pc.binary_join(lists, pa.scalar(" ", parts.type))[0].as_py()


class Stretches(NamedTuple):
    """Texts in stretches that are searched for pre-tokens on their own."""

    codes: np.ndarray  # of the stretches of all texts in order: first the parts, then the others
    per_text: np.ndarray
    parts: pa.Array  # each stands between two cuts, after its space
    others: list[str]


def _at_spaces(texts: pa.Array) -> Stretches:
    """Texts cut before each space between two other characters that are no white space.

    Texts stay whole around longer white space. Every text has a stretch at least.
    """
    lists = pc.split_pattern(texts, " ")
    begins = lists.offsets.to_numpy()[:-1].astype(np.int64)
    begins -= begins[0] if len(begins) else 0
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    opens, closes = _white(coded.dictionary)
    first = np.zeros(len(code), bool)
    first[begins] = True
    starts = first.copy()
    starts[1:] |= ~(closes[code[:-1]] | opens[code[1:]])

    at = np.flatnonzero(starts)
    size = np.diff(np.append(at, len(code)))
    odd = (size > 1) | first[at]  # a text's beginning, or several parts
    seen = np.zeros(len(coded.dictionary), bool)
    seen[code[at[~odd]]] = True
    rank = np.cumsum(seen) - 1
    parts = coded.dictionary.filter(pa.array(seen))
    codes = rank[code[at]]
    place = spans(at[odd], size[odd])
    words = coded.dictionary.take(pa.array(code[place]))
    stops = np.concatenate(([0], np.cumsum(size[odd])))
    runs = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(stops), words), pa.scalar(" ", words.type))
    lead = pa.array(np.where(first[at[odd]], 0, 1)).cast(pa.int64())
    runs = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(" ", words.type), lead), runs, pa.scalar("", words.type))
    runs = runs.dictionary_encode()
    codes[odd] = len(parts) + runs.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(starts)
    per_text = np.diff(np.append(ends[begins] - 1, len(at))) if len(begins) else begins
    return Stretches(codes, per_text, parts, runs.dictionary.to_pylist())


def _by_shard(coded: pa.Array, shards: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct words as bytes in order of shard, and the number of words in each shard."""
    words = coded.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sums, inverse = prefix_hashes(np.frombuffer(words.buffers()[2] or b"", np.uint8))
    with np.errstate(over="ignore"):
        marks = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    shard = (mix(marks) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)], words.take(pa.array(order)), np.bincount(shard, minlength=shards)


def coded(
    texts: pa.Array, find: Callable[[str], Sequence[str]], shards: int, at_spaces: bool
) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Pre-tokens of each text, their codes in order, distinct words by shard, and words per shard.

    ``at_spaces`` says that ``find`` begins a match at every space between two
    characters that are no white space, whatever stands around them. Stretches between
    such places are then searched once per distinct stretch and not once per place.
    """
    if at_spaces:
        found = _at_spaces(texts)
    else:
        whole = texts.dictionary_encode()
        codes = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = Stretches(codes, np.ones(len(texts), np.int64), texts.slice(0, 0), whole.dictionary.to_pylist())
    words = list(find(" " + _joined(found.parts))) if len(found.parts) else []  # one search for all
    stops = np.cumsum(pc.utf8_length(found.parts).to_numpy(zero_copy_only=False) + 1)
    reached = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    length = np.diff(np.searchsorted(reached, stops, side="right"), prepend=0)
    others = [find(s) for s in found.others]
    length = np.concatenate((length, np.fromiter(map(len, others), np.int64, len(others))))
    words += [w for o in others for w in o]
    codes, vocabulary, sizes = _by_shard(pa.array(words, pa.large_string()).dictionary_encode(), shards)
    begin = np.cumsum(length) - length
    before = np.concatenate(([0], np.cumsum(length[found.codes])))
    ends = np.cumsum(found.per_text)
    counts = before[ends] - before[ends - found.per_text]
    return counts, codes[spans(begin[found.codes], length[found.codes])], vocabulary, sizes

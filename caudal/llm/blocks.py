"""Corpus-wide distinct words without a row per occurrence.

A block is a few megabytes of whole documents. Its words become codes in order of
position and a dictionary of distinct words. Dictionaries go to word shards (by a
hash of the word), where every distinct word of the corpus meets exactly once per
block; answers per word go back to the block, where the codes put them in position.
Shuffled are the codes (packed) and one entry for each distinct word of a block, so
a word that fills a third of the corpus is one entry per block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa

BLOCK_CHARS = 8_000_000  # a longer document is a block of its own

def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32 as zstd-packed byte planes."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


_HEAD = struct.Struct("<IBI")  # numbers, their width (with a flag: packed), bytes
_PACKED = 0x80
_LEAST_PACKED = 64  # bytes; a frame around fewer costs more than it saves


def bundle(*arrays: np.ndarray) -> bytes:
    """Several columns of unsigned numbers in one value, as packed byte planes where that pays."""
    out = []
    for a in arrays:
        width = a.dtype.itemsize
        data = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(len(a), width).T).tobytes()
        packed = len(data) >= _LEAST_PACKED
        if packed:
            data = pa.compress(data, codec="zstd", asbytes=True)
        out += [_HEAD.pack(len(a), width | _PACKED * packed, len(data)), data]
    return b"".join(out)


def unbundle(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, kind, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        width, planes = kind & ~_PACKED, data[at : at + size]
        if kind & _PACKED:
            planes = pa.decompress(planes, decompressed_size=n * width, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel())
        at += size
    return out


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def mix(values: np.ndarray) -> np.ndarray:
    """A mix of 64-bit numbers."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shards_of(words: Sequence[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(shards)


class Block:
    """Documents of one block: their columns, words in order, and the dictionary."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.words: list[pa.Array] = []
        self.chars = 0

    def add(self, row: tuple, words: Sequence, chars: int) -> None:
        self.rows.append((*row, len(words)))
        self.words.append(pa.array(words, pa.large_binary()))
        self.chars += chars

    def close(self, shards: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Codes, distinct words in order of shard, and the number of words in each shard."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        shard = shards_of(words.to_pylist(), shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[codes], words.take(pa.array(order)), np.bincount(shard, minlength=shards)


def in_blocks(
    rows: Iterator[tuple[tuple, str]], split: Callable[[str], Sequence], block_chars: int
) -> Iterator[Block]:
    """Fill blocks with (columns, text) rows; ``split`` gives a text's words as bytes."""
    block = Block()
    for columns, text in rows:
        block.add(columns, split(text), len(text))
        if block.chars >= block_chars:
            yield block
            block = Block()
    if block.rows:
        yield block

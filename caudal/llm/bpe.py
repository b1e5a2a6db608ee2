"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Texts are split into pre-tokens. A block keeps their positions as packed codes and
   sends its distinct pre-tokens to word shards.
2. A shard encodes each distinct word once and returns its ids to every block that
   asked. Words are spread by hash; a block asks once for each, so no word is hot.
3. Blocks are put together again: codes give each position its word's ids. The codes
   don't travel with the words: texts are split a second time for them, which is
   cheaper than to shuffle them twice. Both times the rows must come in the same
   partitions, as from files; a block is named after its content, so a difference is an
   error and never a wrong text.
4. Decoding looks every id up in the table of token bytes. That table and the ranks
   are the vocabulary file, read by the driver: the only thing that is broadcast, and
   its size doesn't depend on the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from caudal.llm import blocks, pretokens
from caudal.llm.pretokens import spans
from caudal.llm.tables import whole_text

PART = "block bigint, shard int, docs binary, body binary"  # shard -1: the block's documents
_LONG_WORD = 64  # bytes from which a heap of pairs pays
_BODIES = 128  # requests of blocks that a shard answers at once


@lru_cache(maxsize=4)
def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    pairs = map(bytes.split, vocabulary.splitlines())
    return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


@lru_cache(maxsize=4)
def token_table(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes one after the other, and where each id's bytes begin (and the last ends)."""
    ranks = ranks_of(vocabulary)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    begins = np.concatenate(([0], np.cumsum([len(t) for t in tokens], dtype=np.int64)))
    return np.frombuffer(b"".join(tokens), np.uint8), begins


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts merge by lowest rank, leftmost first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) >= _LONG_WORD:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        best = min((r for r in found if r >= 0), default=-1)
        if best < 0:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap: n log n for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # a part's end, by its begin
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            rank = ranks.get(word[i : end[end[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        alive[end[i]] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def encode_decode(
    docs: DataFrame,
    vocabulary: bytes,
    pattern: str,
    block_bytes: int = blocks.BLOCK_CHARS,
    at_spaces: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, ids, decoded``, the ids as little-endian unsigned 32-bit numbers.

    ``pattern`` splits a text (null: empty) into pre-tokens, each encoded separately,
    without special tokens; ``decoded`` has the bytes of the ids. Empty texts have no
    ids. Rows that repeat an id, null ids and texts of any length each keep their own
    row. Other columns are ignored. No rows: no rows.

    ``at_spaces`` is a promise about the pattern: at every space between two characters
    that are no white space a match begins, whatever stands around them. It holds for
    patterns whose matches take white space at their beginning only, and saves most of
    the search, as a block's distinct stretches between such spaces are searched once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * partitions
    shared = spark.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray, pa.Array, np.ndarray]]:
        """Name, documents, codes, words and words per shard of each block."""
        find = regex.compile(pattern).findall
        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(pretokens.in_blocks(batches, block_bytes)):
            counts, codes, words, sizes = pretokens.coded(texts, find, shards, at_spaces)
            table = pa.table({"doc_id": ids, "n": pa.array(counts, pa.int64())})
            content = xxhash.xxh3_64(codes.astype("<u4").tobytes(), seed=(part << 32) + number)
            content.update(words.buffers()[1])
            content.update(words.buffers()[2] or b"")
            yield content.intdigest() >> 1, table, codes, words, sizes

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, words, sizes in cut(batches):
            stops = np.cumsum(sizes)
            asked = np.flatnonzero(sizes)
            bodies = [blocks.to_bytes(pa.table({"word": words.slice(stops[s] - sizes[s], sizes[s])})) for s in asked]
            yield _parts(asked, name, [None] * len(asked), bodies)

    def send_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table, codes, _, sizes in cut(batches):
            body = int((sizes > 0).sum()).to_bytes(4, "little") + blocks.pack(codes)
            yield _parts([-1], name, [blocks.to_bytes(table)], [body])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(shared.value)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for start in range(0, len(batch), _BODIES):
                part = batch.slice(start, _BODIES)
                asked = [blocks.from_bytes(body.as_py()).column("word").combine_chunks() for body in part.column(3)]
                coded = pa.concat_arrays(asked).dictionary_encode()
                found = []
                for word in coded.dictionary.to_pylist():
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode_word(word, ranks)
                    found.append(ids)
                length = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.int64, int(length.sum()))
                begin = np.cumsum(length) - length
                codes, bodies, at = coded.indices.to_numpy(zero_copy_only=False), [], 0
                for words in asked:
                    code = codes[at : at + len(words)]
                    at += len(words)
                    lengths = length[code]
                    ids = flat[spans(begin[code], lengths)]
                    bodies.append(
                        len(code).to_bytes(4, "little")
                        + len(ids).to_bytes(4, "little")
                        + _sized(blocks.pack(lengths))
                        + blocks.pack(ids)
                    )
                columns = [part.column(i) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], part.schema.names)

    def together(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("shard")
        bodies = parts.column("body").to_pylist()
        if parts.column("docs")[0].as_py() is None:
            raise RuntimeError("the documents came in other partitions when they were read again")
        table = blocks.from_bytes(parts.column("docs")[0].as_py())
        counts = table.column("n").to_numpy()
        if len(bodies) - 1 != int.from_bytes(bodies[0][:4], "little"):
            raise RuntimeError("the documents came in other partitions when they were read again")
        codes = blocks.unpack(bodies[0][4:], int(counts.sum()))
        lengths, ids = [], []
        for body in bodies[1:]:
            n, flat = int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little")
            cut = 12 + int.from_bytes(body[8:12], "little")
            lengths.append(blocks.unpack(body[12:cut], n))
            ids.append(blocks.unpack(body[cut:], flat))
        length = np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype("<u4")
        begin = np.cumsum(length) - length
        data, begins = token_table(shared.value)
        stops = np.cumsum(counts)
        out: list[tuple[bytes, bytes]] = []
        for start, stop in zip(stops - counts, stops):
            code = codes[start:stop]
            doc_ids = flat[spans(begin[code], length[code])]
            text = data[spans(begins[doc_ids], begins[doc_ids + 1] - begins[doc_ids])].tobytes()
            out.append((doc_ids.tobytes(), text))
        made = [pa.array([r[i] for r in out], pa.binary()) for i in range(2)]
        return pa.table([table.column("doc_id"), *made], names=["doc_id", "ids", "decoded"])

    texts = docs.select("doc_id", whole_text().alias("text"))
    words = texts.mapInArrow(send_words, PART)
    answers = words.repartition(partitions, "shard").mapInArrow(encode, PART)
    rows = texts.mapInArrow(send_documents, PART).unionByName(answers)
    return rows.groupBy("block").applyInArrow(together, f"doc_id {id_type}, ids binary, decoded binary")


def _parts(shard: Sequence[int], block: int, docs: list, body: list[bytes]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(([block] * len(shard), shard, docs, body), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["block", "shard", "docs", "body"])


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data

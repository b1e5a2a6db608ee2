"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes. Every byte range between two neighbouring cuts of
either lies in one token of each: it is one link of that pair of ids. Where both cut,
a group of tokens ends.

1. A block is a few megabytes of whole documents, at most 65,535 of them. Its texts are
   tokenized, and its links are inverted: for each pair of ids a bitmap of the block's
   documents that hold it, and bit planes of how often (the count less one, in binary).
   Bitmaps are compressed: sorted document numbers of two bytes where that is shorter
   than a bit for each document. They are the rows ``block, pair, plane, n, bits`` of a
   written table, ``n`` the bits set (plane -1: the documents).
2. Blocks hold different documents, so to OR a pair's bitmaps is to lay them side by
   side, and the popcount is the sum of ``n``: documents from plane -1, links from all
   planes by their weight. Sums are taken map-side first, so a pair that every document
   holds is no hot key. The best count of each id follows from them.
3. The postings return scores: joined with their pair's counts they go back to their
   block, where every document adds up the scores of the bitmaps it is set in. Texts are
   not read or tokenized again.

The two vocabulary files are read by the driver and broadcast; their size doesn't
depend on the corpus. They are used as they are, neither tokenizer is trained.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm import blocks
from caudal.llm.tables import kept, whole_text

_DOC_BITS = 16  # of a document's number in its block
_COLUMNS = ["block", "pair", "plane", "n", "bits"]
_POSTINGS = "block long, pair long, plane int, n long, bits binary"

Tokenizer = tuple[Callable[[str], list[int]], list[bytes]]  # encode, and the bytes of every id


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_level(file: bytes, pattern: str) -> Tokenizer:
    """A byte-level BPE tokenizer from its JSON file; special tokens' strings are plain text.

    Merges run by their rank in the file. ``pattern`` cuts texts into pre-tokens.
    """
    model = json.loads(file)["model"]
    letters, vocabulary = _byte_letters(), model["vocab"]

    def as_bytes(entry: str) -> bytes:
        return bytes(letters[c] for c in entry)

    table = [b""] * (max(vocabulary.values()) + 1)
    for entry, number in vocabulary.items():
        table[number] = as_bytes(entry) if all(c in letters for c in entry) else entry.encode()
    merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    entries = list(dict.fromkeys([*letters, *merged]))
    numbers = [vocabulary[e] for e in entries]
    ranks = {as_bytes(e): rank for rank, e in enumerate(entries)}
    made = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if numbers == list(range(len(numbers))):
        return made.encode_ordinary, table
    return lambda text: [numbers[rank] for rank in made.encode_ordinary(text)], table


@lru_cache(maxsize=2)
def pieces(file: bytes) -> Tokenizer:
    """A sentence-piece tokenizer from its model file; U+2581 stands for a space, <0xHH> for a byte."""
    made = sentencepiece.SentencePieceProcessor(model_proto=file)
    table = []
    for number in range(made.get_piece_size()):
        piece = made.id_to_piece(number)
        table.append(bytes([int(piece[3:-1], 16)]) if made.is_byte(number) else piece.replace("▁", " ").encode())
    return lambda text: made.encode(text, num_threads=1), table


@lru_cache(maxsize=4)
def _written(size: int) -> np.ndarray:
    """Every id below ``size`` in digits, followed by a separator, as eight bytes: a row for each of ``,|;``."""
    if size > 10**7:
        raise ValueError("ids of more than seven digits")
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], "S8").view(np.uint64)


class _Block:
    """Tokens of a block's documents, one after the other."""

    def __init__(self) -> None:
        self.ids: list = []
        self.tokens: tuple[list, list] = ([], [])
        self.counts: tuple[list, list] = ([], [])
        self.chars = 0

    def add(self, doc, a: Sequence[int], b: Sequence[int], chars: int) -> None:
        self.ids.append(doc)
        for side, found in enumerate((a, b)):
            self.tokens[side].append(np.array(found, np.int32))
            self.counts[side].append(len(found))
        self.chars += chars


def _both(text: str, a: Tokenizer, b: Tokenizer) -> tuple[Sequence[int], Sequence[int]]:
    """Ids of both tokenizers; none where the text is empty or either doesn't give its bytes back."""
    if text:
        data = b" " + text.encode()
        ids_a, ids_b = a[0](" " + text), b[0](text)
        if b"".join(map(a[1].__getitem__, ids_a)) == data and b"".join(map(b[1].__getitem__, ids_b)) == data:
            return ids_a, ids_b
    return (), ()


def _ends(lengths: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    marks = np.zeros(total + 1, bool)
    marks[ends] = True
    return ends, marks


def _aligned(block: _Block, lengths: tuple[np.ndarray, np.ndarray]):
    """Per document: groups, links, digests; per link: its tokens' ids and document."""
    ids = [np.concatenate([np.zeros(0, np.int32), *t]) for t in block.tokens]
    counts = [np.array(c, np.int64) for c in block.counts]
    total = int(lengths[0][ids[0]].sum())
    ends, marks = zip(*(_ends(lengths[i][ids[i]], total) for i in range(2)))
    cuts = np.flatnonzero(marks[0] | marks[1])
    before = [np.cumsum(m[cuts]) - m[cuts] for m in marks]  # the token of each link
    doc_of = np.repeat(np.arange(len(counts[0])), counts[0])
    link_doc = doc_of[before[0]]
    shared = [marks[1][ends[0]], marks[0][ends[1]]]
    n_groups = np.bincount(doc_of[shared[0]], minlength=len(counts[0]))
    n_links = np.bincount(link_doc, minlength=len(counts[0]))

    # Groups in order, each its tokens of A and then of B.
    group = [np.cumsum(s) - s for s in shared]
    begins = [np.concatenate(([0], np.flatnonzero(s) + 1)) for s in shared]
    text = np.empty(len(ids[0]) + len(ids[1]), np.uint64)
    digits = [_written(len(lengths[i])) for i in range(2)]
    text[np.arange(len(ids[0])) + begins[1][group[0]]] = digits[0][shared[0] * 1, ids[0]]
    text[np.arange(len(ids[1])) + begins[0][group[1] + 1]] = digits[1][shared[1] * 2, ids[1]]
    digests, at = [], 0
    for size in counts[0] + counts[1]:
        one = text[at : at + size].tobytes().translate(None, b"\0")[:-1]
        digests.append(hashlib.sha256(one).hexdigest() if size else "")
        at += size
    table = pa.table(
        {
            "n_a": counts[0],
            "n_b": counts[1],
            "n_groups": n_groups,
            "n_links": n_links,
            "groups_sha256": pa.array(digests, pa.string()),
        }
    )
    return table, ids[0][before[0]], ids[1][before[1]], link_doc


def _bitmaps(docs: np.ndarray, sizes: np.ndarray, n_docs: int) -> pa.Array:
    """A compressed bitmap for each run of ``sizes`` ascending document numbers.

    Two bytes a document, or a bit for each of the block's documents where that is no longer.
    """
    width = -(-n_docs // 8)
    dense = 2 * sizes >= width
    row = np.repeat(np.arange(len(sizes)), sizes)
    in_dense = dense[row]
    bits = np.zeros((int(dense.sum()), width), np.uint8)
    place = np.cumsum(dense) - 1
    number = docs[in_dense]
    np.bitwise_or.at(bits, (place[row[in_dense]], number >> 3), (1 << (number & 7)).astype(np.uint8))
    length = np.where(dense, width, 2 * sizes)
    cuts = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(int(cuts[-1]), np.uint8)
    in_row = np.repeat(dense, length)
    out[in_row] = bits.ravel()
    out[~in_row] = docs[~in_dense].astype("<u2").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(out)])


def _inverted(pair: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, pa.Array]]:
    """``pairs, plane, n, bits`` of the links: the bitmaps of documents, then the planes of further occurrences."""
    entry, times = np.unique(pair << _DOC_BITS | doc, return_counts=True)
    pair, doc, more = entry >> _DOC_BITS, entry & ((1 << _DOC_BITS) - 1), times - 1
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        has = np.flatnonzero((more >> plane) & 1) if plane >= 0 else np.arange(len(pair))
        if len(has):
            first = np.flatnonzero(np.diff(pair[has], prepend=-1))
            sizes = np.diff(first, append=len(has))
            yield pair[has[first]], plane, sizes, _bitmaps(doc[has], sizes, n_docs)


def postings(docs: DataFrame, a_file: bytes, b_file: bytes, pattern: str, block_chars: int = blocks.BLOCK_CHARS) -> DataFrame:
    """The inverted pair bitmaps of ``docs`` (``doc_id, text``), a written table.

    ``pair`` is id A times the size of vocabulary B plus id B. The row of a block whose
    pair is null holds the block's documents (Arrow) with what needs no corpus counts.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((a_file, b_file))

    def filled(batches: Iterator[pa.RecordBatch], a: Tokenizer, b: Tokenizer) -> Iterator[tuple[_Block, pa.DataType]]:
        block, kind = _Block(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                block.add(doc, *_both(text, a, b), len(text))
                if block.chars >= block_chars or len(block.ids) == (1 << _DOC_BITS) - 1:
                    yield block, kind
                    block = _Block()
        if block.ids:
            yield block, kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(files.value[0], pattern), pieces(files.value[1])
        lengths = tuple(np.fromiter(map(len, t[1]), np.int64, len(t[1])) for t in (a, b))
        part = TaskContext.get().partitionId()
        for number, (block, kind) in enumerate(filled(batches, a, b)):
            name, n_docs = (part << 32) + number, len(block.ids)
            table, id_a, id_b, doc = _aligned(block, lengths)
            body = blocks.to_bytes(table.add_column(0, "doc_id", pa.array(block.ids, kind)))
            columns = [pa.array([v], k) for v, k in ((name, pa.int64()), (None, pa.int64()), (None, pa.int32()), (n_docs, pa.int64()), (body, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS)
            pair = id_a.astype(np.int64) * len(lengths[1]) + id_b
            for pairs, plane, n, bits in _inverted(pair, doc, n_docs):
                columns = [pa.array(np.full(len(pairs), name)), pa.array(pairs), pa.array(np.full(len(pairs), plane, np.int32)), pa.array(n), bits]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    texts = docs.select("doc_id", whole_text().alias("text"))
    return kept(texts.mapInArrow(run, _POSTINGS), "pair-postings")


def pair_counts(postings: DataFrame, b_size: int) -> DataFrame:
    """``pair, a, b, n_docs, n_links, best``: popcounts over the whole corpus, a written table.

    ``best``: no other id of A has more links with this id of B (ties are all best).
    """
    weight = F.expr("shiftleft(1L, greatest(plane, 0))")
    counts = (
        postings.filter("pair is not null")
        .groupBy("pair")
        .agg(
            F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("n_docs"),
            F.sum(F.col("n") * weight).alias("n_links"),
        )
        .select("pair", F.expr(f"pair div {b_size}").alias("a"), (F.col("pair") % b_size).alias("b"), "n_docs", "n_links")
    )
    of_b = Window.partitionBy("b")  # as many rows as vocabulary A has ids, at most
    return kept(counts.withColumn("best", F.col("n_links") == F.max("n_links").over(of_b)), "pair-counts")


def _set_documents(bits: pa.Array, n: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and document number of every bit that is set in the bitmaps."""
    width = -(-n_docs // 8)
    dense = 2 * n >= width
    data = np.frombuffer(b"".join(bits.to_pylist()), np.uint8)
    length = np.where(dense, width, 2 * n)
    in_dense = np.repeat(dense, length)
    rows = np.flatnonzero(dense)
    row, doc = np.nonzero(np.unpackbits(data[in_dense].reshape(-1, width), axis=1, bitorder="little")) if len(rows) else ([], [])
    sparse = np.flatnonzero(~dense)
    listed = data[~in_dense].view("<u2").astype(np.int64)
    return (
        np.concatenate([rows[np.asarray(row, np.int64)], np.repeat(sparse, n[sparse])]),
        np.concatenate([np.asarray(doc, np.int64), listed]),
    )


def align(docs: DataFrame, a_file: bytes, b_file: bytes, pattern: str, block_chars: int = blocks.BLOCK_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A space and the text are tokenized by ``a_file`` (byte-level BPE, JSON), the text by
    ``b_file`` (pieces, which add the space). ``n_best`` links have a count that no other
    pair of their id B exceeds, ``count_sum`` adds up the corpus counts of the links (it
    has to fit 64 bits). Null and empty texts, and texts that either tokenizer doesn't
    give back byte for byte, have no tokens: zeros and an empty digest. Rows that repeat
    an id, and null ids, keep their own rows; other columns are ignored. No rows: no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    b_size = len(pieces(b_file)[1])
    stored = postings(docs, a_file, b_file, pattern, block_chars)
    counts = pair_counts(stored, b_size).select("pair", "n_links", "best")
    scored = stored.filter("pair is not null").join(counts, "pair").select("block", "plane", "n", "bits", "n_links", "best")
    heads = stored.filter("pair is null").select(
        "block", "plane", "n", "bits", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("best")
    )

    def score(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        is_head = part.column("plane").is_null()
        table = blocks.from_bytes(part.filter(is_head).column("bits")[0].as_py())
        links = part.filter(pc.invert(is_head)).combine_chunks()
        n_best, count_sum = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        if len(links):
            n, plane = links.column("n").to_numpy(), links.column("plane").to_numpy()
            weight = np.left_shift(np.int64(1), np.maximum(plane, 0).astype(np.int64))
            row, doc = _set_documents(links.column("bits").chunk(0), n, len(table))
            np.add.at(count_sum, doc, (weight * links.column("n_links").to_numpy())[row])
            np.add.at(n_best, doc, (weight * links.column("best").to_numpy())[row])
        table = table.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        return table.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return heads.unionByName(scored).groupBy("block").applyInArrow(
        score,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )

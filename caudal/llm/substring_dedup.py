"""Removing every byte covered by a long string that also starts elsewhere.

1. Anchors. Every string of ``length`` bytes is assigned to the smallest hash of the
   ``_GRAM``-byte grams in it, the leftmost of equals. Equal strings have equal grams
   at equal places, so they meet at equal anchors: a string whose anchor occurs once in
   the corpus can't repeat. The strings of one anchor start side by side; with their
   bytes they are a piece, about 560 bytes.
2. Anchor shards count anchors and distinct pieces (by 128-bit digests, copies within a
   block collapsed). Whole copies of a piece are thereby known to repeat, and only one
   of them goes on, only if its anchor has other pieces.
3. The remaining distinct pieces of an anchor meet in a shard: a suffix array by
   Larsson-Sadakane refinement, common prefixes by Kasai's walk. Shards are cut into
   arrays of bounded size; an anchor whose pieces straddle two of them is merged by
   binary search of the second's strings in the first.
4. An anchor with more than ``crowd`` distinct pieces (a short passage in very many
   documents) would make a shard as large as its group. Its strings are counted by
   128-bit digests instead, collapsed per block: exact, spread by digest, no group.
5. Blocks of documents put the answers together.

Texts travel twice, packed, to their block, with the places and anchors of their pieces,
which are found once; everything else is digests and the few
pieces that differ. One block or one shard is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from caudal.llm import blocks
from caudal.llm.blocks import bundle, mix, unbundle
from caudal.llm.line_features import prefix_hashes
from caudal.llm.suffix_array import SuffixArray
from caudal.llm.tables import kept, whole_text

LENGTH = 400
CROWD = 4096  # distinct pieces of an anchor
BLOCK_BYTES = 6_000_000
_GRAM = 80
_SLICE = 2_000_000  # string starts looked at together
_ARRAY_BYTES = 4_000_000
_PLACE_BITS = np.uint64(24)

# What anchor shards answer for a piece.
UNIQUE, COPIES, SENT_COPY, OTHER_COPY, SENT, CROWD_COPY, CROWD_SENT = range(7)

PART = "key int, block bigint, shard int, docs binary, body binary"


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, and anchor hash, of every piece of texts laid end to end."""
    found = []
    limits = np.concatenate(([0], ends))
    for at in range(0, max(0, len(data) - length + 1), _SLICE):
        to = min(len(data) - length + 1, at + _SLICE)
        found.append(_slice_pieces(data[at : to + length - 1], at, to, limits, length, gram))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _slice_pieces(data, at, to, limits, length, gram):
    sums, inverse = prefix_hashes(data)
    with np.errstate(over="ignore"):
        hashes = mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    place = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes >> _PLACE_BITS << _PLACE_BITS) | place
    window = length - gram + 1
    least = _sliding_least(key, window)[: to - at]
    anchor = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    start = np.arange(at, to)
    text = np.repeat(np.arange(1, len(limits)), np.diff(np.clip(limits, at, to)))  # the limit after the start
    inside = start + length <= limits[np.minimum(text, len(limits) - 1)]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    new = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(np.concatenate(([True], new)))
    last = np.concatenate((first[1:] - 1, [len(start) - 1]))
    return start[first], start[last], hashes[anchor[first]]


def _sliding_least(key: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours: least from a border to the left and to the right."""
    n = len(key)
    padded = np.full(-(-n // window) * window, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(-1, window)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - window + 1], right[window - 1 : n])


class Texts:
    """A block: texts end to end, and its pieces collapsed to distinct ones in order of shard."""

    def __init__(
        self, data: bytes, ends: np.ndarray, shards: int, length: int, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]
    ) -> None:
        self.data, self.ends, self.length = data, ends, length
        self.first, self.last, anchor = pieces
        digest = xxhash.xxh3_128_digest
        marks = b"".join([digest(data[a : b + length]) for a, b in zip(self.first.tolist(), self.last.tolist())])
        marks = np.frombuffer(marks, "<u8").reshape(-1, 2)
        order = np.lexsort((marks[:, 1], marks[:, 0], anchor % np.uint64(shards)))
        marks, anchor = marks[order], anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = (marks[1:] != marks[:-1]).any(axis=1)
        edges = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)  # of each piece, its distinct piece
        self.group[order] = np.cumsum(new) - 1
        self.some = order[edges]  # a piece of each distinct one
        self.marks, self.anchor = marks[edges], anchor[edges]
        self.copies = np.diff(np.concatenate((edges, [len(order)])))
        self.sizes = np.bincount((self.anchor % np.uint64(shards)).astype(np.int64), minlength=shards)

    def bytes_of(self, distinct: int) -> bytes:
        piece = self.some[distinct]
        return self.data[self.first[piece] : self.last[piece] + self.length]

    def strings(self, distinct: np.ndarray) -> np.ndarray:
        """How many strings the distinct pieces have."""
        piece = self.some[distinct]
        return self.last[piece] - self.first[piece] + 1


def count_pieces(bodies: list[bytes], crowd: int) -> list[bytes]:
    """What to do with each block's distinct pieces, from all pieces of a shard's anchors."""
    parts = [unbundle(b) for b in bodies]
    anchor, low, high, copies = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((np.arange(len(anchor)), high, low, anchor))
    anchor, low, high, copies = (x[order] for x in (anchor, low, high, copies.astype(np.int64)))
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_piece = new_anchor.copy()
    new_piece[1:] |= (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    piece, group = np.cumsum(new_piece) - 1, np.cumsum(new_anchor) - 1
    total = np.add.reduceat(copies, np.flatnonzero(new_piece))[piece]
    kinds = np.bincount(group[new_piece])[group]
    several = np.where(kinds > crowd, CROWD_COPY, SENT_COPY)
    single = np.where(kinds > crowd, CROWD_SENT, SENT)
    code = np.where(
        total > 1,
        np.where(kinds == 1, COPIES, np.where(new_piece, several, OTHER_COPY)),
        np.where(kinds == 1, UNIQUE, single),
    )
    out = np.empty(len(code), np.uint8)
    out[order] = code
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [bundle(x) for x in np.split(out, cuts)]


def count_strings(bodies: list[bytes]) -> list[bytes]:
    """For each block's distinct strings of crowded anchors: does it start elsewhere?"""
    parts = [unbundle(b) for b in bodies]
    low, high, copies = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    total = np.add.reduceat(copies[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(total), np.uint8)
    out[order] = total > 1
    return [bundle(x) for x in np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])]


def repeated_strings(pieces: list[bytes], anchors: np.ndarray, length: int, array_bytes: int) -> list[np.ndarray]:
    """Flags of each piece's strings that start in another place of the pieces, too.

    Pieces of an anchor are neighbours. Arrays hold about ``array_bytes``; the strings of
    an anchor that goes on in the next array are looked up in the one before.
    """
    order = np.argsort(anchors, kind="stable")
    sizes = np.cumsum([len(pieces[i]) for i in order])
    cell = (sizes - 1) // array_bytes if len(order) else sizes
    flags: list[np.ndarray | None] = [None] * len(pieces)
    earlier: list[tuple[SuffixArray, np.ndarray, np.ndarray]] = []
    for number in np.unique(cell):
        members = order[cell == number]
        array = SuffixArray([pieces[i] for i in members], length)
        flag = array.repeated()
        for before, before_members, before_flag in earlier:
            shared = np.isin(anchors[members], anchors[before_members])
            starts, sizes_ = array.starts[shared], array.lengths[shared] - length + 1
            at = np.repeat(starts, sizes_) + np.arange(sizes_.sum()) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
            place = before.find(array, at)
            flag[at[place >= 0]] = True
            before_flag[before.order[place[place >= 0]]] = True
        last = anchors[members[-1]]
        still = [e for e in earlier if anchors[e[1][-1]] == last]
        for done in earlier:
            if not any(done is e for e in still):
                _collect(flags, *done, length)
        earlier = [*still, (array, members, flag)]
    for done in earlier:
        _collect(flags, *done, length)
    return flags


def _collect(flags: list, array: SuffixArray, members: np.ndarray, flag: np.ndarray, length: int) -> None:
    for i, start, size in zip(members, array.starts, array.lengths):
        flags[i] = flag[start : start + size - length + 1]


def look_for_repeats(bodies: list[bytes], length: int, array_bytes: int) -> list[bytes]:
    """A shard's suffix arrays over all blocks' pieces; flags of their strings, block by block."""
    parts = [unbundle(b) for b in bodies]
    pieces: list[bytes] = []
    for _, lengths, data in parts:
        raw, ends = data.tobytes(), np.cumsum(lengths.astype(np.int64))
        pieces += [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
    flags = repeated_strings(pieces, np.concatenate([p[0] for p in parts]), length, array_bytes)
    out, at = [], 0
    for anchors, *_ in parts:
        out.append(bundle(np.packbits(np.concatenate(flags[at : at + len(anchors)]))))
        at += len(anchors)
    return out


def _asked(texts: Texts, codes: np.ndarray, shards: int) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces that go to each shard; digests of crowded strings, their shards and owners."""
    sent = np.flatnonzero((codes == SENT) | (codes == SENT_COPY))
    shard = (texts.anchor[sent] % np.uint64(shards)).astype(np.int64)
    by_shard = {int(s): sent[shard == s] for s in np.unique(shard)}
    crowded = np.flatnonzero((codes == CROWD_SENT) | (codes == CROWD_COPY))
    digest, marks = xxhash.xxh3_128_digest, []
    for i in crowded:
        raw = texts.bytes_of(i)
        marks += [digest(raw[j : j + texts.length]) for j in range(len(raw) - texts.length + 1)]
    marks = np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2)
    order = np.lexsort((marks[:, 1], marks[:, 0], marks[:, 0] % np.uint64(shards)))
    return by_shard, crowded, marks, order


def _distinct_rows(marks: np.ndarray) -> np.ndarray:
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]).any(axis=1)
    return new


def repeats(
    docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES,
    gram: int = _GRAM, array_bytes: int = _ARRAY_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of removed bytes (begin, end exclusive), ``kept`` the
    bytes left, one after the other. Null texts are empty; texts shorter than ``length``
    lose nothing; a text that repeats a string loses all its places; rows that repeat an
    id are documents of their own. Ids may be null; other columns are ignored.
    """
    spark = docs.sparkSession
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size, kind_of_id = 0, None

        def send() -> pa.RecordBatch:
            data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            first, last, anchor = pieces_of(np.frombuffer(data, np.uint8), ends, length, gram)
            block = Texts(data, ends, shards, length, (first, last, anchor))
            stops = np.cumsum(block.sizes)
            asked = np.flatnonzero(block.sizes)
            bodies = []
            for s in asked:
                here = slice(stops[s] - block.sizes[s], stops[s])
                bodies.append(bundle(block.anchor[here], block.marks[here, 0].copy(), block.marks[here, 1].copy(), block.copies[here].astype(np.uint32)))
            table = pa.table({"doc_id": pa.array(ids, kind_of_id), "n": pa.array([len(t) for t in texts], pa.int64())})
            packed = pa.compress(data, codec="zstd", asbytes=True)
            packed = len(data).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed
            packed += bundle(np.diff(first, prepend=0).astype(np.uint32), (last - first).astype(np.uint32), anchor)
            return _parts(-1, [*asked, -1], (part << 32) + number, [None] * len(asked) + [blocks.to_bytes(table)], [*bodies, packed])

        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield send()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield send()

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        return _with_bodies(group, count_pieces(group.column("body").to_pylist(), crowd))

    parts = kept(
        docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, PART), "text-blocks"
    )
    codes = kept(parts.filter("shard >= 0").groupBy("shard").applyInArrow(count, PART), "piece-counts")

    def opened(group: pa.Table) -> tuple[Texts, np.ndarray, pa.Table]:
        bodies = dict(zip(group.column("shard").to_pylist(), group.column("body").to_pylist()))
        table = blocks.from_bytes(next(d for d in group.column("docs").to_pylist() if d is not None))
        packed = bodies.pop(-1)
        size, end = int.from_bytes(packed[:8], "little"), 16 + int.from_bytes(packed[8:16], "little")
        data = pa.decompress(packed[16:end], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        steps, sizes, anchor = unbundle(packed[end:])
        first = np.cumsum(steps, dtype=np.int64)
        texts = Texts(data, np.cumsum(table.column("n").to_numpy()), shards, length, (first, first + sizes, anchor))
        code = [np.zeros(0, np.uint8), *(unbundle(bodies[s])[0] for s in sorted(bodies))]
        return texts, np.concatenate(code), table

    def ask(group: pa.Table) -> pa.Table:
        texts, code, _ = opened(group)
        by_shard, _, marks, order = _asked(texts, code, shards)
        block = group.column("block")[0].as_py()
        bodies, keys = [], []
        for shard, distinct in by_shard.items():
            raw = [texts.bytes_of(i) for i in distinct]
            bodies.append(bundle(texts.anchor[distinct], np.array([len(r) for r in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8)))
            keys.append(shard)
        sorted_ = marks[order]
        new = _distinct_rows(sorted_)
        shard_of = (sorted_[new][:, 0] % np.uint64(shards)).astype(np.int64)
        copies = np.diff(np.concatenate((np.flatnonzero(new), [len(sorted_)]))).astype(np.uint32)
        for shard in np.unique(shard_of):
            here = shard_of == shard
            bodies.append(bundle(sorted_[new][here, 0].copy(), sorted_[new][here, 1].copy(), copies[here]))
            keys.append(shards + int(shard))
        return pa.Table.from_batches([_parts(-2, keys, block, [None] * len(keys), bodies)])

    def look_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        bodies = group.column("body").to_pylist()
        if group.column("shard")[0].as_py() < shards:
            return _with_bodies(group, look_for_repeats(bodies, length, array_bytes))
        return _with_bodies(group, count_strings(bodies))

    def put_together(group: pa.Table) -> pa.Table:
        answers = group.filter(pa.compute.equal(group.column("key"), -2))
        texts, code, table = opened(group.filter(pa.compute.not_equal(group.column("key"), -2)))
        by_shard, crowded, marks, order = _asked(texts, code, shards)
        found = dict(zip(answers.column("shard").to_pylist(), answers.column("body").to_pylist()))
        sizes = texts.strings(np.arange(len(texts.some)))
        begin = np.cumsum(sizes) - sizes
        flags = np.repeat((code == COPIES) | (code == SENT_COPY) | (code == OTHER_COPY) | (code == CROWD_COPY), sizes)
        for shard, distinct in by_shard.items():
            n = sizes[distinct]
            bits = np.unpackbits(unbundle(found[shard])[0], count=int(n.sum())).astype(bool)
            flags[_spans(begin[distinct], n)] |= bits
        if len(crowded):
            new = _distinct_rows(marks[order])
            kinds = np.concatenate([unbundle(found[s])[0] for s in sorted(found) if s >= shards]).astype(bool)
            bits = np.empty(len(order), bool)
            bits[order] = kinds[np.cumsum(new) - 1]
            flags[_spans(begin[crowded], sizes[crowded])] |= bits
        # Every piece has the flags of its distinct one; runs of covered bytes follow.
        n = sizes[texts.group]
        starts = _spans(texts.first, n)[flags[_spans(begin[texts.group], n)]]
        return _cut_texts(texts, table, starts)

    whole = parts.filter("shard < 0").unionByName(codes)
    asked = whole.groupBy("block").applyInArrow(ask, PART)
    answers = asked.groupBy("shard").applyInArrow(look_up, PART)
    rows = whole.unionByName(answers).groupBy("block").applyInArrow(
        put_together, f"doc_id {kind}, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    )
    return rows


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(begins - (stops - sizes), sizes)


def _cut_texts(texts: Texts, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Remove the ``length`` bytes at each start. No string crosses the end of a text."""
    starts = np.sort(starts)
    ids = table.column("doc_id")
    runs: list[list[dict]] = [[] for _ in range(len(ids))]
    left: list[bytes] = []
    opens = np.flatnonzero(np.concatenate(([True], starts[1:] - starts[:-1] > texts.length))) if len(starts) else starts
    first = starts[opens]
    last = np.concatenate((starts[opens[1:] - 1], starts[-1:])) + texts.length if len(starts) else starts
    # Runs of neighbouring texts touch at most: a run belongs to the texts it covers.
    ends = texts.ends
    begin_text = np.searchsorted(ends, first, side="right")
    for a, b, i in zip(first.tolist(), last.tolist(), begin_text.tolist()):
        while a < b:
            stop = min(b, int(ends[i]))
            if stop > a:
                base = int(ends[i - 1]) if i else 0
                runs[i].append({"begin": a - base, "end": stop - base})
            a, i = stop, i + 1
    at = 0
    for i, end in enumerate(ends.tolist()):
        text, keep, from_ = texts.data[at:end], [], 0
        for run in runs[i]:
            keep.append(text[from_ : run["begin"]])
            from_ = run["end"]
        left.append(b"".join([*keep, text[from_:]]))
        at = end
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        [ids, table.column("n"), pa.array(runs, spans), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
    )


def _with_bodies(group: pa.Table, bodies: list[bytes]) -> pa.Table:
    return group.drop_columns("body").append_column("body", pa.array(bodies, pa.binary()))


def _parts(key: int, shard: list, block: int, docs: list, body: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(([key] * len(shard), [block] * len(shard), shard, docs, body), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "block", "shard", "docs", "body"])

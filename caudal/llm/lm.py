"""Scoring with a trigram model kept as sharded Elias-Fano tries.

Texts are blocks of packed word codes (``blocks``). Counting and scoring take three
shuffles of packed columns, none with a row per token:

1. Distinct words with their training counts go to word shards, which add them up and
   return the word's id and count to each block that has it.
2. Distinct bigrams, each with the words that follow it, go to context shards with their
   training counts. A shard adds them up, builds a trie of what was seen in training
   (contexts, bigrams, trigrams), and answers each block's n-grams by successor search,
   a trigram's relative to its bigram.
3. Blocks put the answers in their words' places and add up by document.

The shards of the contexts follow a hash; a context with more than a shard's share of
all words is split over several shards by a hash of the following word, from its count.
A trigram goes where its bigram goes: a hot bigram costs its distinct followers in each
block, not its occurrences. What a task holds is a block or a shard, whose number is set
by the shuffle partitions.

    p(w | uv) = (c(uvw) + m(uv) p(w | v)) / (c(uv) + m(uv)),   m(x) = 4 c(x) ** 0.8
    p(w | v) = (c(vw) + m(v) p(w)) / (c(v) + m(v))
    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

The end of a text is a word of its own, and the context of the first word, which has no
longer one. Seen bigrams take their probability from the trie, in steps of 1/20 in
log10; others back off to m(v) p(w) / (c(v) + m(v)), exactly. A trigram's level holds its
own share c(uvw) / (c(uv) + m(uv)), and the bigram's what it leaves to the bigram model,
m(uv) / (c(uv) + m(uv)), in the same steps. ``order`` 2 leaves trigrams out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm import blocks, ngram_trie
from caudal.llm.blocks import bundle, mix, unbundle
from caudal.llm.bpe import spans
from caudal.llm.tables import kept, whole_text

BLOCK_CHARS = 10_000_000
ORDER = 3
END = b"\n"  # never a word: words have no white space
_PRIOR, _GROWTH = 4.0, 0.8
PART = "key int, block bigint, shard int, docs binary, body binary"
REPLY = "block bigint, shard int, body binary, tokens bigint, known bigint"
RESULT = "held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double"


def held_out(column: str = "doc_id"):
    """Texts the model doesn't learn from: crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def split(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    words.append(END)
    return words


def prior(count: np.ndarray) -> np.ndarray:
    return _PRIOR * count.astype(np.float64) ** _GROWTH


class BlockWords:
    """A block with its words' ids and training counts, and its distinct bigrams by shard."""

    def __init__(self, parts: dict[int, bytes], docs: bytes, shards: int, tokens: int, order: int) -> None:
        self.docs = blocks.from_bytes(docs)
        self.lengths = self.docs.column("n").to_numpy()
        self.codes = blocks.unpack(parts[-1], int(self.lengths.sum())).astype(np.int64)
        found = [unbundle(parts[s]) for s in range(shards) if s in parts]
        asked = [s for s in range(shards) if s in parts]
        self.ids = np.concatenate([f[0].astype(np.int64) * shards + s for f, s in zip(found, asked)])
        self.counts = np.concatenate([f[1].astype(np.int64) for f in found])
        stops = np.cumsum(self.lengths)
        before = np.concatenate(([0], self.codes[:-1]))
        before[stops - self.lengths] = self.codes[stops - 1]  # the end opens the next text
        n = len(self.ids)
        train = np.repeat(~self.docs.column("held_out").to_numpy(zero_copy_only=False), self.lengths)
        key = (before * n + self.codes) * 2 + train
        self.order = np.argsort(key, kind="stable").astype(np.int32)  # a block has fewer words than that
        key = key[self.order]
        pair = key >> 1
        self.edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        self.seen = np.add.reduceat(key & 1, self.edges)
        self.first, self.second = pair[self.edges] // n, pair[self.edges] % n
        copies = 1 + self.counts * shards // max(1, tokens)  # shards of a context
        part = (mix(self.ids[self.second]) % copies[self.first].astype(np.uint64)).astype(np.uint64)
        spread = mix(self.ids[self.first] ^ (part.astype(np.int64) << 40))
        self.shard = (spread % np.uint64(shards)).astype(np.int64)
        self.by_shard = np.argsort(self.shard, kind="stable")
        self.sizes = np.bincount(self.shard, minlength=shards)
        self.third = None
        if order > 2:
            self._trigrams(n, train, stops)

    def _trigrams(self, n: int, train: np.ndarray, stops: np.ndarray) -> None:
        """Distinct trigrams, grouped by their bigram; the first word of a text ends none."""
        bigram = np.empty(len(self.codes), np.int32)
        bigram[self.order] = np.repeat(np.arange(len(self.edges)), np.diff(np.append(self.edges, len(self.order))))
        at = np.ones(len(self.codes), bool)
        at[stops - self.lengths] = False
        self.ends_trigram = np.flatnonzero(at).astype(np.int32)
        self.context = bigram[self.ends_trigram - 1]
        key = (self.context.astype(np.int64) * n + self.codes[self.ends_trigram]) * 2 + train[self.ends_trigram]
        self.order3 = np.argsort(key, kind="stable").astype(np.int32)
        key = key[self.order3]
        triple = key >> 1
        self.edges3 = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), triple[1:] != triple[:-1])))
        self.seen3 = np.add.reduceat(key & 1, self.edges3) if len(key) else key
        triple = triple[self.edges3]
        self.third = triple % n
        self.followers = np.bincount(triple // n, minlength=len(self.edges))
        self.follow_at = np.cumsum(self.followers) - self.followers


def _grams(block: BlockWords) -> Iterator[tuple[int, bytes]]:
    """For each shard: contexts with counts and lengths, following words with counts, training counts.

    With trigrams: how many words follow each bigram, these words, their training counts.
    """
    ends = np.cumsum(block.sizes)
    for shard in np.flatnonzero(block.sizes):
        at = block.by_shard[ends[shard] - block.sizes[shard] : ends[shard]]
        first, second = block.first[at], block.second[at]
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(at)])))
        context = first[starts]
        after = []
        if block.third is not None:
            here = spans(block.follow_at[at], block.followers[at])
            after = [block.followers[at].astype(np.uint32), block.ids[block.third[here]].astype(np.uint32), block.seen3[here].astype(np.uint32)]
        yield int(shard), bundle(
            block.ids[context], block.counts[context], lengths.astype(np.uint32),
            block.ids[second], block.counts[second], block.seen[at].astype(np.uint32), *after,
        )


def _totals(key: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the rows seen in training, a row of each, and their counts added up."""
    train = np.flatnonzero(seen)
    order = np.argsort(key[train], kind="stable")
    train = train[order]
    key = key[train]
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[edges], train[edges], np.add.reduceat(seen[train], edges, dtype=np.int64) if len(key) else np.zeros(0, np.int64)


def _thirds(columns: list[np.ndarray], bigram: np.ndarray, keys: np.ndarray, total: np.ndarray) -> tuple:
    """The third level: begins of the bigrams' followers, followers, codes; and what bigrams leave."""
    followers, third, seen = columns
    width = int(third.max(initial=0)) + 1
    place = np.searchsorted(keys, np.repeat(bigram, followers))  # trained trigrams have a trained bigram
    key, _, times = _totals(place * width + third, seen)
    c = total.astype(np.float64)
    weight = prior(c)
    owner = key // width
    starts = np.searchsorted(owner, np.arange(len(keys) + 1))
    share = np.log10(times / (c + weight)[owner]) if len(key) else np.zeros(0)
    return starts, key % width, ngram_trie.quantise(share), ngram_trie.quantise(np.log10(weight / (c + weight)))


def answer(bodies: list[bytes], scale: float) -> list[bytes]:
    """Build a shard's trie from what all blocks sent, and code every block's n-grams."""
    parts = [unbundle(b) for b in bodies]
    context_id, context_count, length, word_id, word_count, seen, *after = (
        np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))
    )
    sizes = [[len(p[i]) for i in ((3, 3, 7) if after else (3,))] for p in parts]
    del parts
    contexts, place = np.unique(context_id, return_inverse=True)
    counts = np.zeros(len(contexts), np.int64)
    counts[place] = context_count
    owner = np.repeat(place, length)
    word_id = word_id.astype(np.int64)
    width = int(word_id.max()) + 1
    bigram = owner * width + word_id
    key, at, total = _totals(bigram, seen)
    v = counts[owner[at]].astype(np.float64)
    weight = prior(v)
    p = (total + weight * (word_count[at] + 0.1) / scale) / (v + weight)
    starts = np.searchsorted(key // width, np.arange(len(contexts) + 1))
    held = np.diff(starts) > 0  # contexts never seen in training are not in the trie
    thirds = _thirds(after, bigram, key, total) if after else None
    del bigram, owner, at
    trie = ngram_trie.Trie(
        contexts[held], np.concatenate((starts[:-1][held], starts[-1:])), key % width, ngram_trie.quantise(np.log10(p)), thirds
    )
    try:
        places = trie.places_of(context_id, length, word_id)
        levels = [trie.codes_at(places), *(trie.codes_after(places, after[0], after[1]) if after else ())]
    finally:
        trie.close()
    cuts = [np.split(level, np.cumsum([n[i] for n in sizes])[:-1]) for i, level in enumerate(levels)]
    return [bundle(*part) for part in zip(*cuts)]


def _scored(block: BlockWords, codes: list[np.ndarray], scale: float) -> list[np.ndarray]:
    """Per document: known words, sum of log10(c + 0.1), log10 probability."""
    count = block.counts.astype(np.float64)
    log_count = np.log10(count + 0.1)
    c = count[block.first]
    weight = prior(c)
    back = np.zeros(len(c))
    some = c > 0
    back[some] = np.log10(weight[some] / (c[some] + weight[some]))
    value = back + log_count[block.second] - np.log10(scale)
    got = np.empty(len(c), np.uint8)
    got[block.by_shard] = codes[0]
    value = np.where(got == ngram_trie.ABSENT, value, ngram_trie.dequantise(got))
    per_token = np.empty(len(block.codes))
    per_token[block.order] = np.repeat(value, np.diff(np.concatenate((block.edges, [len(block.order)]))))
    if block.third is not None:
        _add_trigrams(block, codes, per_token)
    begin = np.cumsum(block.lengths) - block.lengths
    known = np.add.reduceat((block.counts > 0)[block.codes].astype(np.int64), begin)
    return [known, np.add.reduceat(log_count[block.codes], begin), np.add.reduceat(per_token, begin)]


def _add_trigrams(block: BlockWords, codes: list[np.ndarray], per_token: np.ndarray) -> None:
    """Replace the bigram's log10 probability by the trigram's where the two words before were seen."""
    left = np.empty(len(block.edges), np.uint8)
    left[block.by_shard] = codes[1]
    sent = np.empty(len(block.third), np.uint8)
    sent[spans(block.follow_at[block.by_shard], block.followers[block.by_shard])] = codes[2]
    share = np.empty(len(block.order3), np.uint8)
    share[block.order3] = np.repeat(sent, np.diff(np.append(block.edges3, len(block.order3))))
    leaves = left[block.context]
    some = np.flatnonzero(leaves != ngram_trie.ABSENT)
    at = block.ends_trigram[some]
    own = np.where(share[some] == ngram_trie.ABSENT, 0.0, 10.0 ** ngram_trie.dequantise(share[some]))
    per_token[at] = np.log10(own + 10.0 ** (ngram_trie.dequantise(leaves[some]) + per_token[at]))


def score(docs: DataFrame, block_chars: int = BLOCK_CHARS, order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null texts are empty: their only token is the end. Ids may be null (counted as the
    empty text for ``held_out``) or repeat; other columns are ignored. With no training
    rows no word is known and every score is zero. No rows: no rows. ``order``: 2 or 3
    words.
    """
    if order not in (2, 3):
        raise ValueError(f"order is 2 or 3, not {order}")
    spark = docs.sparkSession
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, types = TaskContext.get().partitionId(), 0, []

        def rows() -> Iterator[tuple[tuple, str]]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                for doc, held, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield (doc, held), text

        for block in blocks.in_blocks(rows(), split, block_chars):
            codes, words, sizes = block.close(shards)
            doc, held, n = zip(*block.rows)
            table = pa.table({"doc_id": pa.array(doc, types[0]), "held_out": pa.array(held, pa.bool_()), "n": pa.array(n, pa.int64())})
            train = np.bincount(codes[np.repeat(~np.array(held), n)], minlength=len(words))
            stops = np.cumsum(sizes)
            asked = np.flatnonzero(sizes)
            bodies = []
            for s in asked:
                here = slice(stops[s] - sizes[s], stops[s])
                bodies.append(blocks.to_bytes(pa.table({"word": words[here], "n": pa.array(train[here], pa.int64())})))
            name = (part << 32) + number
            number += 1
            yield _parts([*asked, -1], [name] * (len(asked) + 1), [None] * len(asked) + [blocks.to_bytes(table)], [*bodies, blocks.pack(codes)])

    def count(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        group = group.sort_by("block")
        parts = [blocks.from_bytes(b.as_py()).combine_chunks() for b in group.column("body")]
        words = pa.chunked_array([c for p in parts for c in p.column("word").chunks], pa.large_binary())
        coded = pa.concat_arrays(words.chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sent = np.concatenate([p.column("n").to_numpy() for p in parts])
        total = np.zeros(int(coded.max()) + 1, np.int64)
        np.add.at(total, coded, sent)
        stops = np.cumsum([p.num_rows for p in parts])
        bodies = [bundle(coded[e - p.num_rows : e].astype(np.uint32), total[coded[e - p.num_rows : e]].astype(np.uint64)) for e, p in zip(stops, parts)]
        n = group.num_rows
        return pa.table(
            {
                "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()),
                "shard": pa.array([shard] * (n + 1), pa.int32()),
                "body": pa.array([*bodies, None], pa.binary()),
                "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
                "known": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            }
        )

    source = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    parts = kept(source.mapInArrow(tokenise, PART), "word-blocks")
    replies = kept(parts.filter("shard >= 0").groupBy("shard").applyInArrow(count, REPLY), "word-counts")
    sums = replies.filter("block is null").agg(F.sum("tokens"), F.sum("known")).first()
    tokens, known = int(sums[0] or 0), int(sums[1] or 0)
    scale = tokens + 0.1 * (known + 1)

    def ask(group: pa.Table) -> pa.Table:
        block, bodies = _block(group)
        asked = list(_grams(BlockWords(*bodies, shards, tokens, order)))
        return pa.Table.from_batches([_parts([s for s, _ in asked], [block] * len(asked), [None] * len(asked), [b for _, b in asked])])

    def look_up(group: pa.Table) -> pa.Table:
        found = answer(group.column("body").to_pylist(), scale)
        return group.drop_columns("body").append_column("body", pa.array(found, pa.binary()))

    def put_together(group: pa.Table, answered: pa.Table) -> pa.Table:
        found = [unbundle(c) for c in answered.sort_by("shard").column("body").to_pylist()]
        block = BlockWords(*_block(group)[1], shards, tokens, order)
        per_doc = _scored(block, [np.concatenate(level) for level in zip(*found)], scale)
        columns = [block.docs.column("doc_id"), block.docs.column("held_out"), block.docs.column("n"), *map(pa.array, per_doc)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])

    whole = parts.filter("shard < 0").unionByName(
        replies.filter("block is not null").select(F.lit(-1).alias("key"), "block", "shard", F.lit(None).cast("binary").alias("docs"), "body")
    )
    by_block = whole.groupBy("block")
    answers = by_block.applyInArrow(ask, PART).groupBy("shard").applyInArrow(look_up, PART)
    rows = by_block.cogroup(answers.groupBy("block")).applyInArrow(put_together, f"doc_id {kind}, {RESULT}")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(scale)))).alias("base_score"),
        "score",
    )


def _parts(shard: list, block: list, docs: list, body: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(([-1] * len(shard), block, shard, docs, body), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "block", "shard", "docs", "body"])


def _block(group: pa.Table) -> tuple[int, tuple[dict[int, bytes], bytes]]:
    """A block's name, its bodies by shard (-1: its codes) and its documents."""
    bodies = dict(zip(group.column("shard").to_pylist(), group.column("body").to_pylist()))
    docs = next(d for d in group.column("docs").to_pylist() if d is not None)
    return group.column("block")[0].as_py(), (bodies, docs)

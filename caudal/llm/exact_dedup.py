"""Exact duplicates: counting quotient filters, then byte verification.

1. Every partition counts the 64-bit fingerprints of its normalised texts in a
   counting quotient filter: the high bits (quotient) address a run, the run holds
   the sorted remainders with their counts. The filter is sent in blocks of quotients.
2. Filters of one block merge losslessly run by run: equal remainders add up.
   A group of copies arrives as one counter per partition, however large it is.
3. Fingerprints with a count above one are a written table. Texts with such a
   fingerprint are grouped by their whole bytes: this tells copies from collisions,
   and copies collapse before the shuffle.
4. All documents, as ids and digests only, are joined with the verified classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import SPACE, kept, whole_text

FILTER = "block int, runs binary, remainders binary, counts binary"
_RUN_BITS = 8
_FLUSH_ROWS = 1_000_000  # rows a task counts before it sends a filter
_BLOCK_ROWS = 8_000_000  # rows of the corpus for each block of quotients, which one task merges


def build_filter(fingerprints: np.ndarray, block_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The blocks of one filter: ``runs`` has the length of each quotient's run."""
    values, counts = np.unique(fingerprints, return_counts=True)
    rest = np.uint64(64 - block_bits - _RUN_BITS)
    quotients = values >> rest
    remainders = values & ((np.uint64(1) << rest) - np.uint64(1))
    blocks = (quotients >> np.uint64(_RUN_BITS)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    for start, end in zip(edges, [*edges[1:], len(blocks)]):
        run = (quotients[start:end] & np.uint64((1 << _RUN_BITS) - 1)).astype(np.int64)
        yield (
            int(blocks[start]),
            np.bincount(run, minlength=1 << _RUN_BITS).astype("<u4").tobytes(),
            remainders[start:end].astype("<u8").tobytes(),
            counts[start:end].astype("<u4").tobytes(),
        )


def merge_filters(block: int, block_bits: int, parts: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of the merged block, in order of quotient and remainder."""
    rest = np.uint64(64 - block_bits - _RUN_BITS)
    runs = np.arange(1 << _RUN_BITS, dtype=np.uint64)
    values, counts = [], []
    for lengths, remainders, count in parts:
        quotient = np.repeat(runs, np.frombuffer(lengths, "<u4")) | np.uint64(block << _RUN_BITS)
        values.append((quotient << rest) | np.frombuffer(remainders, "<u8"))
        counts.append(np.frombuffer(count, "<u4").astype(np.int64))
    value, count = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(value, kind="stable")  # sorted parts: a merge
    value, count = value[order], count[order]
    edges = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return value[edges], np.add.reduceat(count, edges)


def repeated_fingerprints(rows: DataFrame, column: str, block_bits: int) -> DataFrame:
    """``fp, n``: the values of a bigint column that occur more than once in all of ``rows``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[np.ndarray]) -> pa.RecordBatch:
            parts = list(zip(*build_filter(np.concatenate(held).view(np.uint64), block_bits)))
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            names = ["block", "runs", "remainders", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types)], names)

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, held)) >= _FLUSH_ROWS:
                yield send(held)
                held = []
        if sum(map(len, held)):
            yield send(held)

    def merge(parts: pa.Table) -> pa.Table:
        block = parts.column("block")[0].as_py()
        filters = list(zip(*(parts.column(c).to_pylist() for c in ("runs", "remainders", "counts"))))
        value, count = merge_filters(block, block_bits, filters)
        again = count > 1
        return pa.table({"fp": value[again].view(np.int64), "n": count[again]})

    filters = rows.select(column).mapInArrow(build, FILTER)
    return filters.groupBy("block").applyInArrow(merge, "fp bigint, n bigint")


def duplicates(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared after each run of white space became one space; null is empty.
    The smallest ``doc_id`` of a group stays; a group whose ids are all null keeps one
    of its rows with a null ``keep_id``. Rows that repeat both id and text stay once.
    Other columns are ignored. No rows: no rows.

    ``fingerprint_bits`` below 64 makes collisions likely; results don't change.
    """
    text = F.regexp_replace(whole_text(), SPACE, " ")
    mark: Column = F.xxhash64(text)
    if fingerprint_bits < 64:
        mark = F.shiftleft(mark, 64 - fingerprint_bits)
    bits = max(4, (max(1, docs.count()) // _BLOCK_ROWS).bit_length())
    again = kept(repeated_fingerprints(docs.select(mark.alias("fp")), "fp", bits), "repeated-texts")

    texts = docs.select("doc_id", text.alias("text"), mark.alias("fp"))
    classes = (
        texts.join(again.select("fp"), "fp")
        .groupBy("fp", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("fp", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = docs.select("doc_id", mark.alias("fp"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    copies = rows.groupBy("doc_id", "fp", "text_sha256").agg(F.count("*").alias("copies"))
    joined = copies.join(classes, ["fp", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return (
        joined.withColumn("keep_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )

"""SimHash near-duplicates: one-wildcard segment variants, equality join, verification.

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two segments,
two differing bits leave one segment that differs in one bit at most. Each distinct
fingerprint is indexed under both segments as they are (``exact``) and under every
segment with one bit replaced by a wildcard. Pairs that agree in a segment meet under
its exact key; pairs that differ in its bit j meet under the variant without j, where
the members with the bit unset are joined with those that have it set. Candidates are
verified on all 64 bits.

Members of a key with many fingerprints are not paired. For them an exact way without
pairs follows: two fingerprints differ in at most two bits if and only if some 64-bit
value differs from each in at most one. So each sends itself to its 65 neighbouring
values, at most 65 fingerprints can meet at a value, and all that meet are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm.components import connected
from caudal.llm.tables import kept, whole_text
from caudal.operators.joins import salted_lookup

DISTANCE = 2
_SEED = 42
_CHUNK = 255 * 256  # shingles whose bits are added at once: bounds the memory for very long texts
_CROWD = 64  # fingerprints under one key from which they go by their neighbouring values


def fingerprint(text: str, words: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64; no words: zero.

    A-Z are lower-cased, words are split at ASCII white space, shingles are ``words``
    long and counted with repeats; a shorter text is one shingle.
    """
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        size = min(_CHUNK, n - at)
        hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in spans), np.dtype("<u8"), size)
        bits = np.zeros((-(-size // 255) * 255, 64), np.uint8)
        bits[:size] = np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        total += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed bigint) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter(
                (fingerprint(text.as_py(), words) for text in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def _bit(j: int) -> int:
    """The 64-bit value with bit ``j``, as a signed number."""
    return (1 << j) - (1 << 64 if j == 63 else 0)


def _index(marks: DataFrame) -> DataFrame:
    """``key, side, fp``: side 0 or 1 of a variant's wildcard bit, null for whole segments."""
    entries: list[Column] = []
    for segment in range(2):
        half = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(0xFFFFFFFF)
        entries.append(F.struct(F.lit(64 + segment).cast("long").alias("slot"), half.alias("value"), F.lit(None).cast("boolean").alias("side")))
        for j in range(32):
            entries.append(
                F.struct(
                    F.lit(32 * segment + j).cast("long").alias("slot"),
                    half.bitwiseAND(0xFFFFFFFF ^ (1 << j)).alias("value"),
                    (half.bitwiseAND(1 << j) != 0).alias("side"),
                )
            )
    entry = marks.select("fp", F.explode(F.array(*entries)).alias("e"))
    return entry.select(
        F.shiftleft("e.slot", 32).bitwiseOR(F.col("e.value")).alias("key"), F.col("e.side").alias("side"), "fp"
    )


def links(marks: DataFrame, crowd: int = _CROWD) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``), complete up to connection.

    Keys with up to ``crowd`` members give every pair within two bits; members of
    larger keys are linked to the smallest fingerprint met at each neighbouring value.
    """
    # Every row becomes 66: spread them over all tasks, whatever their bytes.
    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = _index(marks.repartition(tasks, F.xxhash64("fp")))
    keys = kept(
        index.groupBy("key")
        .agg(F.count("*").alias("n"), F.count_if("side").alias("set"), F.count("side").alias("sided"))
        .filter((F.col("n") > 1) & ((F.col("sided") == 0) | ((F.col("set") > 0) & (F.col("set") < F.col("n")))))
        .select("key", "n"),
        "shared-keys",
    )
    members = kept(index.join(keys, "key"), "key-members")
    few = members.filter(F.col("n") <= crowd)
    a = few.select("key", F.col("side").alias("side_a"), F.col("fp").alias("a"))
    b = few.select("key", F.col("side").alias("side_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    whole = a.filter("side_a is null").join(b.filter("side_b is null"), "key").filter(F.col("a") < F.col("b"))
    variant = a.filter("not side_a").join(b.filter("side_b"), "key")
    pairs = whole.select("a", "b").unionByName(variant.select("a", "b")).filter(near).distinct()

    many = members.filter(F.col("n") > crowd).select("fp").distinct()
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(j))) for j in range(64)])
    met = (
        many.select("fp", F.explode(values).alias("value"))
        .groupBy("value")
        .agg(F.collect_set("fp").alias("met"))  # 65 at most
        .filter(F.size("met") > 1)
    )
    stars = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).filter("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, crowd: int = _CROWD) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id that
    links reach. Null texts are empty and have fingerprint zero, linked like any other.
    Rows that repeat an id each keep their row; null ids never become a component's id
    unless it has no other. Other columns are ignored.
    """
    marked = kept(fingerprints(docs, words), "fingerprints")
    marks = marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    roots = connected(links(marks.select("fp"), crowd))
    rooted = kept(
        marks.join(roots, marks["fp"] == roots["node"], "left").select(
            "fp", "smallest", F.coalesce("root", "fp").alias("root")
        ),
        "rooted-fingerprints",
    )
    # One component may hold a third of all fingerprints: its rows are spread over salts.
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("n"))
    classes = salted_lookup(rooted, smallest, ["root"], "n", ["fp"]).select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )

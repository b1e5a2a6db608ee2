"""Document quality from line labels of a conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm import crf
from caudal.llm.line_features import WIDTH, features
from caudal.llm.tables import whole_text

TRAIN_DOCS = 4000  # labelled documents the chain is fitted on, at most
TRAIN_LINES = 100_000  # their lines, at most: each is some hundred doubles on the driver
KEEP = 0.7  # the score from which a document counts as good
_ROWS = 500  # texts looked at together


def held_out(column: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> DataFrame:
    """``text, good`` of the rows the chain is fitted on: ``most`` rows and ``lines`` lines at most.

    Ids are chosen from the narrow labels by a hash of the id, their bounded list is
    broadcast. Rows that repeat an id and text count as often as they come. In hash
    order rows are taken whole while their running sums fit; a text with more lines
    than fit in all is not learned from.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out())
        .select("doc_id", F.col("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "good")
        .limit(most)
    )

    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    size = (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("size")
    key = ["doc_id", "digest", "good"]
    counted = rows.select(*key, size).filter(F.col("size") <= lines).groupBy(*key, "size").agg(F.count("*").alias("n"))
    order = (F.xxhash64("doc_id"), "doc_id", "good", "digest")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.orderBy(*order).limit(most)  # every entry is a row at least: a narrow, bounded window
    for name, what in (("rows_before", F.col("n")), ("lines_before", F.col("n") * F.col("size"))):
        sums = sums.withColumn(name, F.coalesce(F.sum(what).over(before), F.lit(0)))
    fit = F.least(F.lit(most) - F.col("rows_before"), F.expr(f"({lines} - lines_before) div size"), "n")
    taken = sums.select(*key, fit.alias("take")).filter("take > 0")
    return (
        rows.join(F.broadcast(taken), key)
        .dropDuplicates(key)
        .select("text", "good", F.explode(F.sequence(F.lit(1), F.col("take").cast("int"))))
        .select("text", "good")
    )


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> crf.Chain:
    """Fit the chain on a bounded ``sample``; only its line features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, counts = features(batch.column(0))
            ends = np.cumsum(counts)
            packed = [np.packbits(rows[e - c : e], axis=1).tobytes() for c, e in zip(counts, ends)]
            sizes = [size[e - c : e].astype("<i8").tobytes() for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], ["good", "rows", "sizes"])

    found = sample(docs, labels, most, lines).mapInArrow(run, "good int, rows binary, sizes binary").toArrow().sort_by([("good", "ascending"), ("sizes", "ascending"), ("rows", "ascending")])
    packed = [np.frombuffer(x, np.uint8).reshape(-1, -(-WIDTH // 8)) for x in found.column("rows").to_pylist()]
    rows = np.concatenate([np.zeros((0, WIDTH), np.uint8), *(np.unpackbits(x, axis=1, count=WIDTH) for x in packed)])
    size = np.frombuffer(b"".join(found.column("sizes").to_pylist()), "<i8")
    counts = np.array([len(x) for x in packed], np.int64)
    return crf.fit(rows, size, counts, found.column("good").to_numpy().astype(np.float64))


def score(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """One row per document: ``doc_id, score``, from the whole text alone.

    Null and empty texts are one empty line. Ids may be null or repeat; other columns
    are ignored. ``doc_id`` may be of any type, a whole row as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows, size, counts = features(part.column(1))
                found = crf.scores(chain, rows, size, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)

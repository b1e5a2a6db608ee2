"""Approximate nearest neighbours by inner product: one small-world graph per shard.

Vectors that are equal are one class, searched once. Classes are dealt to shards of a
fixed mean size by a hash; a shard's graph is a row of flat arrays. The stated queries
travel in blocks, one row per block and shard, meet the shard's row by an equality join,
and are searched together. The closest of all shards are merged by window functions,
which cut to the ranks needed before they shuffle. Scores are inner products of the
original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm import hnsw
from caudal.llm.tables import kept

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
WIDTH = 160  # nodes a search holds: recall against brute force is tested
_SALTS = 64

INDEX = "dims int, shard int, ids binary, vectors binary, row_order binary, layers array<binary>"


def usable(column: str) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    value = F.col(column)
    return value.isNotNull() & ~F.exists(value, bad) & F.exists(value, lambda x: x != 0)


def classes(vectors: DataFrame, most: int) -> DataFrame:
    """``class, embedding, members``: equal vectors, with their ``most`` smallest ids in order.

    Ids of a class are cut to the smallest in ``_SALTS`` parts first, so a vector that a
    third of the rows share is no hot group.
    """
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))).orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= most)
    members = F.slice(F.array_sort(F.collect_list("vec_id")), 1, most)
    return few.groupBy("embedding").agg(members.alias("members")).select(
        F.col("members")[0].alias("class"), "embedding", "members"
    )


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """A graph for each shard and vector length, from ``class, embedding``."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("class")
        x = _matrix(group.column("embedding"))
        graph = hnsw.build(x)
        return pa.table(
            {
                "dims": group.column("dims").slice(0, 1),
                "shard": group.column("shard").slice(0, 1),
                "ids": pa.array([group.column("class").to_numpy().astype("<i8").tobytes()]),
                "vectors": pa.array([x.astype("<f8").tobytes()]),
                "row_order": pa.array([graph.order.astype("<i4").tobytes()]),
                "layers": pa.array([[layer.astype("<i4").tobytes() for layer in graph.layers]], pa.list_(pa.binary())),
            }
        )

    shard = F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard")
    rows = vectors.select(F.size("embedding").alias("dims"), shard, "class", "embedding")
    return rows.groupBy("dims", "shard").applyInArrow(build, INDEX)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search_index(index: DataFrame, queries: DataFrame, shards: int, most: int, width: int) -> DataFrame:
    """``query, class, score``: up to ``most`` classes from every shard for each ``class, embedding`` of the queries."""

    def pack(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in pa.compute.unique(table.column("dims")).to_pylist():
                part = table.filter(pa.compute.equal(table.column("dims"), dims))
                for at in range(0, part.num_rows, BLOCK_QUERIES):
                    block = part.slice(at, BLOCK_QUERIES)
                    ids = block.column("class").to_numpy().astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dims], pa.int32()),
                            pa.array([int(ids[0])], pa.int64()),
                            pa.array([ids.tobytes()]),
                            pa.array([_matrix(block.column("embedding")).astype("<f8").tobytes()]),
                        ],
                        ["dims", "block", "queries", "query_vectors"],
                    )

    def search(pair: pa.Table) -> pa.Table:
        row = pair.to_pylist()[0]  # one shard and one block
        dims = row["dims"]
        ids, query_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["queries"], "<i8")
        x = np.frombuffer(row["vectors"], "<f8").reshape(-1, dims)
        q = np.frombuffer(row["query_vectors"], "<f8").reshape(-1, dims)
        order = np.frombuffer(row["row_order"], "<i4").astype(np.int64)
        layers = []
        for level, data in enumerate(row["layers"]):
            layers.append(np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, hnsw.M if level else 2 * hnsw.M))
        graph = hnsw.Graph(hnsw.lifted(x)[order], order, layers)
        out = []
        for at in range(0, len(q), 256):
            found = hnsw.search(graph, q[at : at + 256], width)
            line, col = np.nonzero(found >= 0)
            found = found[line, col]
            score = np.einsum("ij,ij->i", q[at + line], x[found])
            rank = np.lexsort((ids[found], -score, line))
            line, found, score = line[rank], found[rank], score[rank]
            begin = np.searchsorted(line, np.arange(len(q)))
            top = np.arange(len(line)) - begin[line] < most
            out.append((query_ids[at + line[top]], ids[found[top]], score[top]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table(dict(zip(("query", "class", "score"), map(pa.array, columns))))

    blocks = queries.select(F.size("embedding").alias("dims"), "class", "embedding").mapInArrow(
        pack, "dims int, block bigint, queries binary, query_vectors binary"
    )
    everywhere = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = everywhere.join(index, ["dims", "shard"])
    return pairs.groupBy("dims", "shard", "block").applyInArrow(search, "query bigint, class bigint, score double")


def nearest(
    table: DataFrame, queries: Column, k: int = 20, width: int = WIDTH, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``queries`` selects, nearest first.

    ``query_id, rank, vec_id, score``; ties go to the smaller ``vec_id``, a query is not
    its own neighbour, fewer candidates give fewer rows. Vectors that are null, all
    zero, or hold a null or non-finite component take no part, nor do rows with a null
    id; vectors of another length than the query's are no candidates. A row that
    repeats id and vector counts once; an id with several vectors is a candidate by each
    and is asked by each, never for itself. Other columns are ignored.
    """
    rows = (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter(usable("embedding") & F.col("vec_id").isNotNull())
        .distinct()
    )
    found = kept(classes(rows, k + 1), "vector-classes")
    shards = max(1, -(-found.count() // shard_rows))
    index = kept(build_index(found.select("class", "embedding"), shards), "vector-graphs")
    asked = rows.filter(queries).join(found.select("class", "embedding"), "embedding").select("vec_id", "class")
    asked = kept(asked, "vector-queries")
    distinct = found.select("class", "embedding").join(asked.select("class").distinct(), "class")
    hits = search_index(index, distinct, shards, k + 1, width)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    hits = hits.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1)
    # ``k + 1`` classes hold the nearest ``k`` rows besides the query's own, each class cut to ``k + 1``.
    people = hits.join(found.select("class", "members"), "class").select("query", "score", F.explode("members").alias("vec_id"))
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    people = people.withColumn("n", F.row_number().over(by_row)).filter(F.col("n") <= k + 1)
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    answers = people.join(own, "query").filter("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

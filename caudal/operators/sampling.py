"""Seeded sampling, defect injection, fan-out and random parents.

Every draw is a hash of the row's key, so a result does not depend on the
partitioning and can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.hashing import hash_uniform

# Buckets of the hash (256 blocks of 256): the counts have this many rows at most.
_BUCKETS = 65_536


def _numbered(
    df: DataFrame, key: str, salt: str, share: float | None = None, n: int | None = None
) -> DataFrame:
    """Rows with their position ``_i`` (0..) in the order of (hash of key, key).

    Rows are numbered inside buckets of the hash, evenly filled as the key is
    unique, and shifted by the number of rows in the buckets before. Those counts
    have 65,536 rows at most, are summed in 256 blocks of 256 and broadcast.
    With ``share`` or ``n`` only the first rows are wanted and buckets behind the
    limit are never sorted.
    """
    # The filter that the joins on ``_b`` would add to one of the two uses of the counts:
    # with it both are the same plan, and Spark counts once.
    bucketed = (
        df.withColumn("_u", hash_uniform(key, salt))
        .withColumn("_b", F.floor(F.col("_u") * _BUCKETS).cast("int"))
        .filter(F.col("_b").isNotNull())
    )
    counts = (
        bucketed.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", F.shiftright("_b", 8))
        .filter(F.col("_block").isNotNull())
    )
    listed = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).agg(
        F.collect_list(F.struct("_block", "_n")).alias("_all"), F.sum("_n").alias("_total")
    )
    earlier = F.filter("_all", lambda x: x["_block"] < F.col("_block"))
    blocks = listed.select("_all", "_total", F.explode("_all._block").alias("_block")).select(
        "_block",
        "_total",
        F.aggregate(earlier, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["_n"]).alias("_skipped"),
    )
    inside = F.sum("_n").over(Window.partitionBy("_block").orderBy("_b")) - F.col("_n")
    offsets = (
        counts.withColumn("_inside", inside)
        .join(F.broadcast(blocks), "_block")
        .select("_b", (F.col("_skipped") + F.col("_inside")).alias("_before"), "_total")
    )
    if share is not None:
        wanted = F.floor(F.col("_total") * F.lit(share))
    else:
        wanted = F.col("_total") if n is None else F.lit(n)
    offsets = offsets.withColumn("_wanted", wanted).filter(F.col("_before") < F.col("_wanted"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_u", key))
    return (
        bucketed.join(F.broadcast(offsets), "_b")
        .withColumn("_i", F.col("_before") + rank - 1)
        .filter(F.col("_i") < F.col("_wanted"))
    )


def dense_index(df: DataFrame, key: str, salt: str, name: str) -> DataFrame:
    """Number the rows 0..n-1 in the order of (hash of key, key); key is unique."""
    return _numbered(df, key, salt).select(*df.columns, F.col("_i").alias(name))


def sample_n(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """Exactly n rows without replacement: those with the smallest hash of the unique key.

    ``ORDER BY hash LIMIT n`` would pass n rows through one task.
    """
    return _numbered(df, key, salt, n=n).select(*df.columns)


def sample_exact_share(df: DataFrame, key: str, salt: str, share: float) -> DataFrame:
    """Exactly floor(share * rows) rows without replacement."""
    return _numbered(df, key, salt, share=share).select(*df.columns)


def sample_share(df: DataFrame, key: str, salt: str, share: float) -> DataFrame:
    """About ``share`` of the rows: a filter, no shuffle."""
    return df.filter(hash_uniform(key, salt) < F.lit(share))


def inject_nulls(df: DataFrame, column: str, key: str, salt: str, share: float) -> DataFrame:
    """Blank out a share of one column."""
    return df.withColumn(
        column, F.when(hash_uniform(key, salt) < F.lit(share), F.lit(None)).otherwise(F.col(column))
    )


def inject_copies(df: DataFrame, key: str, salt: str, share: float) -> DataFrame:
    """Append exact copies of a share of the rows."""
    return df.unionByName(sample_share(df, key, salt, share))


def inject_nulls_exact(df: DataFrame, column: str, key: str, salt: str, share: float) -> DataFrame:
    """Blank out one column in exactly floor(share * rows) rows; key is unique."""
    chosen = sample_exact_share(df.select(key), key, salt, share).withColumn("_blank", F.lit(True))
    return (
        df.join(chosen, key, "left")
        .withColumn(column, F.when(F.col("_blank").isNull(), F.col(column)))
        .select(*df.columns)
    )


def inject_copies_exact(df: DataFrame, key: str, salt: str, share: float) -> DataFrame:
    """Append exact copies of exactly floor(share * rows) rows; key is unique."""
    return df.unionByName(sample_exact_share(df, key, salt, share))


def fan_out(df: DataFrame, key: str, salt: str, most: int, name: str) -> DataFrame:
    """1..most children per row, numbered inside their parent in ``name``."""
    children = F.lit(1) + F.floor(hash_uniform(key, salt) * F.lit(most)).cast("bigint")
    return df.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), children)))


def assign_parent(
    children: DataFrame, child_key: str, parents: DataFrame, parent_key: str, salt: str
) -> DataFrame:
    """Give every child a parent drawn uniformly; joined on a dense parent index.

    The drawn index is uniform, so the join has no hot key.
    """
    indexed = dense_index(parents.select(parent_key), parent_key, salt, "_i")
    n_parents = parents.agg(F.count(F.lit(1))).scalar()
    drawn = F.floor(hash_uniform(child_key, f"{salt}:draw") * n_parents).cast("bigint")
    return children.withColumn("_i", drawn).join(indexed, "_i").drop("_i")


def home_or_foreign(
    key: Column | str, salt: str, home: Column, candidates: Column, home_share: float
) -> Column:
    """The home value with probability ``home_share``, else one of the other candidates."""
    others = F.array_remove(candidates, home)
    index = F.floor(hash_uniform(key, f"{salt}:pick") * F.size(others)).cast("int")
    return F.when(hash_uniform(key, salt) < F.lit(home_share), home).otherwise(F.get(others, index))

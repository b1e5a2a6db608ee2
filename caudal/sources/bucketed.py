"""Facts and lookup rows stored by the same buckets, so that they join without a shuffle.

What is joined night after night on one key is shuffled once, when it is written. Both
tables are bucketed by the key and a salt, a file a bucket, sorted. A key with more than
a share of all facts is spread over salts when it is written, its lookup row repeated for
each, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.joins import HOT_SHARE

SALT = "_sal"


def write_together(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Sequence[str],
    tables: tuple[str, str],
    paths: tuple[str, str],
    buckets: int,
    share: float = HOT_SHARE,
) -> None:
    """Write ``facts`` and ``lookup`` (one row per ``key``) as the bucketed ``tables`` at ``paths``.

    ``spread`` names the fact's id, whose hash picks the salt of a hot key's rows, so a
    task that runs again writes the same. Facts without a key are kept under salts of their
    own hash: they join nothing, and there may be many. Hot keys are 1/share at most.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = counts.agg(F.sum("_n") * F.lit(share)).scalar()
    hot = counts.filter((F.col("_n") > limit) & F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)  # 1/share rows at most
    salt = F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")
    many = F.coalesce("_hot", F.col(key).isNull())
    salted = facts.join(hot, key, "left").withColumn(SALT, F.when(many, salt).otherwise(F.lit(0))).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, key, "left").withColumn(SALT, F.explode(salts)).drop("_hot")
    for rows, table, path in zip((salted, repeated), tables, paths):
        (
            rows.repartition(buckets, key, SALT)
            .write.mode("overwrite")
            .option("path", path)
            .bucketBy(buckets, key, SALT)
            .sortBy(key, SALT)
            .saveAsTable(table)
        )


def join_together(spark: SparkSession, tables: tuple[str, str], key: str, how: str = "inner") -> DataFrame:
    """The join of two tables of ``write_together``: each bucket with its own, nothing is shuffled."""
    if how not in ("inner", "left"):
        raise ValueError(f"join_together joins inner or left, not {how}")
    facts, lookup = (spark.table(t) for t in tables)
    return facts.join(lookup.hint("merge"), [key, SALT], how).drop(SALT)

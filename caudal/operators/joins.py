"""Joins that stay balanced when one key holds a large share of the rows.

Which join to use where:

* both sides are scans or shuffles of their own: the plain ``join``; adaptive
  execution splits a hot partition of a sort-merge join by itself;
* the result is aggregated anyway: aggregate first, then join the small result;
* the lookup side is itself an aggregate on the join key: adaptive execution
  cannot split there (that side has no shuffle between the aggregate and the
  join), so the hot keys are salted here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.005


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: Sequence[str],
    how: str = "inner",
    share: float = HOT_SHARE,
    splits: int | None = None,
) -> DataFrame:
    """Join many rows to one lookup row per ``keys``, splitting the hot keys.

    ``weight`` is the lookup's exact count of fact rows for each key: a key with more
    than ``share`` of their sum is hot, so there are 1/share hot keys at most and both
    sides agree on them. Rows of a hot key are spread over ``splits`` salts by a hash
    of ``spread`` (the row's id: the same on every attempt), its lookup row is
    repeated once per salt. All other keys keep salt 0 and are shuffled as in a plain
    join. Fact rows whose key the lookup lacks are not hot.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_lookup joins inner or left, not {how}")
    if splits is None:
        splits = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = lookup.agg(F.sum(weight) * F.lit(share)).scalar()
    is_hot = F.col(weight) > limit
    # 1/share rows at most, so the broadcast has a fixed bound.
    hot = F.broadcast(lookup.filter(is_hot).select(*keys, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*spread), F.lit(splits)).cast("int")
    left = facts.join(hot, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(salts)).drop(weight)
    return left.drop("_hot").join(right, [*keys, "_salt"], how).drop("_salt")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Foreign keys without a parent, one row per key with ``n_rows`` children.

    Children are counted per key before the shuffle, so a hot key is one row per
    map task by the time it is joined.
    """
    parents = parent.select(F.col(parent_key or key).alias(key))
    return (
        child.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .join(parents, key, "left_anti")
    )


def without_children(parent: DataFrame, key: str, child: DataFrame, child_key: str | None = None) -> DataFrame:
    """Parents that no child refers to; the child keys are made distinct before the join."""
    keys = child.select(F.col(child_key or key).alias(key)).distinct()
    return parent.join(keys, key, "left_anti")


def with_children(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose key is among the rows of ``parent`` (a semi join)."""
    return child.join(parent.select(key), key, "left_semi")

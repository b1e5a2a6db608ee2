"""Sets of whole-number keys as bitmaps, compared bucket by bucket.

A bucket holds 32,768 neighbouring keys in 4 KB, built map-side. Counting distinct keys,
repeated ones and keys missing from another table then shuffles a bucket for each map
task that has keys of it, not a row per key, and a hot key is one bit. Made for keys
that are dense (numbered, as ids of accounts and transactions are): where few keys of a
bucket occur, the row-wise forms of ``quality`` send less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.session import written

_BITS = 32_768
_BYTES = _BITS // 8


def dense_key(rows: DataFrame, keys: Sequence[str], name: str = "_clave") -> DataFrame:
    """``rows`` with two or more non-negative whole-number columns folded into one number, without collisions.

    Each further column takes a range as wide as its largest value. A number beyond 64
    bits is an error (ANSI mode); a null column makes the key null.
    """
    key = F.col(keys[0]).cast("bigint")
    for column in keys[1:]:
        width = rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint") + 1).scalar()
        key = key * width + F.col(column)
    return rows.withColumn(name, key)


def key_sets(rows: DataFrame, key: str) -> DataFrame:
    """``bucket, n_rows, keys``: the bitmap of each bucket's keys; null keys have bucket null and no bits."""
    number = F.col(key).cast("bigint")
    return rows.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("keys")
    )


def count_repeated(rows: DataFrame, key: str, check: str) -> DataFrame:
    """``quality.count_repeated`` of one whole-number column: rows beyond the first of their key."""
    null_key = F.when(F.col("bucket").isNull(), 1).otherwise(0)
    return key_sets(rows, key).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n_rows") - F.bitmap_count("keys") - null_key), F.lit(0)).alias("n_failed"),
    ).select(F.lit(check).alias("check"), "n_rows", "n_failed")


def differing_sets(child: DataFrame, parent: DataFrame) -> DataFrame:
    """``bucket, todos, padres`` of the buckets in which child keys lack a parent: the bits of both, and of the parent.

    Bits of both less bits of the parent say how many a bucket lacks.
    """
    tagged = child.select("bucket", "keys", F.lit(True).alias("hijo")).unionByName(
        parent.select("bucket", "keys", F.lit(False).alias("hijo"))
    )
    sides = tagged.filter("bucket is not null").groupBy("bucket").agg(
        F.bitmap_or_agg("keys").alias("todos"), F.max(F.when(~F.col("hijo"), F.col("keys"))).alias("padres")
    )
    return sides.filter(F.bitmap_count("todos") > F.coalesce(F.bitmap_count("padres"), F.lit(0)))


def _byte(side: str, i: Column) -> Column:
    """Byte ``i`` of a bitmap as a number; 0 where there is no bitmap."""
    return F.coalesce(F.conv(F.hex(F.substring(side, i + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def _lost_bits(i: Column) -> Column:
    return _byte("todos", i).bitwiseXOR(_byte("padres", i))


def orphan_keys(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Keys (``clave``) of the child's key sets that the parent's lack.

    Only buckets that lack some are looked into, byte by byte.
    """
    lost = F.transform(
        F.sequence(F.lit(0), F.lit(_BYTES - 1)), lambda i: F.struct(i.alias("i"), _lost_bits(i).alias("bits"))
    )
    found = differing_sets(child, parent).select("bucket", F.explode(F.filter(lost, lambda b: b["bits"] > 0)).alias("b"))
    bits = F.expr("filter(sequence(0, 7), k -> shiftright(b.bits, k) & 1 = 1)")
    place = F.col("b.i") * 8 + F.col("k")
    # The inverse of bitmap_bucket_number and bitmap_bit_position.
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * _BITS + place + 1).otherwise(
        F.col("bucket") * _BITS - place
    )
    return found.select("bucket", "b", F.explode(bits).alias("k")).select(number.alias("clave"))


def count_orphans(child: DataFrame, key: str, parent: DataFrame, check: str, parent_key: str | None = None) -> DataFrame:
    """``quality.count_orphans`` of whole-number keys: rows whose key the parent lacks, nulls left out.

    The bitmaps that lack keys are a written table, so its size is known before rows look
    themselves up in it: where Spark finds it small enough to broadcast, no row is
    shuffled; where not, rows meet it by bucket, and adaptive execution splits a hot one.
    """
    sets = key_sets(child, key)
    lost = written(differing_sets(sets, key_sets(parent, parent_key or key)), "claves-huerfanas")
    number = F.col(key).cast("bigint")
    rows = child.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    bits = F.expr("shiftright(_bits, cast(_bit % 8 as int)) & 1 = 1")
    hits = rows.join(lost, "bucket").select("_bit", _lost_bits((F.col("_bit") / 8).cast("int")).alias("_bits")).filter(bits)
    failed = hits.agg(F.count(F.lit(1))).scalar()
    return sets.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(
        F.lit(check).alias("check"), "n_rows", failed.alias("n_failed")
    )

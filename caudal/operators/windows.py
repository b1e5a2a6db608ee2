"""Time windows per key that never put a whole key into one task.

A client or account may hold a third of all rows. Both operators first collapse
rows of one key and instant, then cut each key into time buckets, so a window
group holds at most one bucket's worth of distinct instants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.values import floor_div, micros

_SECOND = 1_000_000

# Order of moves at one instant: points enter before others leave.
_OPENS, _ENTERS, _LEAVES, _LEAVES_CARRIED = 0, 1, 2, 3

# Buckets as wide as this many windows: few, but not tiny, window groups.
_WINDOWS_PER_BUCKET = 24
_DAY_SECONDS = 86_400


def _bucket_seconds(seconds: int) -> int:
    """A bucket is as wide as the window at least, and no wider than a day beyond that."""
    return max(seconds, min(seconds * _WINDOWS_PER_BUCKET, _DAY_SECONDS))


def _sweep(
    points: DataFrame,
    keys: Sequence[str],
    width: int,
    span: int,
    opening: DataFrame | None = None,
) -> DataFrame:
    """Trailing totals over [t - width, t] of ``points`` (keys, _t, totals).

    Time is cut into buckets of ``span``. Every point enters at its time and leaves
    ``width`` later, maybe in a later bucket; leaving counts after a point that
    enters at the same time, so both ends of the window count. What is in the
    window when a bucket starts are the points that leave in it without having
    entered in it, provided that a bucket is at least as wide as the window;
    for narrower ones ``opening`` (keys, _b, totals) says it.
    One linear pass: a sliding RANGE frame would add up the frame for every row.
    """
    totals = [c for c in ("_n", "_v") if c in points.columns]

    def bucket(time: Column) -> Column:
        return floor_div(time, span)

    leaves_at = F.col("_t") + F.lit(width)
    carried = bucket(leaves_at) > bucket(F.col("_t"))
    enters = F.struct(
        bucket(F.col("_t")).alias("_b"), F.col("_t").alias("_t"), F.lit(_ENTERS).alias("_kind"),
        *[F.col(c).alias(c) for c in totals],
    )
    leaves = F.struct(
        bucket(leaves_at).alias("_b"), leaves_at.alias("_t"),
        F.when(carried, F.lit(_LEAVES_CARRIED)).otherwise(F.lit(_LEAVES)).alias("_kind"),
        *[(-F.col(c)).alias(c) for c in totals],
    )
    moves = points.select(*keys, F.explode(F.array(enters, leaves)).alias("_m")).select(*keys, "_m.*")
    whole = Window.partitionBy(*keys, "_b")
    so_far = whole.orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if opening is not None:
        first = opening.select(
            *keys, "_b", F.lit(None).cast("bigint").alias("_t"), F.lit(_OPENS).alias("_kind"), *totals
        )
        moves = moves.unionByName(first)

    def in_window(column: str) -> Column:
        running = F.sum(column).over(so_far)
        if opening is not None:
            return running
        at_start = F.when(F.col("_kind") == _LEAVES_CARRIED, -F.col(column)).otherwise(0)
        return running + F.sum(at_start).over(whole)

    return (
        moves.withColumns({f"{c}_ventana": in_window(c) for c in totals})
        .filter(F.col("_kind") == _ENTERS)
        .drop("_kind", "_b")
    )


def _whole_units(tx: DataFrame, value: str) -> tuple[Column, int]:
    """A money column as a count of its smallest unit: 64-bit sums, exact and fast.

    A sum beyond 64 bits fails (ANSI mode), it never wraps.
    """
    kind = tx.schema[value].dataType
    if isinstance(kind, T.DecimalType):
        return (F.col(value) * F.lit(10**kind.scale)).cast("bigint"), kind.scale
    if isinstance(kind, T.IntegralType):
        return F.col(value).cast("bigint"), 0
    raise TypeError(f"{value} must be a decimal or an integer, not {kind.simpleString()}")


def trailing_totals(
    tx: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str | None = None,
    seconds: int = 3600,
) -> DataFrame:
    """Per key and instant: rows and sum of ``value`` over [ts - seconds, ts].

    Returns ``keys, ts, n_tx`` (rows at that instant), ``n_ventana`` and, where a
    value is named, ``suma_ventana``; both ends of the window count, to the
    microsecond.

    Two sweeps: whole seconds are summed in buckets of at most 24 windows and at most
    a day (or one window, if that is longer), so a group has at most
    ``2 * max(86,400, seconds)`` rows; instants only inside their second, so a group
    has at most two million rows (microseconds entering and leaving), however hot
    the key.
    """
    totals = {"_n": F.count(F.lit(1))}
    scale = 0
    if value is not None:
        units, scale = _whole_units(tx, value)
        totals["_v"] = F.coalesce(F.sum(units), F.lit(0))
    instants = (
        tx.dropna(subset=[*keys, ts])
        .groupBy(*keys, ts)
        .agg(*[total.alias(name) for name, total in totals.items()])
        .withColumn("_t", micros(ts))
        .withColumn("_s", floor_div(F.col("_t"), _SECOND))
    )
    per_second = instants.groupBy(*keys, "_s").agg(*[F.sum(c).alias(c) for c in totals])
    swept = _sweep(per_second.select(*keys, F.col("_s").alias("_t"), *totals), keys, seconds, _bucket_seconds(seconds))
    before = swept.select(
        *keys,
        F.col("_t").alias("_b"),
        *[(F.col(f"{c}_ventana") - F.col(c)).alias(c) for c in totals],
    )
    swept = _sweep(instants.select(*keys, "_t", *totals), keys, seconds * _SECOND, _SECOND, before)
    instant = F.timestamp_micros("_t")
    result = [
        *keys,
        instant.cast(tx.schema[ts].dataType).alias(ts),
        F.col("_n").alias("n_tx"),
        F.col("_n_ventana").alias("n_ventana"),
    ]
    if value is not None:
        total = F.col("_v_ventana")
        if scale:
            total = (total.cast("decimal(19,0)") / F.lit(10**scale)).cast(T.DecimalType(28, scale))
        result.append(total.alias("suma_ventana"))
    return swept.select(*result)


def with_previous(
    points: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str],
    carry: Sequence[str],
    within_seconds: int,
    windows_per_bucket: int = 7,
) -> DataFrame:
    """Add ``<column>_previo``: the same key's point before, if at most ``within_seconds`` old.

    ``order`` starts with ``ts`` and, with the key, is unique. Time is cut into
    buckets of ``windows_per_bucket`` windows; only points so late in a bucket that
    the next one may look back at them are copied into it. A group holds one
    bucket of one key, whatever the size of the key.
    """
    within = within_seconds * _SECOND
    span = within * windows_per_bucket
    time = micros(ts)
    bucket = floor_div(time, span)
    seen_until = floor_div(time + F.lit(within), span)
    here = F.struct(bucket.alias("_b"), F.lit(False).alias("_copy"))
    ahead = F.struct(seen_until.alias("_b"), F.lit(True).alias("_copy"))
    placed = points.withColumn(
        "_p", F.explode(F.when(seen_until > bucket, F.array(here, ahead)).otherwise(F.array(here)))
    ).select(*points.columns, "_p.*")
    in_bucket = Window.partitionBy(key, "_b").orderBy(*order)
    before = F.lag(F.struct(ts, *[c for c in carry if c != ts])).over(in_bucket)
    recent = time - micros(F.col("_before")[ts]) <= F.lit(within)
    return (
        placed.withColumn("_before", before)
        .filter(~F.col("_copy"))
        .select(
            *points.columns,
            *[F.when(recent, F.col("_before")[c]).alias(f"{c}_previo") for c in carry],
        )
    )

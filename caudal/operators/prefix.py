"""What came before: totals of earlier rows and state as of a row, for keys of any size.

A key may hold a third of all rows, so no window runs over a whole key. Rows collapse to
instants; time is cut into buckets; a coarse pass over buckets (bounded by the
calendar) gives each bucket what it opens with, as one more row in front of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.values import floor_div, micros
from caudal.operators.joins import HOT_SHARE

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND

# Slots of a hash of the key, counted to find hot keys; twenty times 1/HOT_SHARE.
_SLOTS = 4096

# Buckets of facts without key or instant start beyond those of any instant.
_UNDATED = 1 << 62


def _before(points: DataFrame, group: Sequence[str], order: str, totals: Sequence[str], opening: DataFrame | None) -> DataFrame:
    """``points`` with their totals replaced by those of earlier points of the group, the opening included."""
    if opening is not None:
        points = points.unionByName(opening.withColumn(order, F.lit(None).cast("bigint")), allowMissingColumns=True)
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(points.schema[c].dataType) for c in totals}
    return points.withColumns(sums).filter(F.col(order).isNotNull())


def earlier_totals(rows: DataFrame, keys: Sequence[str], ts: str, totals: Mapping[str, Column]) -> DataFrame:
    """Per key and instant: ``totals`` (sums or counts) of all rows of the key strictly before it.

    A segmented prefix scan in three levels: days of a key, seconds of a day, instants
    of a second. A group holds at most a key's days, 86,400 seconds, or a million
    microseconds. Rows without key or instant are left out.
    """
    names = list(totals)
    instants = (
        rows.dropna(subset=[*keys, ts])
        .groupBy(*keys, ts)
        .agg(*[total.alias(name) for name, total in totals.items()])
        .withColumn("_t", micros(ts))
        .withColumn("_s", floor_div(F.col("_t"), _SECOND))
        .withColumn("_d", floor_div(F.col("_t"), _DAY))
    )

    def summed(points: DataFrame, *by: str) -> DataFrame:
        sums = [F.sum(c).cast(points.schema[c].dataType).alias(c) for c in names]
        return points.groupBy(*keys, *by).agg(*sums)

    seconds = summed(instants, "_d", "_s")
    days = _before(summed(seconds, "_d"), keys, "_d", names, None)
    opened = _before(seconds, [*keys, "_d"], "_s", names, days)
    found = _before(instants.drop("_d"), [*keys, "_s"], "_t", names, opened.drop("_d"))
    return found.select(*keys, ts, *names)


def versions(rows: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Versions of a key's state, ``key, desde, hasta, columns``, from what deliveries said of it.

    Each delivery repeats the state; a version begins where it changes and ends where the
    next begins (``hasta`` exclusive, null while it holds). Of several rows of a key at
    one instant the greatest counts. A group is a key's deliveries.
    """
    state = F.struct(*columns)
    said = rows.dropna(subset=[key, at]).groupBy(key, F.col(at).alias("desde")).agg(F.max(state).alias("_estado"))
    history = Window.partitionBy(key).orderBy("desde")
    changed = said.withColumn("_antes", F.lag("_estado").over(history)).filter(~F.col("_antes").eqNullSafe(F.col("_estado")))
    return changed.withColumn("hasta", F.lead("desde").over(history)).select(
        key, "desde", "hasta", *[F.col(f"_estado.{c}").alias(c) for c in columns]
    )


def _crowded(points: DataFrame, slot: Column, share: float) -> Column:
    """Whether a row's ``slot`` of ``_SLOTS`` holds more than ``share`` of the dated ``points``.

    One list of flags for the whole query: points are counted per slot before they are
    shuffled, so a slot is one row per map task.
    """
    per_slot = points.groupBy(slot.alias("_s")).agg(F.count("_t").alias("_n"))
    slots = per_slot.agg(F.collect_list(F.struct("_s", "_n")).alias("_de"), F.sum("_n").alias("_todos"))
    crowded = F.transform(F.filter("_de", lambda s: s["_n"] > F.col("_todos") * F.lit(share)), lambda s: s["_s"])
    flags = F.transform(F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda s: F.array_contains("_llenas", s))
    return F.element_at(slots.select(crowded.alias("_llenas")).select(flags).scalar(), slot + 1)


def as_of(
    facts: DataFrame, states: DataFrame, key: str, ts: str, since: str, carry: Sequence[str],
    bucket_seconds: int = 3600, share: float = HOT_SHARE,
) -> DataFrame:
    """Each fact with the columns ``carry`` of its key's newest state not after it; null where there is none.

    ``states`` is unique in key and ``since``. Facts and states are put into one sorted
    run per key, and the last state seen is the answer: no range join, no fact repeated.
    Keys are dealt to slots by a hash; those of a slot with more than ``share`` of all
    rows, at most 1/share slots, have a run per time bucket instead. Such a bucket opens
    with the last state before it, from a pass over the buckets of a key. A group holds
    at most that share of the rows, or one bucket of one key. Facts without key or instant
    keep null states; they form groups of their own, spread by a hash.
    """
    span = bucket_seconds * _SECOND
    kind = facts.select(F.col(key).alias("_k")).union(states.select(F.col(key).alias("_k"))).schema["_k"].dataType
    state = F.struct(*[F.col(c) for c in carry])
    asked = facts.select(
        F.col(key).cast(kind).alias("_k"), micros(ts).alias("_t"), F.lit(1).alias("_orden"), F.struct("*").alias("_hecho")
    )
    dated = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    known = states.select(
        F.col(key).cast(kind).alias("_k"), micros(since).alias("_t"), F.lit(0).alias("_orden"), state.alias("_estado")
    ).filter(dated)
    slot = F.pmod(F.xxhash64("_k"), F.lit(_SLOTS)).cast("int")
    # The count and ``wanted`` read the same two columns of all facts: one shuffle serves both.
    hot = _crowded(asked.select("_k", "_t").unionByName(known.select("_k", "_t")), slot, share)
    bucket = F.when(hot, floor_div(F.col("_t"), span)).otherwise(F.lit(0).cast("bigint"))
    apart = F.lit(_UNDATED) + F.pmod(F.xxhash64("_hecho"), F.lit(_SLOTS))
    points = asked.withColumn("_b", F.when(dated, bucket).otherwise(apart))
    marks = known.withColumn("_b", bucket)

    last = marks.filter(hot).groupBy("_k", "_b").agg(F.max_by("_estado", "_t").alias("_estado"))
    wanted = asked.filter(hot).select("_k", floor_div(F.col("_t"), span).alias("_b")).distinct().withColumn("_pide", F.lit(True))
    per_bucket = wanted.unionByName(last, allowMissingColumns=True).groupBy("_k", "_b").agg(
        F.max("_pide").alias("_pide"), F.first("_estado", ignorenulls=True).alias("_estado")
    )
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        per_bucket.withColumn("_estado", F.last("_estado", ignorenulls=True).over(earlier))
        .filter("_pide and _estado is not null")
        .select("_k", "_b", F.lit(None).cast("bigint").alias("_t"), F.lit(0).alias("_orden"), "_estado")
    )
    run = points.unionByName(marks, allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    so_far = Window.partitionBy("_k", "_b").orderBy("_t", "_orden").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = run.withColumn("_estado", F.last("_estado", ignorenulls=True).over(so_far)).filter("_orden = 1")
    return found.select("_hecho.*", *[F.col(f"_estado.{c}").alias(c) for c in carry])

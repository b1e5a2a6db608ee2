"""Exact quantiles without sorting, or gathering, everything in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer and ``ntile`` sorts a group in one task; both fail once a
month holds all clients. Here a sketch cuts the values into parts first, and only the
parts that hold a quantile are ranked, in the same way for every size of group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.operators.sketches import quantile_bounds

QUARTILES = (0.25, 0.5, 0.75)
_SKETCH_SLACK = 0.003  # about twice the error of a stored sketch's ranks


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float] = QUARTILES,
    accuracy: int = 10_000,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """One row per ``by`` with ``cuts``: the linearly interpolated quantiles.

    ``by`` must be a domain that does not grow with the rows (calendar months,
    currencies, metric names): its bounds are broadcast. A sketch puts two bounds
    around each quantile, the rows between bounds are counted, and only the values
    between the bounds that hold a wanted rank are ranked, equal ones counted first.
    The sketch decides how many values that is (six in ``accuracy`` for a quantile),
    never which value comes out: a bound that is off makes its neighbour the part
    that is ranked. With ``sketched`` (``by`` and ``reparto``, see ``sketches``) the bounds
    come from stored sketches of the same rows, and no sketch pass over them is needed.
    """
    values = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 3.0 / accuracy if sketched is None else _SKETCH_SLACK
    marks = sorted({m for p in probs for m in (max(p - slack, 0.0), min(p + slack, 1.0))})
    if sketched is None:
        bounds = values.groupBy(*by).agg(F.percentile_approx("_v", marks, accuracy).alias("_bounds"))
    else:
        bounds = quantile_bounds(sketched, by, marks)
    part = sum(((F.col("_bounds")[i] < F.col("_v")).cast("int") for i in range(len(marks))), F.lit(0))
    placed = values.join(F.broadcast(bounds), list(by)).select(*by, "_v", part.alias("_part"))

    # A row per group and part: counts before the part, and the ranks wanted in it.
    whole = Window.partitionBy(*by)
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(whole.orderBy("_part"))
    ranks = [
        F.struct(F.lit(i).alias("i"), position.alias("pos"), rank(position).cast("bigint").alias("rank"))
        for i, p in enumerate(probs)
        for position in [F.lit(float(p)) * (F.sum("_n").over(whole) - 1)]
        for rank in (F.floor, F.ceil)
    ]
    wanted = (
        sizes.select(*by, "_part", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.array(*ranks).alias("_w"))
        .select(*by, "_part", "_before", "_upto", F.explode("_w").alias("_w"))
        .select(*by, "_part", "_before", "_upto", "_w.*")
        .filter((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_upto")))
        .drop("_upto")
        .distinct()
    )
    parts = wanted.select(*by, "_part", "_before").distinct()
    counted = (
        placed.join(F.broadcast(parts), [*by, "_part"])
        .groupBy(*by, "_part", "_before", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = Window.partitionBy(*by, "_part").orderBy("_v")
    found = (
        counted.withColumn("_upto", F.col("_before") + F.sum("_n").over(ranked))
        .join(F.broadcast(wanted.drop("_before")), [*by, "_part"])
        .filter(F.col("_upto") > F.col("rank"))
        .groupBy(*by, "i", "pos", "rank")
        .agg(F.min("_v").alias("_v"))
    )
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    cuts = found.groupBy(*by, "i", "pos").agg(
        (low + (high - low) * (F.col("pos") - F.floor("pos"))).alias("cut")
    )
    return cuts.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda pair: pair["cut"]
        ).alias("cuts")
    )


def band(value: Column, cuts: Column) -> Column:
    """1 + how many cuts lie below the value: equal values share a band."""
    v = value.cast("double")
    return F.lit(1) + F.size(F.filter(cuts, lambda cut: cut < v))

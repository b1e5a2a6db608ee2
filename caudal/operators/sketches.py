"""Mergeable sketches as table columns: distinct counts and quantiles of parts that are stored once.

A day's sketch is computed from that day's rows alone. Months, quarters and the overlap
of two months come from the stored sketches, without rows per client. A sketch has a
fixed largest size, is built map-side first, and merging it is independent of order, so
neither a hot day nor a hot group is a problem.

Distinct counts (theta sketches) are exact up to ``2**lg`` distinct values in a group;
beyond, the relative standard error is ``1 / sqrt(2**lg)``, for an intersection
relative to the union. Quantiles (KLL sketches) are used as brackets only, see
``quantile_bounds``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_NOMINAL = 12  # 4,096 values: 32 KB at most, error 1.6 %
KLL_K = 2000  # ranks within about 0.13 %


def relative_error(lg: int = LG_NOMINAL, deviations: float = 1.0) -> float:
    """The relative error of a distinct count that ``deviations`` standard errors make."""
    return deviations / math.sqrt(2**lg)


def distinct_sketches(rows: DataFrame, by: Sequence[str | Column], value: str, lg: int = LG_NOMINAL) -> DataFrame:
    """Per group the sketch of its distinct values, column ``distintos``; nulls don't count."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(value, lg).alias("distintos"))


def united(sketches: DataFrame, by: Sequence[str | Column], lg: int = LG_NOMINAL) -> DataFrame:
    """Sketches of finer groups merged into coarser ones."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("distintos", lg).alias("distintos"))


def n_distinct(sketch: Column | str = "distintos") -> Column:
    return F.theta_sketch_estimate(sketch).cast("bigint")


def n_common(a: Column | str, b: Column | str) -> Column:
    """Distinct values in both sketches."""
    return n_distinct(F.theta_intersection(a, b))


def quantile_sketches(rows: DataFrame, by: Sequence[str | Column], value: str, k: int = KLL_K) -> DataFrame:
    """Per group the quantile sketch of ``value``, column ``reparto``; nulls don't count."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("reparto"))


def merged(sketches: DataFrame, by: Sequence[str | Column], k: int = KLL_K) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("reparto", k).alias("reparto"))


def quantile_bounds(sketches: DataFrame, by: Sequence[str], marks: Sequence[float]) -> DataFrame:
    """``by`` and ``_bounds``: the sketches' values at the ranks ``marks``, ascending."""
    return sketches.select(
        *by, F.array(*[F.kll_sketch_get_quantile_double("reparto", F.lit(float(m))) for m in marks]).alias("_bounds")
    )

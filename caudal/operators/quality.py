"""Type validation and declarative data-quality rules.

Row rules are predicates that are true for a *failing* row; all rules of a table
are counted in one aggregation (``count_failures``), and ``failing_rows`` returns
the rows that break any. Rules over keys (unique, relationships, pairs) count per key
before they shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.values import key_matches

REASONS = "motivos"


# --- types ------------------------------------------------------------------

# A date, and maybe a time of day after it; a cast alone would take "2022" for a date.
_DAY = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"


def _typed(text: Column, kind: T.DataType) -> Column:
    """A trimmed text (null where blank) as ``kind``, null where it doesn't parse."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(text.rlike(_DAY), text).try_cast(kind)
    if isinstance(kind, T.DecimalType):
        # A cast would round digits that the type can't hold.
        finer = text.try_cast(T.DecimalType(38, min(38 - kind.precision + kind.scale, kind.scale + 12)))
        value = finer.try_cast(kind)
        return F.when(finer == value, value)
    return text.try_cast(kind)


def validate_types(raw: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Turn text columns into typed ones and list what failed in ``motivos``.

    A text that does not parse becomes null with reason ``tipo:<column>``; a
    required column without text gets ``nulo:<column>``. Nothing raises and no row
    is lost: ``motivos`` is empty for good rows. Other columns pass through.

    Trimming, parsing and the reasons are three projections, each using the one before
    more than once, so that the optimiser keeps them apart: a text is trimmed once and
    parsed once, in generated code.
    """
    extra = [c for c in raw.columns if c not in schema.names]
    parsed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    trimmed = {f"_texto_{f.name}": F.trim(F.col(f.name).cast("string")) for f in schema.fields}
    typed = {f"_valor_{f.name}": _typed(F.nullif(F.col(f"_texto_{f.name}"), F.lit("")), f.dataType) for f in parsed}
    rows = raw.withColumns(trimmed).withColumns(typed)
    reasons = []
    for f in schema.fields:
        text = F.col(f"_texto_{f.name}")
        if f in parsed:
            reasons.append(F.when((text != "") & F.col(f"_valor_{f.name}").isNull(), F.lit(f"tipo:{f.name}")))
        if f.name in required:
            reasons.append(F.when(F.coalesce(text, F.lit("")) == "", F.lit(f"nulo:{f.name}")))
    empty = F.array().cast("array<string>")
    # Reasons differ from each other, so taking null out of them as a set loses none.
    listed = F.array_except(F.array(*reasons), F.array(F.lit(None).cast("string"))) if reasons else empty
    return rows.select(
        *[F.col(f"_valor_{f.name}" if f in parsed else f.name).alias(f.name) for f in schema.fields],
        *extra,
        listed.alias(REASONS),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size(REASONS) == 0).drop(REASONS)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size(REASONS) > 0)


# --- rules over one row -----------------------------------------------------

def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def not_in(column: str, values: Sequence) -> Column:
    """A value outside the accepted ones; null is for ``is_missing`` to report."""
    return F.coalesce(~F.col(column).isin(*values), F.lit(False))


def bad_key(column: str, prefix: str, digits: int) -> Column:
    return F.coalesce(~key_matches(column, prefix, digits), F.lit(False))


def outside_range(
    amount: str, kind: str, ranges: Mapping[str, tuple[float, float]]
) -> Column:
    """An amount outside the range of its type; types without a range pass."""
    tests = [
        (F.col(kind) == name) & ~F.col(amount).between(low, high)
        for name, (low, high) in ranges.items()
    ]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def presence_breaks_rule(column: str, kind: str, kinds_with_value: Sequence) -> Column:
    """The column must hold a value exactly for the given types."""
    expected = F.coalesce(F.col(kind).isin(*kinds_with_value), F.lit(False))
    return expected != F.col(column).isNotNull()


def earlier_than(first: str, second: str) -> Column:
    """``first`` lies before ``second`` although it must not."""
    return F.coalesce(F.col(first) < F.col(second), F.lit(False))


def count_failures(
    df: DataFrame, rules: Mapping[str, Column], weight: str | None = None
) -> DataFrame:
    """(check, n_rows, n_failed) of all rules in one aggregation.

    ``weight`` names a column of row counts where ``df`` is pre-aggregated.
    """
    ones = F.col(weight) if weight else F.lit(1).cast("bigint")
    names = list(rules)
    totals = df.agg(
        F.coalesce(F.sum(ones), F.lit(0)).alias("_n"),
        *[
            F.coalesce(F.sum(F.when(rules[name], ones)), F.lit(0)).alias(f"_f{i}")
            for i, name in enumerate(names)
        ],
    )
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"),
                        F.col("_n").alias("n_rows"),
                        F.col(f"_f{i}").alias("n_failed"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        ).alias("_c")
    ).select("_c.*")


def failing_rows(df: DataFrame, rules: Mapping[str, Column], name: str = "reglas") -> DataFrame:
    """Rows that break a rule, with the list of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(check)) for check, rule in rules.items()]))
    return df.withColumn(name, broken).filter(F.size(name) > 0)


def exceeding(report: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Checks of a report whose share of failed rows is above their limit."""
    limit = F.coalesce(*[F.when(F.col("check") == check, F.lit(share)) for check, share in limits.items()])
    return report.withColumn("limite", limit).filter(F.col("n_failed") > F.col("limite") * F.col("n_rows"))


# --- rules over keys --------------------------------------------------------

def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def count_repeated(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """n_failed: rows beyond the first of their key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_failed"),
    ).select(F.lit(check).alias("check"), "n_rows", "n_failed")


def count_against(
    rows: DataFrame, keys: Sequence[str], lookups: Sequence[tuple[DataFrame, Sequence[str], str]], rules: Mapping[str, Column]
) -> DataFrame:
    """(check, n_rows, n_failed) of rules that look keys up in other tables.

    ``rows`` are counted per ``keys`` once, so a hot key is a few rows when it is
    joined. Each lookup is a table unique in the columns it is joined on, those
    columns, and the name of the flag that is true where it has them.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    for table, on, flag in lookups:
        counted = counted.join(table.withColumn(flag, F.lit(True)), list(on), "left")
    return count_failures(counted, rules, "_w")


def lost(keys: Sequence[str], flag: str) -> Column:
    """All key columns hold a value, and the looked-up table doesn't have them."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.col(flag).isNull()


def count_orphans(
    child: DataFrame, key: str, parent: DataFrame, check: str, parent_key: str | None = None
) -> DataFrame:
    parents = parent.select(F.col(parent_key or key).alias(key))
    return count_against(child, [key], [(parents, [key], "_hay")], {check: lost([key], "_hay")})


def count_pairs_outside(df: DataFrame, pair: Sequence[str], seed: DataFrame, check: str) -> DataFrame:
    return count_against(df, pair, [(seed.select(*pair), pair, "_hay")], {check: lost(pair, "_hay")})

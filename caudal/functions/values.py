"""Keys, directions, months and seconds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caudal import domain


def format_key(number: Column | str, prefix: str, digits: int) -> Column:
    """Prefix and zero-padded number; numbers wider than the padding stay whole."""
    return F.format_string(f"{prefix}%0{digits}d", number)


def key_matches(key: Column | str, prefix: str, digits: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.rlike(f"^{prefix}[0-9]{{{digits},}}$")


def direction(tipo: Column | str, inflow: Sequence[str] = domain.TIPOS_ENTRADA) -> Column:
    """+1 for types that bring money in, -1 for every other type."""
    tipo = F.col(tipo) if isinstance(tipo, str) else tipo
    return F.when(tipo.isin(*inflow), F.lit(1)).otherwise(F.lit(-1))


def by_value(column: Column | str, branches: Mapping[str, Column], default: Column) -> Column:
    """Multi-way branch on the value of a column."""
    column = F.col(column) if isinstance(column, str) else column
    result = None
    for value, then in branches.items():
        result = F.when(column == value, then) if result is None else result.when(column == value, then)
    return default if result is None else result.otherwise(default)


def month_of(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def plus_seconds(ts: Column | str, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff(
        "SECOND",
        F.col(start) if isinstance(start, str) else start,
        F.col(end) if isinstance(end, str) else end,
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (the session zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def floor_div(number: Column, divisor: int) -> Column:
    """Whole-number division towards minus infinity, exact for instants of any year in use."""
    divisor = F.lit(divisor).cast("bigint")
    return ((number - F.pmod(number, divisor)) / divisor).cast("bigint")

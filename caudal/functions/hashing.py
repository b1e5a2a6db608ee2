"""Seeded, repeatable draws: a value depends on its key and salt only.

Random-number functions depend on the partitioning, so a lost task could draw
anew. A hash of the key gives the same draw on every attempt and cluster size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits: as fine as a double, so that even billions of values are all reached.
_DIGITS, _STEPS = 13, 4503599627370496.0


def hash_uniform(key: Column | str, salt: str) -> Column:
    """Uniform double in [0, 1): the first 52 bits of md5('salt:key') over 2^52."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(_STEPS)


def uniform_between(key: Column | str, salt: str, low: float, high: float) -> Column:
    """Uniform double in [low, high)."""
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * hash_uniform(key, salt)


def uniform_int(key: Column | str, salt: str, low: int, high: int) -> Column:
    """Uniform bigint in [low, high], both ends included."""
    span = high - low + 1
    return F.lit(low) + F.floor(hash_uniform(key, salt) * F.lit(span)).cast("bigint")


def weighted_choice(key: Column | str, salt: str, weights: Mapping[str, float]) -> Column:
    """Draw one value with the given weights (they need not add up to one)."""
    total = sum(weights.values())
    names = list(weights)
    draw, reached, choice = hash_uniform(key, salt), 0.0, None
    for name in names[:-1]:
        reached += weights[name] / total
        hit = draw < F.lit(round(reached, 12))
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])


def pick(values: Column | Sequence[str], key: Column | str, salt: str) -> Column:
    """One element of an array (or of a fixed list), every element equally likely."""
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    index = F.floor(hash_uniform(key, salt) * F.size(array)).cast("int")
    return F.get(array, index)

"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Epoch microseconds of a timestamp (with or without time zone)."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds(c: str | Column) -> Column:
    return micros(c) / F.lit(1_000_000.0)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def flagged(*pairs) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def ladder(steps, otherwise) -> Column:
    """``CASE WHEN`` over (condition, value) pairs."""
    out = None
    for cond, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return last if out is None else out.otherwise(last)


def clamp(c, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(col(c), low), high)


def ratio(num, den) -> Column:
    """num / den, null where den is 0."""
    return col(num) / F.nullif(col(den), F.lit(0))


def constant_map(mapping: dict, key: str | Column, default=None) -> Column:
    """Look a key up in a small fixed mapping with ``CASE WHEN``."""
    return ladder([(col(key) == F.lit(k), v) for k, v in mapping.items()], F.lit(default))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys in which null equals null; the right copies of the keys are dropped."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = all_of([F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a scalar subquery holding a struct of its columns."""
    return stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()

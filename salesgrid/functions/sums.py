"""Sums that do not depend on the order in which partitions arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(28,4)"


def as_exact(df: DataFrame, name: str) -> Column:
    """The column as a decimal; decimals and integers are left as they are."""
    kind = df.schema[name].dataType
    exact = (T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return F.col(name) if isinstance(kind, exact) else F.col(name).cast(MONEY)


def exact_sum(df: DataFrame, name: str, where: Column | None = None) -> Column:
    """Sum as double; all-null groups give 0. `where` restricts the rows summed."""
    value = as_exact(df, name)
    if where is not None:
        value = F.when(where, value)
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def exact_avg(df: DataFrame, name: str, kind: str = MONEY) -> Column:
    """Mean as double from the exact sum, so it too is the same in every run."""
    return F.sum(F.col(name).cast(kind)).cast("double") / F.count(name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b != 0, a / b)


def growth(curr: Column, prev: Column) -> Column:
    """curr / prev - 1, null where prev is null or zero."""
    return ratio(curr, prev) - 1


def present(df: DataFrame, names) -> list[str]:
    """The wanted columns that exist, in the wanted order and without repeats."""
    return [c for c in dict.fromkeys(names or []) if c in df.columns]


def same_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join in which null keys match null keys; key columns are kept once, from the left."""
    if not keys:
        raise ValueError("same_keys needs at least one key")
    other = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])

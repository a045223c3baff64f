"""Filters, labels and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesgrid.functions.dates import month_iso, month_label
from salesgrid.functions.sums import present

LABEL_ORDER = ("category", "market", "channel", "brand")


def normalised(value) -> str:
    return str(value).strip().lower()


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """Keep rows whose dimensions match, ignoring case and surrounding blanks.

    A list means any of its values. Unknown columns and empty values are ignored.
    """
    for name, value in (filters or {}).items():
        if name not in df.columns or value is None:
            continue
        many = value if isinstance(value, (list, tuple, set)) else [value]
        wanted = sorted({normalised(v) for v in many if v is not None and normalised(v)})
        if wanted:
            df = df.filter(F.lower(F.trim(F.col(name).cast("string"))).isin(wanted))
    return df


def focus(df: DataFrame, dim: str, value) -> DataFrame:
    """Rows of one dimension value, compared as text."""
    return df.filter(F.col(dim).cast("string") == str(value))


def safe_numeric_fill(df: DataFrame) -> DataFrame:
    """Infinite and missing numbers become 0; text is left alone."""
    fixed = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            fixed[field.name] = F.coalesce(F.when(~bad, c), F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.NumericType):
            fixed[field.name] = F.coalesce(c, F.lit(0).cast(field.dataType))
    return df.withColumns(fixed) if fixed else df


def with_filter_labels(df: DataFrame, filters: dict | None) -> DataFrame:
    """Add the filter values as columns, labels first; several values are joined by a comma."""
    filters = filters or {}
    labels = {}
    for name in LABEL_ORDER:
        value = filters.get(name)
        if value is None:
            continue
        many = list(value) if isinstance(value, (list, tuple, set)) else [value]
        labels[name] = ", ".join(str(v) for v in many)
    df = df.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else df
    first = present(df, LABEL_ORDER)
    return df.select(*first, *[c for c in df.columns if c not in first])


def with_month_labels(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumns({"month_label": month_label(col), "month_iso": month_iso(col)})


def tail_points(df: DataFrame, n: int, col: str = "date", tie: tuple = ()) -> DataFrame:
    """The last n rows in time order (a top-n, not a full sort)."""
    return df.orderBy(F.desc_nulls_last(col), *[F.asc(t) for t in tie]).limit(n)


def melt_measures(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    return df.unpivot(ids, measures, "measure", "value")


def trim_dims(df: DataFrame, dims) -> DataFrame:
    return df.withColumns({d: F.trim(F.col(d)) for d in present(df, dims)})


"""From raw tables of text to a checked fact."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_start, parse_mixed_date
from salesgrid.functions.sums import as_exact, growth, present, same_keys
from salesgrid.operators.filters import trim_dims
from salesgrid.sources.fact import DIMS, MEASURES, OPTIONAL_DIMS
from salesgrid.sources.files import stored

REQUIRED = ("date", *DIMS, *MEASURES)

# The header words that stand for each column.
ALIASES = {
    "date": ("date", "month", "period", "periodstart"),
    "market": ("market", "country", "geo"),
    "channel": ("channel", "retailer", "tradechannel"),
    "category": ("category", "segment"),
    "brand": ("brand", "banner", "label"),
    "value_sales": ("value", "valuesales", "salesvalue", "valueinr", "valueusd"),
    "unit_sales": ("unit", "units", "unitsales", "salesunits", "volume"),
    "share": ("share", "ms", "marketshare"),
}


def autodetect_mapper(columns: list[str]) -> dict[str, str]:
    """Canonical name -> source header, by header words without case and punctuation."""
    found = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in columns}
    mapper = {}
    for name, words in ALIASES.items():
        hit = next((found[w] for w in words if w in found), None)
        if hit is not None:
            mapper[name] = hit
    return mapper


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def parse_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """Mixed date cells to timestamps, unreadable ones to null."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(col, F.col(col).cast("timestamp"))
    return df.withColumn(col, parse_mixed_date(col))


def to_month(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumn(col, month_start(col))


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def coerce_numeric(df: DataFrame, cols=MEASURES) -> DataFrame:
    """Numbers from text; anything else becomes null."""

    def number(c: str):
        if not isinstance(df.schema[c].dataType, T.StringType):
            return F.col(c).cast("double")
        text = F.trim(F.col(c))
        return F.when(text.rlike(NUMBER), text.try_cast("double"))

    return df.withColumns({c: number(c) for c in present(df, cols)})


def split_invalid_dates(df: DataFrame, col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows with a date, rows without)."""
    return df.filter(F.col(col).isNotNull()), df.filter(F.col(col).isNull())


def quarantine(df: DataFrame, path: str, col: str = "date") -> DataFrame:
    """Write the rows without a date as CSV and return the others."""
    good, bad = split_invalid_dates(df, col)
    bad.write.mode("overwrite").option("header", True).csv(path)
    return good


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    return df.limit(n)


def validate_schema(df: DataFrame) -> list[str]:
    return [f"Missing required column: {c}" for c in REQUIRED if c not in df.columns]


def validate_basic(df: DataFrame) -> DataFrame:
    """One row per failed check: null dates, negative value, negative units."""
    checks = {
        "Null dates found.": F.col("date").isNull(),
        "Negative value_sales found.": F.col("value_sales") < 0,
        "Negative unit_sales found.": F.col("unit_sales") < 0,
    }
    found = [F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)) for c in checks.values()]
    one = df.agg(*[f.alias(f"c{i}") for i, f in enumerate(found)])
    rows = F.array(*[F.when(F.col(f"c{i}"), F.lit(m)) for i, m in enumerate(checks)])
    return one.select(F.explode(F.array_compact(rows)).alias("error"))


def derive_fields(df: DataFrame) -> DataFrame:
    """Add value_yoy (change to the series' value 12 rows earlier, gaps padded forward)
    and share_yoy (difference to the share 12 rows earlier).

    A series is one market, channel, category and brand: one row per month.
    """
    series = Window.partitionBy(*DIMS).orderBy("date")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    padded = F.last("value_sales", ignorenulls=True).over(so_far)
    out = df.filter(F.col("date").isNotNull()).withColumn("__pad", padded)
    out = out.withColumn("value_yoy", growth(F.col("__pad"), F.lag("__pad", 12).over(series)))
    out = out.withColumn("share_yoy", F.col("share") - F.lag("share", 12).over(series))
    return out.drop("__pad")


def derive_rows(df: DataFrame) -> DataFrame:
    """`derive_fields` for rows that may share a month of their series.

    Sums of the month are derived, and each row gets those of its month, so the rows of a
    series meet only as monthly sums. Rows without a date are left out; nulls add nothing,
    and a month of nulls alone is a gap.
    """
    keys = ["date", *DIMS]

    def total(name: str):
        return F.sum(as_exact(df, name) if name != "share" else F.col(name).cast("decimal(28,6)"))

    months = df.groupBy(*keys).agg(
        *[total(m).cast("double").alias(m) for m in ("value_sales", "share")]
    )
    grown = derive_fields(months).select(*keys, "value_yoy", "share_yoy")
    return same_keys(df.filter(F.col("date").isNotNull()), grown, keys)


def ingest_summary(raw: DataFrame) -> DataFrame:
    """Kept rows, first and last date, and rows without a date, in one pass."""
    return raw.agg(
        F.count("date").alias("rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count(F.when(F.col("date").isNull(), 1)).alias("invalid_date_rows"),
    )


def rejection_causes(df: DataFrame, mapper: dict[str, str] | None = None) -> DataFrame:
    """What is wrong with a raw table, one row per cause: `cause`, `rows`, `example`, in one pass.

    Dates are missing (null or blank) or unreadable; measures are not a number or negative. A
    required column that is absent counts all rows. Causes that do not occur are listed with 0 rows.
    The example is the least text, trimmed; an empty table gives 0 everywhere and no examples.
    """
    mapper = autodetect_mapper(df.columns) if mapper is None else mapper
    named = df.withColumnsRenamed({src: name for name, src in mapper.items()})
    seen = present(named, ("date", *MEASURES))
    as_text = {f"__text_{c}": F.trim(F.col(c).cast("string")) for c in seen}
    rows = coerce_numeric(named.withColumns(as_text))
    rows = parse_dates(rows) if "date" in seen else rows
    causes = [(f"{c} column missing", F.lit(True), F.lit(None).cast("string")) for c in REQUIRED if c not in named.columns]
    for c in seen:
        text, value = F.col(f"__text_{c}"), F.col(c)
        blank = F.coalesce(text == "", F.lit(True))
        if c == "date":
            causes.append(("date missing", blank, F.lit(None).cast("string")))
            causes.append(("date unreadable", ~blank & value.isNull(), text))
        else:
            causes.append((f"{c} not a number", ~blank & value.isNull(), text))
            causes.append((f"{c} negative", value < 0, text))
    one = rows.agg(
        *[F.count(F.when(wrong, 1)).alias(f"__n{i}") for i, (_, wrong, _) in enumerate(causes)],
        *[F.min(F.when(wrong, text)).alias(f"__e{i}") for i, (_, wrong, text) in enumerate(causes)],
    )
    listed = [
        F.struct(F.lit(cause).alias("cause"), F.col(f"__n{i}").alias("rows"), F.col(f"__e{i}").alias("example"))
        for i, (cause, _, _) in enumerate(causes)
    ]
    return one.select(F.inline(F.array(*listed)))


def clean_dims(df: DataFrame) -> DataFrame:
    return trim_dims(df, DIMS + OPTIONAL_DIMS)


def read_raw(df: DataFrame, mapper: dict[str, str] | None = None) -> DataFrame:
    """Headers mapped, dates parsed to months, measures as numbers, dimensions trimmed."""
    mapper = autodetect_mapper(df.columns) if mapper is None else mapper
    df = df.withColumnsRenamed({src: name for name, src in mapper.items()})
    return clean_dims(coerce_numeric(to_month(parse_dates(df))))


def _stored_rows(rows: DataFrame) -> DataFrame:
    """The rows written once, under plain names so that any headers do; untyped columns hold only nulls."""
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    untyped = [c for c, kind in plain.dtypes if kind == "void"]
    back = stored(plain.drop(*untyped), "rows")
    return back.select(*[F.lit(None).alias(c) if c in untyped else c for c in plain.columns]).toDF(*rows.columns)


def ingest(
    df: DataFrame, mapper: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw rows to (derived fact, rows without a readable date); raises on a failed check.

    The read rows are written once: checks, monthly sums and both results read them, and no cell is parsed again.
    """
    rows = read_raw(df, mapper)
    missing = validate_schema(rows)
    if missing:
        raise ValueError("; ".join(missing))
    good, rejected = split_invalid_dates(_stored_rows(rows))
    errors = [r["error"] for r in validate_basic(good).collect()]
    if errors:
        raise ValueError("; ".join(errors))
    return derive_rows(good), rejected


def missing_percent(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column."""
    cols = df.columns
    one = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "missing_pct")


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and their percentage (null equals null)."""
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    rows, kinds = F.sum("__n"), F.count("*")
    repeated = (F.coalesce(rows, F.lit(0)) - kinds).cast("bigint")
    return distinct.agg(
        repeated.alias("duplicates"),
        F.when(rows > 0, 100.0 * repeated / rows).alias("duplicate_pct"),
    )


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop()

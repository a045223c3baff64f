"""Shares, Pareto, rolling means, extremes and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_start
from salesgrid.functions.sums import exact_sum, ratio, same_keys
from salesgrid.operators.agg import grouped_sum
from salesgrid.operators.spread import exact_quantiles, top_rows, with_running


def with_total(df: DataFrame, part_of: list[str], measure: str, total: str, name: str) -> DataFrame:
    """Add the group total and the percentage of it.

    The totals are aggregated (map side first) and joined back, so a group of any size
    is never gathered; Spark broadcasts the totals where they are small.
    """
    whole = df.groupBy(*part_of).agg(exact_sum(df, measure).alias(total))
    return same_keys(df, whole, part_of).withColumn(
        name, 100 * ratio(F.col(measure), F.col(total))
    )


def market_share(df: DataFrame, measure: str = "value_sales") -> DataFrame:
    """Brand share within category and market, best first."""
    sums = grouped_sum(df, ["category", "market", "brand"], measure)
    out = with_total(sums, ["category", "market"], measure, "total_sales", "market_share_percent")
    return out.orderBy("category", "market", F.desc("market_share_percent"), "brand")


def category_share(monthly: DataFrame, measure: str = "value_sales") -> DataFrame:
    """Share of each cell in its month, market, channel and category."""
    keys = ["month", "market", "channel", "category"]
    return with_total(monthly, keys, measure, "cat_total_value", "share")


def pareto(df: DataFrame, by=("category", "market"), item="brand", measure="value_sales"):
    """Share and running share of the items, largest first, with the 80 % line."""
    by = list(by)
    sums = grouped_sum(df, [*by, item], measure)
    out = with_total(sums, by, measure, "cat_mkt_total", "share_pct")
    exact = F.col(measure).cast("decimal(28,4)")
    run = with_running(out, by, measure, {"__run": exact}, descending=True, tie=(item,))
    cum = 100 * ratio(F.col("__run").cast("double"), F.col("cat_mkt_total"))
    return (
        run.withColumn("cum_share_pct", cum)
        .withColumn("in_80", F.col("cum_share_pct") <= 80)
        .drop("__run")
    )


def rolling_mean(
    df: DataFrame, keys, value: str, n: int = 3, min_periods: int = 1, date: str = "month",
    name: str | None = None,
) -> DataFrame:
    """Mean of the last n rows of each monthly series; null below `min_periods` values."""
    frame = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(n - 1), 0)
    enough = F.count(value).over(frame) >= min_periods
    return df.withColumn(name or f"{value}_roll{n}", F.when(enough, F.avg(value).over(frame)))


def extremes(df: DataFrame, by, measure: str, date: str = "date") -> DataFrame:
    """Least and greatest value with their month; nulls skipped, first date on ties."""
    seen = df.filter(F.col(measure).isNotNull())
    low = F.min(F.struct(F.col(measure).alias("v"), F.col(date).alias("d"))).alias("lo")
    # The greatest value at its first date: the order key turns the date around.
    back = F.datediff(F.lit("9999-12-31").cast("date"), F.col(date).cast("date"))
    high = F.max(F.struct(F.col(measure).alias("v"), back.alias("b"), F.col(date).alias("d")))
    aggs = [low, high.alias("hi")]
    out = seen.groupBy(*by).agg(*aggs) if by else seen.agg(*aggs, F.count("*").alias("__n"))
    if not by:
        out = out.filter(F.col("__n") > 0)
    return out.select(
        *by,
        F.col("lo.v").alias("min_value"),
        F.col("lo.d").alias("min_date"),
        F.date_format("lo.d", "MMM yyyy").alias("min_label"),
        F.col("hi.v").alias("max_value"),
        F.col("hi.d").alias("max_date"),
        F.date_format("hi.d", "MMM yyyy").alias("max_label"),
    )


def drawdown(df: DataFrame, by: str, measure: str, date: str = "date") -> DataFrame:
    """Peak-to-trough drop per item, and the trough month that several items share."""
    ends = extremes(df, [by], measure, date)
    drop = F.when(
        (F.col("max_value") > 0) & (F.col("min_value") != 0),
        (F.col("max_value") - F.col("min_value")) / F.col("max_value"),
    )
    counts = ends.groupBy("min_label").agg(
        F.count("*").alias("n"), F.min("min_date").alias("first_date")
    )
    common = top_rows(counts, [F.desc("n"), F.asc("first_date")], 1)
    label = common.filter(F.col("n") >= 2).select("min_label").scalar()
    return ends.withColumn("drop_pct", 100 * drop).withColumn("common_trough", label)


def peak_month(df: DataFrame, measure: str) -> DataFrame:
    """The month in which the summed series is greatest, the first one on ties."""
    by_month = df.groupBy(month_start("date").alias("month")).agg(
        exact_sum(df, measure).alias("value")
    )
    best = top_rows(by_month, [F.desc("value"), F.asc("month")], 1)
    return best.withColumn("label", F.date_format("month", "MMM yyyy"))


def top_share(df: DataFrame, dim: str, measure: str = "value_sales", n: int = 10) -> DataFrame:
    """The n largest items with their share of everything and their share of the n."""
    sums = grouped_sum(df, [dim], measure)
    whole = sums.agg(exact_sum(sums, measure).alias("t")).scalar()
    order = [F.desc_nulls_last(measure), F.asc_nulls_last(dim)]
    top = top_rows(sums, order, n, "rank")
    shown = F.sum(F.col(measure).cast("decimal(28,4)")).over(Window.partitionBy()).cast("double")
    return top.select(
        "rank",
        dim,
        measure,
        ratio(F.col(measure), whole).alias("share_of_total"),
        ratio(F.col(measure), shown).alias("share_of_top"),
    )


def iqr_outliers(
    df: DataFrame, by, col: str = "value_sales", k: float = 1.5, min_points: int = 1, monthly: bool = False
) -> DataFrame:
    """Rows outside the k x IQR bounds of their series, with the bounds.

    The quartiles are exact for series of any length; series that are known to hold a row a
    month (`monthly`) take one window, so the rows are read and shuffled once.
    """
    x = F.col(col)
    if monthly:
        whole = Window.partitionBy(*by)
        q1, q3 = [F.percentile(x.cast("double"), p).over(whole) for p in (0.25, 0.75)]
        rows = df.withColumns({"__q1": q1, "__q3": q3, "__n": F.count(x).over(whole)})
        rows = rows.filter(F.col("__n") >= min_points)
        iqr = F.col("__q3") - F.col("__q1")
        lower, upper = F.col("__q1") - k * iqr, F.col("__q3") + k * iqr
        rows = rows.withColumns({"lower_bound": lower, "upper_bound": upper}).drop("__q1", "__q3", "__n")
        return rows.filter((x < F.col("lower_bound")) | (x > F.col("upper_bound")))
    q = exact_quantiles(df, list(by), col, {"__q1": 0.25, "__q3": 0.75})
    if min_points > 1:
        size = df.groupBy(*by).agg(F.count(col).alias("__n")).filter(F.col("__n") >= min_points)
        q = same_keys(q, size, by)
    iqr = F.col("__q3") - F.col("__q1")
    bounds = q.select(
        *by,
        (F.col("__q1") - k * iqr).alias("lower_bound"),
        (F.col("__q3") + k * iqr).alias("upper_bound"),
    )
    return same_keys(df, bounds, by).filter(
        (x < F.col("lower_bound")) | (x > F.col("upper_bound"))
    )

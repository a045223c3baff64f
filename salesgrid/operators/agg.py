"""Totals, rankings and descriptive statistics of the fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_start, months_inclusive
from salesgrid.functions.sums import as_exact, exact_avg, exact_sum, present, ratio, same_keys
from salesgrid.operators.filters import apply_filters, with_filter_labels
from salesgrid.operators.spread import exact_quantiles, top_rows, with_rank
from salesgrid.operators.windows import MonthWindow

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def grouped_sum(df: DataFrame, dims, measure: str) -> DataFrame:
    """Sum per group, null keys kept; without known dims one total, or no row for no rows."""
    dims = present(df, dims)
    if dims:
        return df.groupBy(*dims).agg(exact_sum(df, measure).alias(measure))
    one = df.agg(exact_sum(df, measure).alias(measure), F.count("*").alias("__n"))
    return one.filter(F.col("__n") > 0).drop("__n")


def _order(measure: str, dims) -> list[Column]:
    return [F.desc_nulls_last(measure), *[F.asc_nulls_last(d) for d in dims]]


def aggregate(df: DataFrame, dims, measure: str = "value_sales") -> DataFrame:
    """Sum per group, largest first."""
    dims = present(df, dims)
    out = grouped_sum(df, dims, measure)
    return out.orderBy(*_order(measure, dims)) if dims else out


def top_n(df: DataFrame, dim: str, measure: str = "value_sales", n: int = 5) -> DataFrame:
    """The n values of `dim` with the largest sums."""
    return top_rows(grouped_sum(df, [dim], measure), _order(measure, [dim]), n)


def top_n_or_total(df, dims, measure, n, filters=None, brand_group=False) -> DataFrame:
    """Top-N over brand or the first free dimension; a labelled total where none is free."""
    filters = filters or {}
    free = [d for d in dims or [] if d != "date" and d not in filters]
    dim = "brand" if brand_group and "brand" in df.columns else (free[0] if free else None)
    if dim is None:
        return with_filter_labels(grouped_sum(df, [], measure), filters)
    return top_n(df, dim, measure, n)


def total(
    df: DataFrame, measure: str, dims=None, filters=None, task="table", brand_group=False
) -> DataFrame:
    """Totals or chart rows. Only a chart keeps the date; brand stays only when grouped."""
    filters = filters or {}
    brands = filters.get("brand")
    several = isinstance(brands, (list, tuple, set)) and len(brands) > 1
    dims = list(dims or [])
    if task == "chart" and "date" in dims and (several or brand_group) and "brand" not in dims:
        dims.append("brand")
    if not (task == "chart" and "date" in dims):
        dims = [d for d in dims if d != "date"]
    if not brand_group and not (several and task == "chart"):
        dims = [d for d in dims if d != "brand"]
    out = aggregate(df, dims, measure)
    return out if dims else with_filter_labels(out, filters)


def bar_items(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every value of x with its sum of y and its rank, largest first."""
    sums = df.groupBy(F.col(x).alias("label")).agg(exact_sum(df, y).alias("value"))
    return with_rank(sums, [], "value", tie=("label",)).select("rank", "label", "value")


def monthly(df: DataFrame, dims, share_mean: bool = False) -> DataFrame:
    """Value and units per month and dims; optionally the mean share."""
    aggs = [exact_sum(df, m).alias(m) for m in ("value_sales", "unit_sales")]
    if share_mean:
        aggs.append(exact_avg(df, "share", "decimal(28,6)").alias("share"))
    return df.groupBy(month_start("date").alias("month"), *dims).agg(*aggs)


def sum_slice(
    df: DataFrame, category: str, brand: str | None, start: str, end: str, measure="value_sales"
) -> DataFrame:
    """One sum for a category (and brand) between two dates; unreadable numbers count 0."""
    keep = apply_filters(df, {"category": category, "brand": brand})
    keep = keep.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    number = F.col(measure).cast("string").try_cast("decimal(28,4)")
    return keep.agg(F.coalesce(F.sum(number).cast("double"), F.lit(0.0)).alias(measure))


def _long(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(c) for c in cols]
    return df.select(*keep, *doubles).unpivot(list(keep), cols, "measure", "x")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, exact at any size."""
    long = _long(df, cols)
    quartiles = exact_quantiles(long, ["measure"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    moments = long.groupBy("measure").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return same_keys(moments, quartiles, ["measure"], "left")


def unbiased_skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def unbiased_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(
        n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    )


def desc_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Mean, median, min, max, sample std, cv, and bias-corrected skew and kurtosis."""
    median = exact_quantiles(df, by, col, {"median": 0.5})
    std, mean = F.stddev_samp(col), F.avg(col)
    rest = df.groupBy(*by).agg(
        mean.alias("mean"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        std.alias("std"),
        ratio(std, mean).alias("cv"),
        unbiased_skew(col).alias("skew"),
        unbiased_kurtosis(col).alias("kurtosis"),
    )
    return same_keys(rest, median, by, "left")


def skew_table(df: DataFrame, cols: list[str]) -> DataFrame:
    return _long(df, cols).groupBy("measure").agg(unbiased_skew("x").alias("skew"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, in one pass, as (a, b, corr) rows."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    names = F.split("pair", "__")
    return long.select(names[0].alias("a"), names[1].alias("b"), "corr")


def seasonality(df: DataFrame, calendar_month: bool = False) -> DataFrame:
    """Mean value and units by category, market and month (or month of the year)."""
    when = F.month("month").alias("month_num") if calendar_month else F.col("month")
    return df.groupBy("category", "market", when).agg(
        exact_avg(df, "value_sales").alias("avg_value_sales"),
        exact_avg(df, "unit_sales").alias("avg_unit_sales"),
    )


def calendar_month_mean(df: DataFrame, col: str, month: str = "month") -> DataFrame:
    """Mean per month of the year, January first."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return (
        df.groupBy(F.month(month).alias("month_num"))
        .agg(exact_avg(df, col).alias("mean"))
        .withColumn("month_name", F.element_at(names, F.col("month_num")))
        .orderBy("month_num")
    )


def pivot_month_brand(
    df: DataFrame, brands: list[str] | None = None, measure: str = "value_sales"
) -> DataFrame:
    """Months as rows, the given brands as columns; without a list all brands of the data."""
    cells = df.groupBy(month_start("date").alias("month")).pivot("brand", brands)
    return cells.agg(F.sum(as_exact(df, measure)).cast("double"))


def yoy_items(df: DataFrame, dims, measure: str = "value_sales") -> DataFrame:
    """Fold year-on-year rows to fewer dims; like the reported items, growth is summed too."""
    curr, prev = f"{measure}_curr", f"{measure}_prev"
    yoy = ("unit" if measure.startswith("unit") else "value") + "_yoy"
    sums = [F.sum(yoy).alias("yoy_pct")]
    aggs = [exact_sum(df, curr).alias("curr"), exact_sum(df, prev).alias("prev"), *sums]
    return df.groupBy(*dims).agg(*aggs) if dims else df.agg(*aggs)


def mat_items(df: DataFrame, measure: str = "value_sales") -> DataFrame:
    return df.groupBy(F.col("mat_label").alias("label")).agg(exact_sum(df, measure).alias("total"))


def compact_summary(df: DataFrame, dim: str, measure: str = "value_sales", n: int = 5) -> DataFrame:
    """Rows of three kinds: every category's sum, the overall total, and the top n."""
    sums = grouped_sum(df, [dim], measure)
    names = [F.col(dim).alias("name"), F.round(measure, 4).alias("value")]
    blocks = [
        sums.select(F.lit("category").alias("block"), *names),
        grouped_sum(sums, [], measure).select(
            F.lit("total").alias("block"),
            F.lit(None).cast("string").alias("name"),
            F.round(measure, 4).alias("value"),
        ),
        top_rows(sums, _order(measure, [dim]), n).select(F.lit("top").alias("block"), *names),
    ]
    return reduce(DataFrame.unionByName, blocks)


def concentration(df: DataFrame, dim: str, measure: str = "value_sales") -> DataFrame:
    """Leader, runner-up, their gap, the leader's share, and the Herfindahl index with its band."""
    sums = grouped_sum(df, [dim], measure).filter(F.col(measure).isNotNull())
    whole = sums.agg(exact_sum(sums, measure).alias("t")).scalar()
    share = F.col(measure) / F.greatest(whole, F.lit(1e-9))
    lead = top_rows(sums, _order(measure, [dim]), 2, "rank")

    def at(rank: int, col: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(col)))

    pair = lead.agg(
        at(1, dim).alias("leader"),
        at(1, measure).alias("leader_value"),
        at(2, dim).alias("runner_up"),
        at(2, measure).alias("runner_up_value"),
    )
    hhi = sums.agg(F.sum(share * share).alias("h")).scalar()
    gap = F.col("leader_value") - F.col("runner_up_value")
    return (
        pair.withColumn("gap", gap)
        .withColumn("gap_pct", gap / (F.col("runner_up_value") + 1e-9))
        .withColumn("top_share", F.when(whole > 0, F.col("leader_value") / whole))
        .withColumn("hhi", hhi)
        .withColumn(
            "band",
            F.when(F.col("hhi") >= 0.20, "concentrated")
            .when(F.col("hhi") <= 0.10, "fragmented")
            .otherwise("moderate"),
        )
    )


def best_yoy(df: DataFrame, dim: str, yoy: str = "value_yoy") -> DataFrame:
    """The item with the greatest growth; the first by name on ties."""
    seen = df.filter(F.col(yoy).isNotNull())
    best = top_rows(seen, [F.desc(yoy), F.asc(dim)], 1)
    return best.select(F.col(dim).alias("label"), F.col(yoy).alias("yoy_pct"))


def run_rate(df: DataFrame, window: MonthWindow, measure: str = "value_sales") -> DataFrame:
    """Total in the window, its number of months, and the mean per month."""
    inside = df.filter(window.has("date"))
    months = months_inclusive(window.start, window.end)
    return (
        grouped_sum(inside, [], measure)
        .withColumnRenamed(measure, "total")
        .withColumn("months", months)
        .withColumn("avg_per_month", F.col("total") / F.col("months"))
    )


def histogram(df: DataFrame, by: list[str], col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins per group between its least and greatest value, with density.

    Every bin is returned, empty ones with count 0. The last bin includes its right edge.
    """
    df = df.filter(F.col(col).isNotNull())
    span = df.groupBy(*by).agg(
        F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n")
    )
    # A group with one value gets a unit-wide range around it.
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "n",
    )
    width = (F.col("hi") - F.col("lo")) / bins
    placed = same_keys(df.select(*by, F.col(col).alias("x")), span, by).select(
        *by,
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))
        .cast("int")
        .alias("bin"),
    )
    counts = placed.groupBy(*by, "bin").agg(F.count("*").alias("count"))
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = same_keys(frame, counts, [*by, "bin"], "left")
    count = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    return full.select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        count.alias("count"),
        (count / (F.col("n") * width)).alias("density"),
    )


def box_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Least, quartiles, greatest and the 1.5 x IQR whisker ends, per group."""
    q = exact_quantiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    inside = same_keys(df.filter(F.col(col).isNotNull()), q, by)
    iqr = F.col("q3") - F.col("q1")
    x = F.col(col)
    return inside.groupBy(*by, "q1", "median", "q3").agg(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.min(F.when(x >= F.col("q1") - 1.5 * iqr, x)).alias("whisker_lo"),
        F.max(F.when(x <= F.col("q3") + 1.5 * iqr, x)).alias("whisker_hi"),
    )


def series_points(df: DataFrame, category: str | None, y: str) -> DataFrame:
    """One row per category with its monthly points in time order.

    Rows are summed to months first, so a list is never longer than the calendar.
    """
    keys = [category] if category else []
    by_month = df.groupBy(*keys, month_start("date").alias("month")).agg(exact_sum(df, y).alias("y"))
    point = F.struct("month", F.date_format("month", "MMM yyyy").alias("x"), F.round("y", 4).alias("y"))
    points = F.array_sort(F.collect_list(point))
    grouped = by_month.groupBy(F.col(category).alias("name")) if category else by_month.groupBy()
    out = grouped.agg(points.alias("points"))
    return out if category else out.select(F.lit("Overall").alias("name"), "points")


def entities(df: DataFrame, page_size: int = 1000) -> DataFrame:
    """Categories with their sorted distinct brands, in pages (from 1) of at most `page_size` brands."""
    pairs = df.select("category", "brand").filter(F.col("brand").isNotNull()).distinct()
    numbered = with_rank(pairs, ["category"], "brand", descending=False)
    page = (F.floor((F.col("rank") - 1) / page_size) + 1).alias("page")
    return numbered.groupBy("category", page).agg(F.array_sort(F.collect_list("brand")).alias("brands"))


def share_of_total(df: DataFrame, dims, measure: str = "value_sales") -> DataFrame:
    """Group sums with their share of the whole."""
    sums = grouped_sum(df, dims, measure)
    whole = sums.agg(exact_sum(sums, measure).alias("t")).scalar()
    return sums.withColumn("share", ratio(F.col(measure), whole))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in the given order.

    Spark turns `row_number() == 1` into a group limit: each task keeps only its own
    first row per key before the shuffle, so a large group does not meet in one task.
    """
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", best).filter(F.col("__rn") == 1).drop("__rn")

"""Period comparisons: year on year, month on month, moving annual totals.

Every comparison reads the data once: a row adds to each window that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_start
from salesgrid.functions.sums import as_exact, exact_sum, growth, present, same_keys
from salesgrid.operators.agg import first_per_key
from salesgrid.operators.filters import apply_filters, safe_numeric_fill
from salesgrid.operators.spread import top_rows, with_rank
from salesgrid.operators.windows import (
    MonthWindow,
    mat_period,
    prev_year_window,
    ytd_period,
)
from salesgrid.sources.files import stored


def _growth_name(measure: str, kind: str) -> str:
    return ("unit" if measure.startswith("unit") else "value") + "_" + kind


def two_windows(
    df: DataFrame, dims, measure: str, curr: MonthWindow, prev: MonthWindow, keep_either=False
) -> DataFrame:
    """Sums of both windows per group in one pass.

    A group is kept if the current window has one of its rows (the left join of the
    two sums); with `keep_either`, if any of the two has.
    """
    dims = present(df, dims)
    inside = df.filter(curr.has("date") | prev.has("date"))
    in_curr, in_prev = curr.has("date"), prev.has("date")
    value = as_exact(df, measure)
    aggs = [
        F.sum(F.when(in_curr, value)).cast("double").alias("__c"),
        F.sum(F.when(in_prev, value)).cast("double").alias("__p"),
        F.count(F.when(in_curr, 1)).alias("__nc"),
        F.count(F.when(in_prev, 1)).alias("__np"),
    ]
    out = inside.groupBy(*dims).agg(*aggs) if dims else inside.agg(*aggs)
    kept = (F.col("__nc") > 0) | (F.col("__np") > 0) if keep_either else F.col("__nc") > 0

    def held(n: str, v: str) -> Column:
        # A window with rows but only null values sums to 0; one without rows is null.
        return F.when(F.col(n) > 0, F.coalesce(F.col(v), F.lit(0.0)))

    return out.filter(kept).select(
        *dims,
        held("__nc", "__c").alias(f"{measure}_curr"),
        held("__np", "__p").alias(f"{measure}_prev"),
    )


def yoy(
    df: DataFrame,
    dims,
    measure: str,
    window: MonthWindow,
    n: int | None = None,
    prev: MonthWindow | None = None,
) -> DataFrame:
    """Growth against the same months a year earlier; null where there is no base.

    With `n`, the n best groups (one per brand), largest growth first.
    """
    dims = present(df, dims)
    name = _growth_name(measure, "yoy")
    both = two_windows(df, dims, measure, window, prev or prev_year_window(window), not dims)
    curr, base = F.col(f"{measure}_curr"), F.col(f"{measure}_prev")
    out = both.withColumn(name, growth(curr, base))
    if n is None:
        return out
    order = [F.desc_nulls_last(name), *[F.asc_nulls_last(d) for d in dims]]
    if "brand" in dims and len(dims) > 1:
        out = first_per_key(out, ["brand"], order)
    return top_rows(out, order, n)


def monthly_sums(df: DataFrame, dims, measure: str, window: MonthWindow | None) -> DataFrame:
    inside = df.filter(window.has("date")) if window is not None else df
    return inside.groupBy(month_start("date").alias("date"), *present(df, dims)).agg(
        exact_sum(df, measure).alias(measure)
    )


def mom(df: DataFrame, dims, measure: str, window: MonthWindow | None = None) -> DataFrame:
    """Monthly sums per group with the change to the group's preceding month row.

    A series holds one row per month, so its window stays as short as the calendar.
    """
    dims = present(df, dims)
    series = Window.partitionBy(*dims).orderBy("date")
    name = _growth_name(measure, "mom")
    out = monthly_sums(df, dims, measure, window)
    out = out.withColumn(f"{measure}_prev", F.lag(measure).over(series))
    return out.withColumn(name, growth(F.col(measure), F.col(f"{measure}_prev")))


def mom_top_n(df: DataFrame, dims, measure: str, window: MonthWindow | None, n: int) -> DataFrame:
    """The monthly change series of the n groups that grew best in the last month."""
    dims = present(df, dims)
    name = _growth_name(measure, "mom")
    series = mom(df, dims, measure, window)
    last = series.agg(F.max("date").alias("m")).scalar()
    order = [F.desc_nulls_last(name), *[F.asc_nulls_last(d) for d in dims]]
    best = top_rows(series.filter(F.col("date") == last), order, n).select(*dims)
    return semi_on_keys(series, best, dims)


def semi_on_keys(df: DataFrame, keys: DataFrame, dims) -> DataFrame:
    """Rows whose keys occur in `keys`, null keys included."""
    right = keys.select(*[F.col(d).alias(f"__{d}") for d in dims])
    on = [df[d].eqNullSafe(right[f"__{d}"]) for d in dims]
    return df.join(right, on, "left_semi")


def mom_rows(df: DataFrame, measure: str, window: MonthWindow | None = None) -> DataFrame:
    """Row-level change inside a brand: each fact row against the brand's row before it.

    Rows are ordered by date, market, channel, category. Missing values are padded
    forward first; undefined changes give 0. One brand may hold much of the fact, so
    a brand is cut at its months, and each month starts from what the earlier ones
    ended with.
    """
    rows = df.filter(window.has("date")) if window is not None else df
    name = _growth_name(measure, "mom")
    keys = ["brand", "date"]
    order = ["market", "channel", "category"]
    cut = Window.partitionBy(*keys).orderBy(*order)
    so_far = cut.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("date", *order, "brand", F.col(measure).alias("__x"))
    rows = rows.withColumn("__f", F.last("__x", ignorenulls=True).over(so_far))
    rows = rows.withColumn("__pf", F.lag("__f").over(cut))
    ends = rows.groupBy(*keys).agg(
        F.max_by("__x", F.when(F.col("__x").isNotNull(), F.struct(*order))).alias("__end")
    )
    earlier = Window.partitionBy("brand").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    out = same_keys(rows, ends, keys)
    curr = F.coalesce("__f", "__carry")
    prev = F.coalesce("__pf", "__carry")
    return out.select(
        "date",
        *order,
        "brand",
        F.coalesce(F.col("__x"), F.lit(0.0)).alias(measure),
        F.coalesce(growth(curr, prev), F.lit(0.0)).alias(name),
    )


def stack_windows(
    df: DataFrame, dims, measure: str, windows: list[tuple[str, MonthWindow]]
) -> DataFrame:
    """Sums per named window and group; a row counts in every window that holds it.

    The windows are a short list given by the caller: one conditional sum each, one
    shuffle for all, and only their months are read.
    """
    dims = present(df, dims)
    value = as_exact(df, measure)
    any_window = F.lit(False)
    aggs = []
    for i, (_, w) in enumerate(windows):
        any_window = any_window | w.has("date")
        aggs += [
            F.sum(F.when(w.has("date"), value)).cast("double").alias(f"__s{i}"),
            F.count(F.when(w.has("date"), 1)).alias(f"__n{i}"),
        ]
    inside = df.filter(any_window)
    sums = inside.groupBy(*dims).agg(*aggs) if dims else inside.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(label).alias("label"),
                w.start.alias("start"),
                w.end.alias("end"),
                F.coalesce(F.col(f"__s{i}"), F.lit(0.0)).alias("s"),
                F.col(f"__n{i}").alias("n"),
            )
            for i, (label, w) in enumerate(windows)
        ]
    )
    one = sums.select(*dims, F.explode(rows).alias("w")).filter("w.n > 0")
    return one.select(
        F.col("w.pos").alias("pos"),
        F.col("w.label").alias("mat_label"),
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        *dims,
        F.col("w.s").alias(measure),
    )


def mat_windows(
    years: list[int], anchor_month: int, last_month: Column | None = None
) -> list[tuple[str, MonthWindow]]:
    """One 12-month window per year, its end clamped to the data's last month if given."""
    out = []
    for year in years:
        stop = mat_period(year, anchor_month)["stop"]
        if last_month is not None:
            stop = F.least(stop, F.add_months(last_month, 1))
        window = MonthWindow(F.add_months(stop, -12), stop, last_month is None)
        out.append((f"MAT {year}", window))
    return out


def mat_compare(
    df: DataFrame,
    years: list[int],
    anchor_month: int,
    dims=(),
    measure: str = "value_sales",
    last_month: Column | None = None,
) -> DataFrame:
    """12-month totals of the listed years by dims; `pos` keeps the listed order."""
    years = list(dict.fromkeys(years))
    return stack_windows(df, dims, measure, mat_windows(years, anchor_month, last_month))


def mat_growth(periods: DataFrame, measure: str = "value_sales") -> DataFrame:
    """Periods ranked by the measure, with growth over the next one and over two (CAGR).

    One row per listed year comes in, so the ranking window is a handful of rows.
    """
    order = Window.orderBy(F.desc_nulls_last(measure), F.asc("mat_label"))
    v, second, third = F.col(measure), F.lead(measure, 1).over(order), F.lead(measure, 2).over(order)
    return periods.select(
        F.row_number().over(order).cast("bigint").alias("rank"),
        "mat_label",
        measure,
        growth(v, second).alias("growth_vs_next"),
        F.when(third > 0, F.pow(v / third, F.lit(0.5)) - 1).alias("cagr_2y"),
    )


def _ranked_yoy(df, category, measure, curr: dict, prev: dict) -> DataFrame:
    df = apply_filters(df, {"category": category})
    window = MonthWindow(curr["start"], curr["stop"])
    before = MonthWindow(prev["start"], prev["stop"])
    both = two_windows(df, ["brand"], measure, window, before, keep_either=True)
    c = F.coalesce(F.col(f"{measure}_curr"), F.lit(0.0))
    p = F.coalesce(F.col(f"{measure}_prev"), F.lit(0.0))
    items = both.select(
        "brand",
        c.alias("curr"),
        p.alias("prev"),
        F.coalesce(growth(c, p), F.lit(0.0)).alias("yoy_pct"),
    )
    return with_rank(items, [], "yoy_pct", tie=("brand",)).select(
        "*",
        curr["label"].alias("curr_label"),
        prev["label"].alias("prev_label"),
        curr["start"].alias("curr_start"),
        curr["end"].alias("curr_end"),
        prev["start"].alias("prev_start"),
        prev["end"].alias("prev_end"),
    )


def mat_yoy(df, category, year: int, anchor_month: int, measure="value_sales") -> DataFrame:
    """Brands of a category ranked by growth of the 12 months ending at the anchor."""
    return _ranked_yoy(
        df, category, measure, mat_period(year, anchor_month), mat_period(year - 1, anchor_month)
    )


def ytd_yoy(df, category, year: int, end_month: int, measure="value_sales") -> DataFrame:
    """Brands of a category ranked by growth of January to the end month."""
    return _ranked_yoy(
        df, category, measure, ytd_period(year, end_month), ytd_period(year - 1, end_month)
    )


def latest_leader(df: DataFrame, dim: str, y: str) -> DataFrame:
    """Leader of the last month, its change to the month before, and the gaps to 2nd and 3rd."""
    sums = df.groupBy(month_start("date").alias("date"), F.col(dim).alias("name")).agg(
        exact_sum(df, y).alias("v")
    )
    last = df.agg(month_start(F.max("date")).alias("m")).scalar()
    before = df.agg(month_start(F.max(F.when(F.col("date") < last, F.col("date")))).alias("m"))
    before = before.scalar()
    top = top_rows(
        sums.filter(F.col("date") == last), [F.desc_nulls_last("v"), F.asc_nulls_last("name")], 3,
        "rank",
    )
    previous = sums.filter(F.col("date") == before).select("name", F.col("v").alias("pv"))
    joined = same_keys(top, previous, ["name"], "left")

    def at(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    one = joined.agg(
        at(1, "name").alias("leader"),
        at(1, "v").alias("value"),
        at(1, "pv").alias("prev_value"),
        at(2, "name").alias("second"),
        at(2, "v").alias("__v2"),
        at(3, "name").alias("third"),
        at(3, "v").alias("__v3"),
    )
    v = F.col("value")
    return one.select(
        last.alias("date"),
        "leader",
        "value",
        "prev_value",
        growth(v, F.col("prev_value")).alias("change"),
        "second",
        (v - F.col("__v2")).alias("gap_to_second"),
        "third",
        (v - F.col("__v3")).alias("gap_to_third"),
    )


def endpoint_delta(df: DataFrame, y: str, keys=(), date: str = "date") -> DataFrame:
    """Relative change from the first to the last point."""
    seen = df.filter(F.col(date).isNotNull())
    aggs = [
        F.min_by(y, date).cast("double").alias("first"),
        F.max_by(y, date).cast("double").alias("last"),
        F.count("*").alias("points"),
    ]
    out = seen.groupBy(*keys).agg(*aggs) if keys else seen.agg(*aggs)
    first, last = F.col("first"), F.col("last")
    change = F.when(F.col("points") >= 2, (last - first) / (F.abs(first) + 1e-9))
    return out.withColumn("delta", change)


def yoy_facts(items: DataFrame, dim: str = "brand") -> DataFrame:
    """Ranked growth items with neighbours' gaps, absolute change, side of the average, counts.

    Items hold `dim`, curr, prev and yoy_pct. Rank 1 is compared with rank 2, every
    other rank with the one above it.
    """
    items = stored(items)  # one row per item, which ranks, neighbours and averages read
    ranked = stored(with_rank(items, [], "yoy_pct", tie=(dim,)))
    whole = items.agg(
        F.struct(
            F.avg("yoy_pct").alias("mean"),
            F.count(F.when(F.col("yoy_pct") > 0, 1)).alias("up"),
            F.count(F.when(F.col("yoy_pct") < 0, 1)).alias("down"),
        ).alias("w")
    ).scalar()
    mean, up, down = (whole.getField(name) for name in ("mean", "up", "down"))
    other = ranked.select(
        F.when(F.col("rank") == 2, F.array(F.lit(1), F.lit(3)))
        .otherwise(F.array((F.col("rank") + 1)))
        .alias("for_rank"),
        F.col("yoy_pct").alias("other_yoy"),
    ).select(F.explode(F.col("for_rank").cast("array<bigint>")).alias("rank"), "other_yoy")
    # Rank 1 must not meet itself: it only serves rank 2.
    out = same_keys(ranked, other, ["rank"], "left")
    return out.select(
        "rank",
        dim,
        "curr",
        "prev",
        "yoy_pct",
        (F.col("yoy_pct") - F.col("other_yoy")).alias("gap"),
        (F.col("curr") - F.col("prev")).alias("abs_change"),
        mean.alias("avg_yoy"),
        F.when(F.col("yoy_pct") >= mean, "above").otherwise("below").alias("vs_avg"),
        up.alias("up_count"),
        down.alias("down_count"),
    )


def share_change(derived: DataFrame, dims) -> DataFrame:
    """Change of share in points over 12 rows, for each series' latest month."""
    latest = F.max_by(F.struct("share", "share_yoy"), "date").alias("s")
    return derived.groupBy(*dims).agg(F.max("date").alias("date"), latest).select(
        *dims,
        "date",
        F.col("s.share").alias("share"),
        F.col("s.share_yoy").alias("share_change_pp"),
    )


def filled(df: DataFrame) -> DataFrame:
    """The presentation form: undefined growth shown as 0."""
    return safe_numeric_fill(df)


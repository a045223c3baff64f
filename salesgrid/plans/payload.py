"""Result payloads per category, computed from the data and written as JSON at the end.

A payload lists the brands of its slice in pages (`page`, from 1) of at most PAGE ranked items, each a
row of its own: a slice of any number of brands makes more rows, not longer ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_iso, month_start
from salesgrid.functions.sums import as_exact, exact_sum, growth, same_keys
from salesgrid.operators import compare
from salesgrid.operators.agg import grouped_sum
from salesgrid.operators.rank import extremes
from salesgrid.operators.spread import with_rank
from salesgrid.operators.windows import MonthWindow, mat_period, prev_year_window, ytd_period
from salesgrid.sources.files import stored

PAGE = 1000  # items of a payload row, at most
KINDS = ("mat_compare", "mat_yoy", "ytd_yoy", "total", "trend")


def _list(*fields) -> Column:
    """An ordered list of the group's items, by their first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _paged(ranked: DataFrame, key: str, page_size: int, *fields) -> DataFrame:
    """One row per page of ranked items, as the ordered list `i` (each item begins with its `rank`)."""
    page = (F.floor((F.col("rank") - 1) / page_size) + 1).cast("int").alias("page")
    return ranked.groupBy(key, page).agg(_list("rank", *fields).alias("i"))


def _payload(df, key, kind, mode, measure, calc, start, end, **blocks) -> DataFrame:
    body = F.struct(
        F.lit(mode).alias("mode"),
        F.lit(measure).alias("measure"),
        F.struct(start.alias("start"), end.alias("end")).alias("window"),
        F.struct(F.col(key)).alias("filters"),
        F.lit(calc).alias("calculation_mode"),
        *[c.alias(n) for n, c in blocks.items()],
    )
    page = F.col("page") if "page" in df.columns else F.lit(1)
    return df.select(
        F.lit(kind).alias("kind"), key, page.cast("int").alias("page"), F.to_json(body).alias("payload")
    )


def mat_payload(df, years, anchor, measure="value_sales", key="category", last=None) -> DataFrame:
    periods = compare.mat_compare(df, years, anchor, [key], measure, last)
    best = Window.partitionBy(key).orderBy(F.desc(measure), F.asc("mat_label"))
    periods = periods.withColumn("rank", F.row_number().over(best))
    one = periods.groupBy(key).agg(
        _list("rank", "mat_label", "start", "end", F.col(measure).alias("value")).alias("p"),
        F.min("start").alias("s"),
        F.max("end").alias("e"),
    )
    info = F.struct(
        F.lit(anchor).alias("anchor_month"),
        F.array(*[F.lit(y) for y in years]).alias("years"),
        F.col("p").alias("periods"),
    )
    return _payload(one, key, "mat_compare", "MAT_COMPARE", measure, "mat_compare", F.col("s"),
                    F.col("e"), mat_compare=info)


def yoy_payload(
    df, window: MonthWindow, calc: str, measure="value_sales", key="category", page_size: int = PAGE
) -> DataFrame:
    kind = "unit" if measure.startswith("unit") else "value"
    both = compare.two_windows(df, [key, "brand"], measure, window, prev_year_window(window))
    curr, prev = F.col(f"{measure}_curr"), F.col(f"{measure}_prev")
    items = both.select(
        key, "brand", curr.alias("curr"), prev.alias("prev"),
        F.coalesce(growth(curr, prev), F.lit(0.0)).alias("yoy_pct"),
    )
    ranked = with_rank(stored(items), [key], "yoy_pct", tie=("brand",))
    one = _paged(ranked, key, page_size, "brand", "curr", "prev", "yoy_pct")
    block = F.struct(F.lit(kind).alias("measure_type"), F.col("i").alias("items"))
    return _payload(one, key, calc, "BAR", f"{kind}_yoy", calc, window.start, window.end, yoy=block)


def total_payload(df, window: MonthWindow, measure="value_sales", key="category") -> DataFrame:
    sums = grouped_sum(df.filter(window.has("date")), [key], measure)
    item = F.struct(F.lit(1).alias("rank"), F.col(key).alias("label"), F.col(measure).alias("value"))
    bar = F.struct(F.lit(key).alias("x"), F.lit(measure).alias("y"), F.array(item).alias("items"))
    return _payload(sums, key, "total", "BAR", measure, f"total {measure}", window.start,
                    window.end, bar=bar)


def trend_payload(
    df, window: MonthWindow, measure="value_sales", key="category", page_size: int = PAGE
) -> DataFrame:
    inside = df.filter(window.has("date"))
    points = inside.groupBy(key, "brand", "date").agg(exact_sum(inside, measure).alias(measure))

    def end(side: str) -> Column:
        return F.struct(
            F.col(f"{side}_value").alias("value"),
            month_iso(f"{side}_date").alias("period"),
            F.col(f"{side}_label").alias("label"),
        ).alias(side)

    each = with_rank(stored(extremes(points, [key, "brand"], measure)), [key], "brand", descending=False)
    brands = _paged(each, key, page_size, "brand", end("min"), end("max"))
    overall = extremes(points, [key], measure).select(key, F.struct(end("min"), end("max")).alias("o"))
    block = F.struct(
        F.lit(measure).alias("measure"), F.col("i").alias("by_brand"), F.col("o").alias("overall")
    )
    return _payload(same_keys(brands, overall, [key]), key, "trend", "LINE", measure, "trend",
                    window.start, window.end, trend=block)


def build_payloads(
    df: DataFrame, years: list[int], anchor: int, window: MonthWindow, measure="value_sales",
    key="category", last: Column | None = None, kinds=KINDS, page_size: int = PAGE,
) -> DataFrame:
    """Every slice of `key` in the forms of `kinds`: MAT comparison, MAT and YTD growth, total, trend.

    The lines are summed to (month, slice, brand) and stored once; all forms read that table.
    """
    monthly = stored(
        df.groupBy(month_start("date").alias("date"), key, "brand").agg(F.sum(as_exact(df, measure)).alias(measure))
    )
    mat, ytd = mat_period(max(years), anchor), ytd_period(max(years), anchor)
    forms = {
        "mat_compare": lambda: mat_payload(monthly, years, anchor, measure, key, last),
        "mat_yoy": lambda: yoy_payload(monthly, MonthWindow(mat["start"], mat["stop"]), "mat_yoy", measure, key, page_size),
        "ytd_yoy": lambda: yoy_payload(monthly, MonthWindow(ytd["start"], ytd["stop"]), "ytd_yoy", measure, key, page_size),
        "total": lambda: total_payload(monthly, window, measure, key),
        "trend": lambda: trend_payload(monthly, window, measure, key, page_size),
    }
    return reduce(DataFrame.unionByName, [forms[k]() for k in KINDS if k in kinds])


def payload_mode(df: DataFrame, mode: str | None = None, col: str = "payload") -> DataFrame:
    """Add the payload's `calculation_mode`; with `mode`, only the payloads that have it."""
    out = df.withColumn("calculation_mode", F.get_json_object(col, "$.calculation_mode"))
    return out if mode is None else out.filter(F.col("calculation_mode") == mode)

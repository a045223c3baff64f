"""Queries of the window, aggregation, comparison and ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesgrid.operators import agg, compare, filters, rank
from salesgrid.operators import windows as win
from salesgrid.plans.registry import AS_OF, BOUNDS, FACT, LINES, mean_sql, query, total_sql
from salesgrid.sources.fact import DIMS, calendar, fact, months, sales_lines
from salesgrid.sources.ingest import derive_fields

V = "CAST(sum(v) AS DOUBLE)"
U = "CAST(sum(u) AS DOUBLE)"
MAT = "date BETWEEN end_m - INTERVAL 11 MONTH AND end_m"
MAT_PREV = "date BETWEEN end_m - INTERVAL 23 MONTH AND end_m - INTERVAL 12 MONTH"
YTD = "date BETWEEN date_trunc('year', end_m) AND end_m"
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def window(spark, folder, mode, **kw):
    return win.resolve_window(months(spark, folder), mode, as_of=AS_OF, **kw)


def year_on_year(spark, folder, dims, mode="MAT"):
    """A window, and the lines of it and of the same months a year earlier."""
    w = window(spark, folder, mode)
    return w, sales_lines(spark, folder, dims, win.with_prev_year(w))


MAT_YEARS = [1999, 2000, 2001, 2002]


def mat_compared(spark, folder, dims, measure="value_sales"):
    """The MAT periods of MAT_YEARS up to September; only their months are read."""
    last = win.last_month(months(spark, folder))
    span = win.hull(*[w for _, w in compare.mat_windows(MAT_YEARS, 9, last)])
    lines = sales_lines(spark, folder, tuple(dims), span)
    return compare.mat_compare(lines, MAT_YEARS, 9, dims, measure, last)


def flagship(spark, folder):
    """Top five brands of a category by value over the moving annual total."""
    mat = window(spark, folder, "MAT")
    lines = filters.apply_filters(
        sales_lines(spark, folder, ("category", "brand"), mat), {"category": " economy "}
    )
    return agg.top_n(lines, "brand", "value_sales", 5)


FLAGSHIP_SQL = f"""WITH {LINES}, {BOUNDS} SELECT brand, {V} AS value_sales FROM lines, b
WHERE {MAT} AND category = 'ECONOMY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""

query("Q0_mat_top_brands", FLAGSHIP_SQL)(flagship)


# ---- B: filters and windows -----------------------------------------------------------


@query(
    "B1_apply_filters",
    f"""WITH {FACT} SELECT date, market, channel, category, brand, value_sales FROM fact
    WHERE market IN ('ASIA', 'EUROPE') AND category = 'PROMO'""",
)
def b1(spark, folder):
    wanted = {"market": [" asia", "Europe ", ""], "category": "promo", "channel": None, "planet": "x"}
    rows = filters.apply_filters(fact(spark, folder), wanted)
    return rows.select("date", *DIMS, "value_sales")


@query(
    "B2_in_window",
    f"""WITH {LINES} SELECT date, {V} AS value_sales FROM lines
    WHERE date BETWEEN DATE '1998-03-01' AND DATE '1999-02-01' GROUP BY 1""",
)
def b2(spark, folder):
    span = win.MonthWindow.of("1998-03-01", "1999-03-01")
    rows = win.in_window(sales_lines(spark, folder, (), span), span)
    return agg.grouped_sum(rows, ["date"], "value_sales")


def _window_query(spark, folder, mode, **kw):
    w = window(spark, folder, mode, **kw)
    lines = sales_lines(spark, folder, ("brand",), w)
    out = agg.grouped_sum(lines, ["brand"], "value_sales")
    return out.select("brand", "value_sales", w.start.alias("start"), w.end.alias("end_day"))


def _window_sql(cond, start, end):
    return f"""WITH {LINES}, {BOUNDS} SELECT brand, {V} AS value_sales,
    CAST({start} AS DATE) AS start, CAST({end} AS DATE) AS end_day FROM lines, b
    WHERE {cond} GROUP BY ALL"""


@query("B3_window_all", _window_sql("date BETWEEN first_m AND last_m", "first_m", "last_day(last_m)"))
def b3(spark, folder):
    return _window_query(spark, folder, "ALL")


@query("B4_window_mat", _window_sql(MAT, "end_m - INTERVAL 11 MONTH", "last_day(end_m)"))
def b4(spark, folder):
    return _window_query(spark, folder, "MAT")


@query("B5_window_ytd", _window_sql(YTD, "date_trunc('year', end_m)", "last_day(end_m)"))
def b5(spark, folder):
    return _window_query(spark, folder, "YTD")


@query(
    "B6_window_range",
    _window_sql(
        "date BETWEEN DATE '2001-03-01' AND least(DATE '2030-06-01', last_m)",
        "DATE '2001-03-01'", "last_day(least(DATE '2030-06-01', last_m))",
    ),
)
def b6(spark, folder):
    return _window_query(spark, folder, None, start="2001-03", end="2030-06")


@query(
    "B7_prev_year_window",
    f"""WITH {LINES}, {BOUNDS} SELECT brand, {V} AS value_sales,
    CAST(end_m - INTERVAL 23 MONTH AS DATE) AS start,
    last_day(CAST(end_m - INTERVAL 12 MONTH AS DATE)) AS end_day
    FROM lines, b WHERE {MAT_PREV} GROUP BY ALL""",
)
def b7(spark, folder):
    w = win.prev_year_window(window(spark, folder, "MAT"))
    out = agg.grouped_sum(sales_lines(spark, folder, ("brand",), w), ["brand"], "value_sales")
    return out.select("brand", "value_sales", w.start.alias("start"), w.end.alias("end_day"))


@query("B8_last_12_months", _window_sql(MAT, "end_m - INTERVAL 11 MONTH", "last_day(end_m)"))
def b8(spark, folder):
    return _window_query(spark, folder, "MAT")


@query(
    "B9_anchored_periods",
    f"""WITH {LINES} SELECT DISTINCT y AS year, 'MAT ' || y AS mat_label,
    CAST(make_date(y, 9, 1) - INTERVAL 11 MONTH AS DATE) AS mat_start,
    last_day(make_date(y, 9, 1)) AS mat_end, 'YTD ' || y AS ytd_label,
    make_date(y, 1, 1) AS ytd_start, last_day(make_date(y, 6, 1)) AS ytd_end
    FROM (SELECT year(date) AS y FROM lines)""",
)
def b9(spark, folder):
    years = calendar(spark, folder).select(F.year("date").alias("year")).distinct()
    mat, ytd = win.mat_period(F.col("year"), 9), win.ytd_period(F.col("year"), 6)
    return years.select(
        F.col("year").cast("bigint").alias("year"),
        mat["label"].alias("mat_label"), mat["start"].alias("mat_start"),
        mat["end"].alias("mat_end"), ytd["label"].alias("ytd_label"),
        ytd["start"].alias("ytd_start"), ytd["end"].alias("ytd_end"),
    )


@query(
    "B10_safe_numeric_fill",
    f"""WITH {FACT} SELECT brand, date, coalesce(value_sales / nullif(unit_sales - 20, 0), 0)
    AS per_unit, coalesce(CASE WHEN unit_sales > 30 THEN value_sales END, 0) AS big
    FROM fact""",
)
def b10(spark, folder):
    rows = fact(spark, folder)
    per = F.col("value_sales") / F.when(F.col("unit_sales") != 20, F.col("unit_sales") - 20)
    per = F.when(F.col("unit_sales") == 20, F.lit(float("inf"))).otherwise(per)
    big = F.when(F.col("unit_sales") > 30, F.col("value_sales"))
    return filters.safe_numeric_fill(rows.select("brand", "date", per.alias("per_unit"), big.alias("big")))


@query(
    "B11_filter_labels",
    f"""WITH {LINES} SELECT 'PROMO' AS category, 'ASIA, EUROPE' AS market, {V} AS value_sales
    FROM lines WHERE category = 'PROMO' AND market IN ('ASIA', 'EUROPE')""",
)
def b11(spark, folder):
    wanted = {"category": "PROMO", "market": ["ASIA", "EUROPE"]}
    rows = filters.apply_filters(sales_lines(spark, folder, ("category", "market")), wanted)
    return filters.with_filter_labels(agg.grouped_sum(rows, [], "value_sales"), wanted)


@query(
    "B12_month_labels",
    f"""WITH {LINES} SELECT date, {V} AS value_sales, strftime(date, '%b %Y') AS month_label,
    strftime(date, '%Y-%m') AS month_iso FROM lines GROUP BY date""",
)
def b12(spark, folder):
    rows = agg.grouped_sum(sales_lines(spark, folder, ()), ["date"], "value_sales")
    return filters.with_month_labels(rows)


@query(
    "B13_parse_month",
    f"""WITH {LINES} SELECT t AS text, date AS month, count(*) AS n FROM (SELECT date,
    CASE month(date) % 3 WHEN 0 THEN strftime(date, '%b %Y') WHEN 1 THEN strftime(date, '%Y-%m-%d')
    ELSE strftime(date, '%Y-%m') END AS t FROM lines) GROUP BY ALL""",
)
def b13(spark, folder):
    from salesgrid.functions.dates import parse_month

    kind = F.month("date") % 3
    text = (
        F.when(kind == 0, F.date_format("date", "MMM yyyy"))
        .when(kind == 1, F.date_format("date", "yyyy-MM-dd"))
        .otherwise(F.date_format("date", "yyyy-MM"))
    )
    rows = calendar(spark, folder).select(text.alias("text"))
    return rows.select("text", parse_month("text").alias("month")).groupBy("text", "month").agg(
        F.count("*").alias("n")
    )


@query(
    "B14_focus",
    f"WITH {LINES} SELECT date, {V} AS value_sales FROM lines WHERE brand = 'Brand#7' GROUP BY 1",
)
def b14(spark, folder):
    rows = filters.focus(sales_lines(spark, folder, ("brand",)), "brand", "Brand#7")
    return agg.grouped_sum(rows, ["date"], "value_sales")


@query(
    "B15_tail_points",
    f"""WITH {LINES} SELECT date, brand, {V} AS value_sales FROM lines GROUP BY 1, 2
    ORDER BY date DESC, brand LIMIT 200""",
)
def b15(spark, folder):
    rows = agg.grouped_sum(sales_lines(spark, folder, ("brand",)), ["date", "brand"], "value_sales")
    return filters.tail_points(rows, 200, tie=("brand",))


@query(
    "B16_melt_measures",
    f"""WITH {LINES}, m AS (SELECT date, {V} AS value_sales, {U} AS unit_sales FROM lines GROUP BY 1)
    SELECT date, 'value_sales' AS measure, value_sales AS value FROM m
    UNION ALL SELECT date, 'unit_sales', unit_sales FROM m""",
)
def b16(spark, folder):
    rows = agg.monthly(sales_lines(spark, folder, ()), []).withColumnRenamed("month", "date")
    return filters.melt_measures(rows, ["date"], ["value_sales", "unit_sales"])


# ---- C: aggregations ------------------------------------------------------------------


@query(
    "C1_aggregate",
    f"WITH {LINES} SELECT category, brand, {V} AS value_sales FROM lines GROUP BY 1, 2",
)
def c1(spark, folder):
    lines = sales_lines(spark, folder, ("category", "brand"))
    return agg.aggregate(lines, ["category", "brand", "segment"], "value_sales")


@query("C2_grand_total", f"WITH {LINES} SELECT {V} AS value_sales FROM lines HAVING count(*) > 0")
def c2(spark, folder):
    return agg.aggregate(sales_lines(spark, folder, ()), [], "value_sales")


@query(
    "C2b_total_of_nothing",
    f"WITH {LINES} SELECT {V} AS value_sales FROM lines WHERE date < DATE '1900-01-01' HAVING count(*) > 0",
)
def c2b(spark, folder):
    rows = sales_lines(spark, folder, ()).filter(F.col("date") < F.lit("1900-01-01").cast("date"))
    return agg.aggregate(rows, [], "value_sales")


@query(
    "C3_top_n",
    f"""WITH {LINES}, {BOUNDS} SELECT brand, {U} AS unit_sales FROM lines, b WHERE {YTD}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7""",
)
def c3(spark, folder):
    lines = sales_lines(spark, folder, ("brand",), window(spark, folder, "YTD"))
    return agg.top_n(lines, "brand", "unit_sales", 7)


@query(
    "C4_top_n_without_dim",
    f"""WITH {LINES}, {BOUNDS} SELECT 'LARGE' AS category, {V} AS value_sales FROM lines, b
    WHERE {MAT} AND category = 'LARGE'""",
)
def c4(spark, folder):
    wanted = {"category": "LARGE"}
    lines = sales_lines(spark, folder, ("category",), window(spark, folder, "MAT"))
    lines = filters.apply_filters(lines, wanted)
    return agg.top_n_or_total(lines, ["date", "category"], "value_sales", 5, wanted)


@query(
    "C5_total_chart",
    f"""WITH {LINES} SELECT date, brand, {V} AS value_sales FROM lines
    WHERE brand IN ('Brand#1', 'Brand#2') GROUP BY 1, 2""",
)
def c5(spark, folder):
    wanted = {"brand": ["Brand#1", "Brand#2"]}
    lines = filters.apply_filters(sales_lines(spark, folder, ("brand",)), wanted)
    return agg.total(lines, "value_sales", ["date"], wanted, task="chart", brand_group=True)


@query(
    "C5b_total_pruned",
    f"WITH {LINES} SELECT market, {V} AS value_sales FROM lines GROUP BY 1",
)
def c5b(spark, folder):
    lines = sales_lines(spark, folder, ("market", "brand"))
    return agg.total(lines, "value_sales", ["date", "brand", "market"])


@query(
    "C6_bar_items",
    f"""WITH {LINES} SELECT row_number() OVER (ORDER BY {V} DESC, brand) AS rank, brand AS label,
    {V} AS value FROM lines GROUP BY brand""",
)
def c6(spark, folder):
    return agg.bar_items(sales_lines(spark, folder, ("brand",)), "brand", "value_sales")


@query(
    "C7_monthly",
    f"""WITH {FACT} SELECT date AS month, category, brand, {total_sql('value_sales')} AS value_sales,
    {total_sql('unit_sales')} AS unit_sales, {mean_sql('share', 6)} AS share FROM fact GROUP BY 1, 2, 3""",
)
def c7(spark, folder):
    return agg.monthly(fact(spark, folder), ["category", "brand"], share_mean=True)


@query(
    "C9_brand_by_category",
    f"WITH {LINES} SELECT brand, category, {U} AS unit_sales FROM lines GROUP BY 1, 2",
)
def c9(spark, folder):
    lines = sales_lines(spark, folder, ("category", "brand"))
    return agg.aggregate(lines, ["brand", "category"], "unit_sales")


@query(
    "C10_sum_slice",
    f"""WITH {LINES} SELECT coalesce({V}, 0) AS value_sales FROM lines WHERE category = 'SMALL'
    AND brand = 'Brand#3' AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""",
)
def c10(spark, folder):
    lines = sales_lines(spark, folder, ("category", "brand"))
    return agg.sum_slice(lines, "small", "brand#3", "1999-01-01", "1999-12-31")


@query(
    "C11_describe",
    f"""WITH {FACT}, l AS (SELECT 'value_sales' AS measure, value_sales AS x FROM fact
      UNION ALL SELECT 'unit_sales', unit_sales FROM fact)
    SELECT measure, count(x) AS count, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std,
    min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.25), 6) AS q25,
    round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75
    FROM l GROUP BY 1""",
)
def c11(spark, folder):
    out = agg.describe(fact(spark, folder), ["value_sales", "unit_sales"])
    return out.withColumns({"mean": F.round("mean", 3), "std": F.round("std", 3),
         **{q: F.round(q, 6) for q in ("q25", "q50", "q75")}})


@query(
    "C12_desc_stats",
    f"""WITH {FACT} SELECT category, market, round(avg(value_sales), 3) AS mean,
    min(value_sales) AS min, max(value_sales) AS max, round(stddev_samp(value_sales), 3) AS std,
    round(stddev_samp(value_sales) / avg(value_sales), 6) AS cv,
    round(skewness(value_sales), 6) AS skew, round(kurtosis(value_sales), 6) AS kurtosis,
    round(quantile_cont(value_sales, 0.5), 6) AS median FROM fact GROUP BY 1, 2""",
)
def c12(spark, folder):
    out = agg.desc_stats(fact(spark, folder), ["category", "market"], "value_sales")
    places = {"mean": 3, "std": 3, "median": 6, "cv": 6, "skew": 6, "kurtosis": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    "C13_skew_table",
    f"""WITH {FACT}, m AS (SELECT date, category, market, brand, {total_sql('value_sales')} AS v2,
      {total_sql('unit_sales')} AS u2, avg(share) AS s2 FROM fact GROUP BY 1, 2, 3, 4)
    SELECT 'value_sales' AS measure, round(skewness(v2), 6) AS skew FROM m
    UNION ALL SELECT 'unit_sales', round(skewness(u2), 6) FROM m
    UNION ALL SELECT 'share', round(skewness(s2), 6) FROM m""",
)
def c13(spark, folder):
    rows = agg.monthly(fact(spark, folder), ["category", "market", "brand"], share_mean=True)
    out = agg.skew_table(rows, ["value_sales", "unit_sales", "share"])
    return out.withColumn("skew", F.round("skew", 6))


@query(
    "C14_corr_matrix",
    "WITH " + FACT + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM fact"
        for a in ("value_sales", "unit_sales", "share")
        for b in ("value_sales", "unit_sales", "share")
    ),
)
def c14(spark, folder):
    out = agg.corr_matrix(fact(spark, folder), ["value_sales", "unit_sales", "share"])
    return out.withColumn("corr", F.round("corr", 6))


@query(
    "C15_seasonality",
    f"""WITH {FACT} SELECT category, market, date AS month, {mean_sql('value_sales')}
    AS avg_value_sales, {mean_sql('unit_sales')} AS avg_unit_sales FROM fact GROUP BY 1, 2, 3""",
)
def c15(spark, folder):
    return agg.seasonality(fact(spark, folder).withColumnRenamed("date", "month"))


@query(
    "C15b_seasonality_calendar",
    f"""WITH {FACT} SELECT category, market, CAST(month(date) AS INTEGER) AS month_num,
    {mean_sql('value_sales')} AS avg_value_sales, {mean_sql('unit_sales')} AS avg_unit_sales
    FROM fact GROUP BY 1, 2, 3""",
)
def c15b(spark, folder):
    rows = fact(spark, folder).withColumnRenamed("date", "month")
    return agg.seasonality(rows, calendar_month=True)


@query(
    "C16_calendar_month_mean",
    f"""WITH {LINES}, m AS (SELECT date, {V} AS v2 FROM lines GROUP BY 1)
    SELECT CAST(month(date) AS INTEGER) AS month_num, {mean_sql('v2')} AS mean,
    strftime(min(date), '%b') AS month_name FROM m GROUP BY 1""",
)
def c16(spark, folder):
    rows = agg.monthly(sales_lines(spark, folder, ()), [])
    return agg.calendar_month_mean(rows, "value_sales")


@query(
    "C17_pivot_month_brand",
    f"WITH {LINES} SELECT date AS month, "
    + ", ".join(f"CAST(sum(v) FILTER (brand = '{b}') AS DOUBLE) AS \"{b}\"" for b in BRANDS)
    + " FROM lines GROUP BY 1",
)
def c17(spark, folder):
    return agg.pivot_month_brand(sales_lines(spark, folder, ("brand",)))


TWO = """SELECT {dims}, CAST(sum(v) FILTER ({cur}) AS DOUBLE) AS c, CAST(sum(v) FILTER ({prev})
  AS DOUBLE) AS p FROM lines, b GROUP BY {dims} HAVING count(*) FILTER ({cur}) > 0"""


@query(
    "C18_yoy_items",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='category, brand', cur=MAT, prev=MAT_PREV)})
    SELECT category, round(sum(CASE WHEN p <> 0 THEN c / p - 1 END), 6) AS yoy_pct,
    {total_sql('c')} AS curr, {total_sql('p')} AS prev FROM y GROUP BY 1""",
)
def c18(spark, folder):
    mat, lines = year_on_year(spark, folder, ("category", "brand"))
    rows = compare.yoy(lines, ["category", "brand"], "value_sales", mat)
    out = agg.yoy_items(rows, ["category"])
    return out.withColumn("yoy_pct", F.round("yoy_pct", 6))


MATS = f"""p AS (SELECT y, 'MAT ' || y AS mat_label, least(make_date(y, 9, 1), last_m) AS e
  FROM b, (VALUES (1999), (2000), (2001), (2002)) AS years(y))"""


@query(
    "C19_mat_items",
    f"""WITH {LINES}, {BOUNDS}, {MATS} SELECT mat_label AS label, {V} AS total FROM lines, p
    WHERE date BETWEEN e - INTERVAL 11 MONTH AND e GROUP BY 1""",
)
def c19(spark, folder):
    return agg.mat_items(mat_compared(spark, folder, ["brand"]))


@query(
    "C20_compact_summary",
    f"""WITH {LINES}, s AS (SELECT brand, {V} AS x FROM lines GROUP BY 1)
    SELECT 'category' AS block, brand AS name, round(x, 4) AS value FROM s
    UNION ALL SELECT 'total', NULL, round({total_sql('x')}, 4) FROM s
    UNION ALL SELECT 'top', brand, round(x, 4) FROM (SELECT * FROM s ORDER BY x DESC, brand LIMIT 5)""",
)
def c20(spark, folder):
    return agg.compact_summary(sales_lines(spark, folder, ("brand",)), "brand")


@query(
    "C21_concentration",
    f"""WITH {LINES}, s AS (SELECT brand, {V} AS x FROM lines GROUP BY 1),
    t AS (SELECT {total_sql('x')} AS t, sum(x) AS t2 FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY x DESC, brand) AS rn FROM s, t)
    SELECT max(brand) FILTER (rn = 1) AS leader, max(x) FILTER (rn = 1) AS leader_value,
    max(brand) FILTER (rn = 2) AS runner_up, max(x) FILTER (rn = 2) AS runner_up_value,
    round(max(x) FILTER (rn = 1) - max(x) FILTER (rn = 2), 4) AS gap,
    round((max(x) FILTER (rn = 1) - max(x) FILTER (rn = 2)) / max(x) FILTER (rn = 2), 6) AS gap_pct,
    round(max(x) FILTER (rn = 1) / max(t), 6) AS top_share, round(sum((x / t) * (x / t)), 6) AS hhi,
    CASE WHEN sum((x / t) * (x / t)) >= 0.20 THEN 'concentrated'
         WHEN sum((x / t) * (x / t)) <= 0.10 THEN 'fragmented' ELSE 'moderate' END AS band FROM r""",
)
def c21(spark, folder):
    out = agg.concentration(sales_lines(spark, folder, ("brand",)), "brand")
    return out.withColumns(
        {"gap": F.round("gap", 4), "gap_pct": F.round("gap_pct", 6),
         "top_share": F.round("top_share", 6), "hhi": F.round("hhi", 6)}
    )


@query(
    "C22_best_yoy",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='brand', cur=MAT, prev=MAT_PREV)})
    SELECT brand AS label, round(CASE WHEN p <> 0 THEN c / p - 1 END, 6) AS yoy_pct FROM y
    ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1""",
)
def c22(spark, folder):
    mat, lines = year_on_year(spark, folder, ("brand",))
    rows = compare.yoy(lines, ["brand"], "value_sales", mat)
    out = agg.best_yoy(rows, "brand")
    return out.withColumn("yoy_pct", F.round("yoy_pct", 6))


@query(
    "C23_run_rate",
    f"""WITH {LINES}, {BOUNDS} SELECT {V} AS total,
    CAST(datediff('month', date_trunc('year', any_value(end_m)), any_value(end_m)) + 1 AS BIGINT) AS months,
    {V} / (datediff('month', date_trunc('year', any_value(end_m)), any_value(end_m)) + 1)
      AS avg_per_month FROM lines, b WHERE {YTD}""",
)
def c23(spark, folder):
    w = window(spark, folder, "YTD")
    return agg.run_rate(sales_lines(spark, folder, (), w), w)


@query(
    "C24_histogram",
    f"""WITH {FACT}, s AS (SELECT category, min(value_sales) AS lo, max(value_sales) AS hi,
      count(*) AS n FROM fact GROUP BY 1),
    c AS (SELECT f.category, CAST(least(floor((value_sales - lo) / ((hi - lo) / 20)), 19) AS INTEGER)
      AS bin, count(*) AS k FROM fact f JOIN s USING (category) GROUP BY 1, 2),
    g AS (SELECT s.*, CAST(i AS INTEGER) AS bin FROM s, range(20) r(i))
    SELECT category, bin, round(lo + bin * (hi - lo) / 20, 7) AS "left",
    round(lo + (bin + 1) * (hi - lo) / 20, 7) AS "right", coalesce(k, 0) AS count,
    round(1e6 * coalesce(k, 0) / (n * (hi - lo) / 20), 6) AS density_ppm
    FROM g LEFT JOIN c USING (category, bin)""",
)
def c24(spark, folder):
    out = agg.histogram(fact(spark, folder), ["category"], "value_sales", 20)
    return out.select(
        "category", "bin", F.round("left", 7).alias("left"), F.round("right", 7).alias("right"),
        "count", F.round(1e6 * F.col("density"), 6).alias("density_ppm"),
    )


@query(
    "C24b_box_stats",
    f"""WITH {FACT}, q AS (SELECT brand, quantile_cont(value_sales, 0.25) AS q1,
      quantile_cont(value_sales, 0.5) AS median, quantile_cont(value_sales, 0.75) AS q3
      FROM fact GROUP BY 1)
    SELECT brand, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    min(value_sales) AS min, max(value_sales) AS max,
    min(value_sales) FILTER (value_sales >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
    max(value_sales) FILTER (value_sales <= q3 + 1.5 * (q3 - q1)) AS whisker_hi
    FROM fact JOIN q USING (brand) GROUP BY brand, q1, median, q3""",
)
def c24b(spark, folder):
    out = agg.box_stats(fact(spark, folder), ["brand"], "value_sales")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "C25_series_points",
    f"""WITH {LINES}, m AS (SELECT brand, date, {V} AS y FROM lines GROUP BY 1, 2)
    SELECT brand AS name, count(*) AS points, string_agg(strftime(date, '%b %Y') || '=' ||
    CAST(CAST(round(y) AS BIGINT) AS VARCHAR), ';' ORDER BY date) AS text FROM m GROUP BY 1""",
)
def c25(spark, folder):
    out = agg.series_points(sales_lines(spark, folder, ("brand",)), "brand", "value_sales")
    point = F.transform(
        "points", lambda p: F.concat(p["x"], F.lit("="), F.round(p["y"]).cast("bigint").cast("string"))
    )
    return out.select(
        "name", F.size("points").cast("bigint").alias("points"), F.array_join(point, ";").alias("text")
    )


# ---- D: period comparison -------------------------------------------------------------

YOY = "CASE WHEN p <> 0 THEN c / p - 1 END"


@query(
    "D1_yoy",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='category, brand', cur=MAT, prev=MAT_PREV)})
    SELECT category, brand, c AS value_sales_curr, p AS value_sales_prev, round({YOY}, 6) AS value_yoy
    FROM y""",
)
def d1(spark, folder):
    mat, lines = year_on_year(spark, folder, ("category", "brand"))
    out = compare.yoy(lines, ["category", "brand"], "value_sales", mat)
    return out.withColumn("value_yoy", F.round("value_yoy", 6))


@query(
    "D1b_yoy_top_n",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='brand', cur=YTD, prev=YTD.replace('end_m', "(end_m - INTERVAL 12 MONTH)"))})
    SELECT brand, c AS value_sales_curr, coalesce(p, 0) AS value_sales_prev,
    coalesce(round({YOY}, 6), 0) AS value_yoy FROM y ORDER BY {YOY} DESC NULLS LAST, brand LIMIT 5""",
)
def d1b(spark, folder):
    ytd, lines = year_on_year(spark, folder, ("brand",), "YTD")
    out = compare.yoy(lines, ["brand"], "value_sales", ytd, n=5)
    return compare.filled(out.withColumn("value_yoy", F.round("value_yoy", 6)))


@query(
    "D2_yoy_total",
    f"""WITH {LINES}, {BOUNDS}, y AS (SELECT CAST(sum(u) FILTER ({MAT}) AS DOUBLE) AS c,
      CAST(sum(u) FILTER ({MAT_PREV}) AS DOUBLE) AS p FROM lines, b)
    SELECT c AS unit_sales_curr, p AS unit_sales_prev, round({YOY}, 6) AS unit_yoy FROM y""",
)
def d2(spark, folder):
    mat, lines = year_on_year(spark, folder, ())
    out = compare.yoy(lines, [], "unit_sales", mat)
    return out.withColumn("unit_yoy", F.round("unit_yoy", 6))


MOM = """m AS (SELECT brand, date, CAST(sum(v) AS DOUBLE) AS x FROM lines, b WHERE {0} GROUP BY 1, 2),
  g AS (SELECT *, lag(x) OVER (PARTITION BY brand ORDER BY date) AS px FROM m),
  mm AS (SELECT *, CASE WHEN px <> 0 THEN x / px - 1 END AS mom FROM g)"""


@query(
    "D3_mom",
    f"""WITH {LINES}, {BOUNDS}, {MOM.format(MAT)} SELECT date, brand, x AS value_sales,
    px AS value_sales_prev, round(mom, 6) AS value_mom FROM mm""",
)
def d3(spark, folder):
    w = window(spark, folder, "MAT")
    out = compare.mom(sales_lines(spark, folder, ("brand",), w), ["brand"], "value_sales", w)
    return out.withColumn("value_mom", F.round("value_mom", 6))


@query(
    "D4_mom_top_n",
    f"""WITH {LINES}, {BOUNDS}, {MOM.format(MAT)}, k AS (SELECT brand FROM mm
      WHERE date = (SELECT max(date) FROM mm) ORDER BY mom DESC NULLS LAST, brand LIMIT 3)
    SELECT date, brand, x AS value_sales, px AS value_sales_prev, round(mom, 6) AS value_mom
    FROM mm WHERE brand IN (SELECT brand FROM k)""",
)
def d4(spark, folder):
    w = window(spark, folder, "MAT")
    lines = sales_lines(spark, folder, ("brand",), w)
    out = compare.mom_top_n(lines, ["brand"], "value_sales", w, 3)
    return out.withColumn("value_mom", F.round("value_mom", 6))


@query(
    "D5_mom_rows",
    f"""WITH {FACT}, g AS (SELECT *, lag(value_sales) OVER (PARTITION BY brand
      ORDER BY date, market, channel, category) AS px FROM fact)
    SELECT date, market, channel, category, brand, value_sales,
    round(coalesce(CASE WHEN px <> 0 THEN value_sales / px - 1 END, 0), 6) AS value_mom FROM g""",
)
def d5(spark, folder):
    out = compare.mom_rows(fact(spark, folder), "value_sales")
    return out.withColumn("value_mom", F.round("value_mom", 6))


@query(
    "D6_mat_compare",
    f"""WITH {LINES}, {BOUNDS}, {MATS} SELECT mat_label, CAST(e - INTERVAL 11 MONTH AS DATE) AS start,
    last_day(e) AS "end", category, {V} AS value_sales FROM lines, p
    WHERE date BETWEEN e - INTERVAL 11 MONTH AND e GROUP BY mat_label, e, category""",
)
def d6(spark, folder):
    return mat_compared(spark, folder, ["category"]).drop("pos")


@query(
    "D7_mat_growth",
    f"""WITH {LINES}, {BOUNDS}, {MATS}, s AS (SELECT mat_label, {U} AS x FROM lines, p
      WHERE date BETWEEN e - INTERVAL 11 MONTH AND e GROUP BY 1)
    SELECT row_number() OVER w AS rank, mat_label, x AS unit_sales,
    round(x / lead(x) OVER w - 1, 6) AS growth_vs_next,
    round(sqrt(x / lead(x, 2) OVER w) - 1, 6) AS cagr_2y
    FROM s WINDOW w AS (ORDER BY x DESC, mat_label)""",
)
def d7(spark, folder):
    out = compare.mat_growth(mat_compared(spark, folder, [], "unit_sales"), "unit_sales")
    return out.withColumns({c: F.round(c, 6) for c in ("growth_vs_next", "cagr_2y")})


def _ranked_sql(cur, prev, labels, dates):
    return f"""WITH {LINES}, y AS (SELECT brand, coalesce(CAST(sum(v) FILTER (date BETWEEN {cur})
      AS DOUBLE), 0) AS c, coalesce(CAST(sum(v) FILTER (date BETWEEN {prev}) AS DOUBLE), 0) AS p
      FROM lines WHERE category = 'PROMO' AND (date BETWEEN {cur} OR date BETWEEN {prev}) GROUP BY 1),
    z AS (SELECT *, CASE WHEN p <> 0 THEN c / p - 1 ELSE 0 END AS g FROM y)
    SELECT brand, c AS curr, p AS prev, round(g, 6) AS yoy_pct,
    row_number() OVER (ORDER BY g DESC, brand) AS rank, '{labels[0]}' AS curr_label,
    '{labels[1]}' AS prev_label, DATE '{dates[0]}' AS curr_start, DATE '{dates[1]}' AS curr_end,
    DATE '{dates[2]}' AS prev_start, DATE '{dates[3]}' AS prev_end FROM z"""


@query(
    "D8_mat_yoy",
    _ranked_sql(
        "DATE '1999-10-01' AND DATE '2000-09-30'", "DATE '1998-10-01' AND DATE '1999-09-30'",
        ("MAT 2000", "MAT 1999"), ("1999-10-01", "2000-09-30", "1998-10-01", "1999-09-30"),
    ),
)
def d8(spark, folder):
    span = win.with_prev_year(win.MonthWindow.period(win.mat_period(2000, 9), True))
    lines = sales_lines(spark, folder, ("category", "brand"), span)
    out = compare.mat_yoy(lines, "promo", 2000, 9)
    return out.withColumn("yoy_pct", F.round("yoy_pct", 6))


@query(
    "D9_ytd_yoy",
    _ranked_sql(
        "DATE '2000-01-01' AND DATE '2000-06-30'", "DATE '1999-01-01' AND DATE '1999-06-30'",
        ("YTD 2000", "YTD 1999"), ("2000-01-01", "2000-06-30", "1999-01-01", "1999-06-30"),
    ),
)
def d9(spark, folder):
    span = win.with_prev_year(win.MonthWindow.period(win.ytd_period(2000, 6), True))
    lines = sales_lines(spark, folder, ("category", "brand"), span)
    out = compare.ytd_yoy(lines, "promo", 2000, 6)
    return out.withColumn("yoy_pct", F.round("yoy_pct", 6))


@query(
    "D10_latest_leader",
    f"""WITH {LINES}, m AS (SELECT date, category AS n, {V} AS x FROM lines GROUP BY 1, 2),
    d AS (SELECT max(date) AS last_d, max(date) FILTER (date < (SELECT max(date) FROM m)) AS prev_d FROM m),
    r AS (SELECT n, x, row_number() OVER (ORDER BY x DESC, n) AS rn FROM m, d WHERE date = last_d),
    q AS (SELECT n, x FROM m, d WHERE date = prev_d)
    SELECT last_d AS date, a.n AS leader, a.x AS value, q.x AS prev_value,
    round(a.x / q.x - 1, 6) AS change, s.n AS second, round(a.x - s.x, 4) AS gap_to_second,
    t.n AS third, round(a.x - t.x, 4) AS gap_to_third
    FROM d, r a LEFT JOIN q ON q.n = a.n LEFT JOIN r s ON s.rn = 2 LEFT JOIN r t ON t.rn = 3
    WHERE a.rn = 1""",
)
def d10(spark, folder):
    out = compare.latest_leader(sales_lines(spark, folder, ("category",)), "category", "value_sales")
    return out.withColumns(
        {"change": F.round("change", 6), "gap_to_second": F.round("gap_to_second", 4),
         "gap_to_third": F.round("gap_to_third", 4)}
    )


@query(
    "D11_endpoint_delta",
    f"""WITH {LINES}, m AS (SELECT brand, date, {V} AS x FROM lines GROUP BY 1, 2)
    SELECT brand, arg_min(x, date) AS first, arg_max(x, date) AS last, count(*) AS points,
    round((arg_max(x, date) - arg_min(x, date)) / (abs(arg_min(x, date)) + 1e-9), 6) AS delta
    FROM m GROUP BY 1""",
)
def d11(spark, folder):
    rows = agg.grouped_sum(sales_lines(spark, folder, ("brand",)), ["brand", "date"], "value_sales")
    out = compare.endpoint_delta(rows, "value_sales", ["brand"])
    return out.withColumn("delta", F.round("delta", 6))


@query(
    "D12_yoy_facts",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='brand', cur=MAT, prev=MAT_PREV)}),
    z AS (SELECT *, {YOY} AS g FROM y),
    r AS (SELECT *, row_number() OVER (ORDER BY g DESC NULLS LAST, brand) AS rank FROM z)
    SELECT rank, brand, c AS curr, p AS prev, round(g, 6) AS yoy_pct,
    round(CASE WHEN rank = 1 THEN g - lead(g) OVER w ELSE g - lag(g) OVER w END, 6) AS gap,
    round(c - p, 4) AS abs_change, round((SELECT avg(g) FROM z), 6) AS avg_yoy,
    CASE WHEN g >= (SELECT avg(g) FROM z) THEN 'above' ELSE 'below' END AS vs_avg,
    (SELECT count(*) FROM z WHERE g > 0) AS up_count, (SELECT count(*) FROM z WHERE g < 0) AS down_count
    FROM r WINDOW w AS (ORDER BY rank)""",
)
def d12(spark, folder):
    mat, lines = year_on_year(spark, folder, ("brand",))
    rows = compare.yoy(lines, ["brand"], "value_sales", mat)
    items = rows.select("brand", F.col("value_sales_curr").alias("curr"),
                        F.col("value_sales_prev").alias("prev"), F.col("value_yoy").alias("yoy_pct"))
    out = compare.yoy_facts(items)
    return out.withColumns(
        {"yoy_pct": F.round("yoy_pct", 6), "gap": F.round("gap", 6), "avg_yoy": F.round("avg_yoy", 6),
         "abs_change": F.round("abs_change", 4)}
    )


@query(
    "D13_share_change",
    f"""WITH {FACT}, s AS (SELECT *, share - lag(share, 12) OVER (PARTITION BY market, channel,
      category, brand ORDER BY date) AS d FROM fact)
    SELECT market, channel, category, brand, max(date) AS date, arg_max(share, date) AS share,
    round(max_by(struct_pack(d := d), date).d, 6) AS share_change_pp FROM s GROUP BY 1, 2, 3, 4""",
)
def d13(spark, folder):
    out = compare.share_change(derive_fields(fact(spark, folder)), DIMS)
    return out.withColumn("share_change_pp", F.round("share_change_pp", 6))


# ---- E: shares, rolling, extremes, outliers -------------------------------------------


@query(
    "E1_market_share",
    f"""WITH {LINES}, s AS (SELECT category, market, brand, {V} AS value_sales FROM lines GROUP BY 1, 2, 3),
    t AS (SELECT category, market, {total_sql('value_sales')} AS total_sales FROM s GROUP BY 1, 2)
    SELECT category, market, brand, value_sales, total_sales,
    round(100 * (value_sales / total_sales), 6) AS market_share_percent FROM s JOIN t USING (category, market)""",
)
def e1(spark, folder):
    out = rank.market_share(sales_lines(spark, folder, ("market", "category", "brand")))
    return out.withColumn("market_share_percent", F.round("market_share_percent", 6))


@query(
    "E2_category_share",
    f"""WITH {FACT}, t AS (SELECT date, market, channel, category, {total_sql('value_sales')} AS tot
      FROM fact GROUP BY 1, 2, 3, 4)
    SELECT date AS month, market, channel, category, brand, value_sales, unit_sales,
    tot AS cat_total_value, round(100 * (value_sales / tot), 6) AS share
    FROM fact JOIN t USING (date, market, channel, category)""",
)
def e2(spark, folder):
    out = rank.category_share(agg.monthly(sales_lines(spark, folder), list(DIMS)))
    return out.withColumn("share", F.round("share", 6))


@query(
    "E3_pareto",
    f"""WITH {LINES}, s AS (SELECT category, market, brand, {V} AS x FROM lines GROUP BY 1, 2, 3),
    t AS (SELECT *, CAST(sum(CAST(x AS DECIMAL(28,4))) OVER (PARTITION BY category, market) AS DOUBLE) AS tot,
      CAST(sum(CAST(x AS DECIMAL(28,4))) OVER (PARTITION BY category, market ORDER BY x DESC, brand
        ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS run FROM s)
    SELECT category, market, brand, x AS value_sales, tot AS cat_mkt_total,
    round(100 * (x / tot), 6) AS share_pct, round(100 * (run / tot), 6) AS cum_share_pct,
    100 * (run / tot) <= 80 AS in_80 FROM t""",
)
def e3(spark, folder):
    out = rank.pareto(sales_lines(spark, folder, ("market", "category", "brand")))
    return out.withColumns({c: F.round(c, 6) for c in ("share_pct", "cum_share_pct")})


SERIES = """m AS (SELECT date AS month, category, market, brand, CAST(sum(v) AS DOUBLE) AS value_sales
  FROM lines GROUP BY 1, 2, 3, 4)"""


def _series(spark, folder):
    lines = sales_lines(spark, folder, ("market", "category", "brand"))
    return agg.monthly(lines, ["category", "market", "brand"]).drop("unit_sales")


@query(
    "E4_rolling_3",
    f"""WITH {LINES}, {SERIES} SELECT *, round(avg(value_sales) OVER (PARTITION BY category, market,
    brand ORDER BY month ROWS 2 PRECEDING), 6) AS value_sales_roll3 FROM m""",
)
def e4(spark, folder):
    out = rank.rolling_mean(_series(spark, folder), ["category", "market", "brand"], "value_sales")
    return out.withColumn("value_sales_roll3", F.round("value_sales_roll3", 6))


@query(
    "E5_rolling_full_window",
    f"""WITH {LINES}, {SERIES} SELECT *, round(CASE WHEN count(*) OVER w = 6 THEN
    avg(value_sales) OVER w END, 6) AS value_sales_roll6 FROM m
    WINDOW w AS (PARTITION BY category, market, brand ORDER BY month ROWS 5 PRECEDING)""",
)
def e5(spark, folder):
    out = rank.rolling_mean(
        _series(spark, folder), ["category", "market", "brand"], "value_sales", 6, min_periods=6
    )
    return out.withColumn("value_sales_roll6", F.round("value_sales_roll6", 6))


EXT = """x AS (SELECT brand, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1),
  e AS (SELECT brand, lo AS min_value, (SELECT min(date) FROM m WHERE m.brand = x.brand AND m.x = x.lo)
    AS min_date, hi AS max_value, (SELECT min(date) FROM m WHERE m.brand = x.brand AND m.x = x.hi)
    AS max_date FROM x)"""
BY_BRAND = """m AS (SELECT brand, date, CAST(sum(v) AS DOUBLE) AS x FROM lines GROUP BY 1, 2)"""
LABELS = "strftime(min_date, '%b %Y') AS min_label, strftime(max_date, '%b %Y') AS max_label"


def _by_brand(spark, folder):
    lines = sales_lines(spark, folder, ("brand",))
    return agg.grouped_sum(lines, ["brand", "date"], "value_sales")


@query("E6_extremes_by_brand", f"WITH {LINES}, {BY_BRAND}, {EXT} SELECT *, {LABELS} FROM e")
def e6(spark, folder):
    return rank.extremes(_by_brand(spark, folder), ["brand"], "value_sales")


@query(
    "E6b_extremes_overall",
    f"""WITH {LINES}, {BY_BRAND}, e AS (SELECT (SELECT min(x) FROM m) AS min_value,
      (SELECT min(date) FROM m WHERE x = (SELECT min(x) FROM m)) AS min_date,
      (SELECT max(x) FROM m) AS max_value,
      (SELECT min(date) FROM m WHERE x = (SELECT max(x) FROM m)) AS max_date)
    SELECT *, {LABELS} FROM e""",
)
def e6b(spark, folder):
    return rank.extremes(_by_brand(spark, folder), [], "value_sales")


@query(
    "E7_drawdown",
    f"""WITH {LINES}, {BY_BRAND}, {EXT}, c AS (SELECT strftime(min_date, '%b %Y') AS l, count(*) AS n,
      min(min_date) AS d FROM e GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1)
    SELECT *, {LABELS}, round(100 * ((max_value - min_value) / max_value), 6) AS drop_pct,
    (SELECT l FROM c WHERE n >= 2) AS common_trough FROM e""",
)
def e7(spark, folder):
    out = rank.drawdown(_by_brand(spark, folder), "brand", "value_sales")
    return out.withColumn("drop_pct", F.round("drop_pct", 6))


@query(
    "E8_peak_month",
    f"""WITH {LINES} SELECT date AS month, {V} AS value, strftime(date, '%b %Y') AS label FROM lines
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def e8(spark, folder):
    return rank.peak_month(sales_lines(spark, folder, ()), "value_sales")


@query(
    "E9_top_share",
    f"""WITH {LINES}, s AS (SELECT brand, {V} AS x FROM lines GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY x DESC, brand) AS rank FROM s QUALIFY rank <= 10)
    SELECT rank, brand, x AS value_sales, round(x / (SELECT {total_sql('x')} FROM s), 6) AS share_of_total,
    round(x / (SELECT {total_sql('x')} FROM k), 6) AS share_of_top FROM k""",
)
def e9(spark, folder):
    out = rank.top_share(sales_lines(spark, folder, ("brand",)), "brand")
    return out.withColumns({c: F.round(c, 6) for c in ("share_of_total", "share_of_top")})


IQR = """q AS (SELECT category, market, brand, quantile_cont(value_sales, 0.25) AS q1,
  quantile_cont(value_sales, 0.75) AS q3, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT m.*, round(q1 - 1.5 * (q3 - q1), 8) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 8) AS upper_bound
FROM m JOIN q USING (category, market, brand)
WHERE (value_sales < q1 - 1.5 * (q3 - q1) OR value_sales > q3 + 1.5 * (q3 - q1))"""


@query("E10_iqr_outliers", f"WITH {LINES}, {SERIES}, {IQR}")
def e10(spark, folder):
    out = rank.iqr_outliers(_series(spark, folder), ["category", "market", "brand"], monthly=True)
    return out.withColumns({c: F.round(c, 8) for c in ("lower_bound", "upper_bound")})


@query("E11_iqr_outliers_min_points", f"WITH {LINES}, {SERIES}, {IQR} AND n >= 4")
def e11(spark, folder):
    out = rank.iqr_outliers(_series(spark, folder), ["category", "market", "brand"], min_points=4, monthly=True)
    return out.withColumns({c: F.round(c, 8) for c in ("lower_bound", "upper_bound")})


# ---- H: joins and set operations ------------------------------------------------------


def _halves(spark, folder):
    mat, lines = year_on_year(spark, folder, ("category", "brand"))
    curr = agg.grouped_sum(win.in_window(lines, mat), ["category", "brand"], "value_sales")
    prev = win.in_window(lines, win.prev_year_window(mat))
    return curr, agg.grouped_sum(prev, ["category", "brand"], "value_sales")


@query(
    "H1_left_join_null_safe",
    f"""WITH {LINES}, {BOUNDS}, c AS (SELECT nullif(brand, 'Brand#1') AS brand, category, {V} AS c
      FROM lines, b WHERE {MAT} GROUP BY 1, 2),
    p AS (SELECT nullif(brand, 'Brand#1') AS brand, category, {V} AS p FROM lines, b WHERE {MAT_PREV}
      GROUP BY 1, 2)
    SELECT c.category, c.brand, c AS curr, p AS prev FROM c LEFT JOIN p
    ON c.category = p.category AND c.brand IS NOT DISTINCT FROM p.brand""",
)
def h1(spark, folder):
    from salesgrid.functions.sums import same_keys

    curr, prev = _halves(spark, folder)
    hide = F.when(F.col("brand") != "Brand#1", F.col("brand"))
    curr = curr.withColumn("brand", hide).withColumnRenamed("value_sales", "curr")
    prev = prev.withColumn("brand", hide).withColumnRenamed("value_sales", "prev")
    return same_keys(curr, prev, ["category", "brand"], "left")


@query(
    "H2_two_totals_side_by_side",
    f"""WITH {LINES}, {BOUNDS} SELECT CAST(sum(v) FILTER ({MAT}) AS DOUBLE) AS value_sales_curr,
    CAST(sum(v) FILTER ({MAT_PREV}) AS DOUBLE) AS value_sales_prev FROM lines, b""",
)
def h2(spark, folder):
    mat, lines = year_on_year(spark, folder, ())
    return compare.two_windows(lines, [], "value_sales", mat, win.prev_year_window(mat), True)


@query(
    "H3_semi_join",
    f"""WITH {LINES}, k AS (SELECT brand FROM lines GROUP BY 1 ORDER BY {V} DESC, brand LIMIT 5)
    SELECT date, brand, {V} AS value_sales FROM lines WHERE brand IN (SELECT brand FROM k) GROUP BY 1, 2""",
)
def h3(spark, folder):
    lines = sales_lines(spark, folder, ("brand",))
    best = agg.top_n(lines, "brand", "value_sales", 5)
    return compare.semi_on_keys(
        agg.grouped_sum(lines, ["date", "brand"], "value_sales"), best, ["brand"]
    )


@query(
    "H4_totals_to_detail",
    f"""WITH {LINES}, s AS (SELECT date, category, brand, {V} AS value_sales FROM lines GROUP BY 1, 2, 3),
    t AS (SELECT date, category, {total_sql('value_sales')} AS category_total FROM s GROUP BY 1, 2)
    SELECT date, category, brand, value_sales, category_total,
    CASE WHEN category_total <> 0 THEN round(100 * (value_sales / category_total), 6) END AS share
    FROM s JOIN t USING (date, category)""",
)
def h4(spark, folder):
    lines = sales_lines(spark, folder, ("category", "brand"))
    detail = agg.grouped_sum(lines, ["date", "category", "brand"], "value_sales")
    out = rank.with_total(detail, ["date", "category"], "value_sales", "category_total", "share")
    return out.withColumn("share", F.round("share", 6))


H6_SPANS = (
    ("MAT 2000", "1999-10-01", "2000-10-01"),
    ("YTD 2000", "2000-01-01", "2000-10-01"),
    ("MAT 1999", "1998-10-01", "1999-10-01"),
)


@query(
    "H6_date_in_window",
    f"""WITH {LINES}, w AS (SELECT * FROM (VALUES {', '.join(
        f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in H6_SPANS)}) AS x(span, start, stop))
    SELECT span, start, category, {V} AS value_sales FROM lines JOIN w ON date >= start AND date < stop
    GROUP BY 1, 2, 3""",
)
def h6(spark, folder):
    """Overlapping periods; a line counts in each that holds it."""
    spans = [(name, win.MonthWindow.of(a, b)) for name, a, b in H6_SPANS]
    lines = sales_lines(spark, folder, ("category",), win.hull(*[w for _, w in spans]))
    out = compare.stack_windows(lines, ["category"], "value_sales", spans)
    return out.select(F.col("mat_label").alias("span"), "start", "category", "value_sales")


@query(
    "H7_union_all",
    f"""WITH {LINES} SELECT 'market' AS dim, market AS name, {V} AS value_sales FROM lines GROUP BY 2
    UNION ALL SELECT 'channel', channel, {V} FROM lines GROUP BY 2""",
)
def h7(spark, folder):
    parts = [
        agg.grouped_sum(sales_lines(spark, folder, (d,)), [d], "value_sales").select(
            F.lit(d).alias("dim"), F.col(d).alias("name"), "value_sales"
        )
        for d in ("market", "channel")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "H8_first_per_key",
    f"""WITH {LINES} SELECT brand, category, {V} AS value_sales FROM lines GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY brand ORDER BY {V} DESC, category) = 1""",
)
def h8(spark, folder):
    rows = agg.grouped_sum(
        sales_lines(spark, folder, ("category", "brand")), ["brand", "category"], "value_sales"
    )
    return agg.first_per_key(rows, ["brand"], [F.desc_nulls_last("value_sales"), F.asc("category")])


@query(
    "H9_sort_and_head",
    f"""WITH {FACT} SELECT date, market, channel, category, brand, value_sales FROM fact
    ORDER BY value_sales DESC NULLS LAST, date, market, channel, category, brand LIMIT 25""",
)
def h9(spark, folder):
    rows = fact(spark, folder).select("date", *DIMS, "value_sales")
    return rows.orderBy(F.desc_nulls_last("value_sales"), "date", *DIMS).limit(25)


@query(
    "H10_chronological_labels",
    f"""WITH {LINES} SELECT row_number() OVER (ORDER BY date) AS pos, strftime(date, '%b %Y') AS month_label,
    {V} AS value_sales FROM lines GROUP BY date""",
)
def h10(spark, folder):
    from pyspark.sql.window import Window

    rows = agg.grouped_sum(sales_lines(spark, folder, ()), ["date"], "value_sales")
    rows = filters.with_month_labels(rows)
    # One row per calendar month meets in this window.
    pos = F.row_number().over(Window.orderBy("date")).cast("bigint")
    return rows.select(pos.alias("pos"), "month_label", "value_sales").orderBy("pos")

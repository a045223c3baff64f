import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesgrid.operators import agg, compare, filters, rank, series
from salesgrid.operators.windows import MonthWindow, prev_year_window, resolve_window

COLS = "date date, market string, channel string, category string, brand string, value_sales double, unit_sales double"


def day(y, m):
    return dt.date(y, m, 1)


def rows(spark, items):
    full = [(d, "m", "c", "k", b, v, 1.0) for d, b, v in items]
    return spark.createDataFrame(full, COLS)


@pytest.fixture(scope="module")
def small(spark):
    return rows(spark, [
        (day(2024, 1), "A", 10.0), (day(2023, 1), "A", 8.0), (day(2024, 1), None, 5.0),
        (day(2023, 1), None, 4.0), (day(2024, 1), "Z", 3.0), (day(2023, 1), "Z", 0.0),
        (day(2024, 1), "N", 1.0), (day(2023, 1), "P", 9.0), (day(2024, 1), "V", None),
    ])


def test_yoy_null_keys_and_zero_base(small):
    w = MonthWindow.of("2024-01-01", "2024-02-01")
    got = {r["brand"]: tuple(r)[1:] for r in compare.yoy(small, ["brand"], "value_sales", w).collect()}
    assert got == {"A": (10.0, 8.0, 0.25), None: (5.0, 4.0, 0.25), "Z": (3.0, 0.0, None),
                   "N": (1.0, None, None), "V": (0.0, None, None)}
    top = compare.yoy(small, ["brand"], "value_sales", w, n=2).collect()
    assert [r["brand"] for r in top] == ["A", None]
    total = compare.yoy(small, [], "value_sales", w).first()
    assert total["value_sales_curr"] == 19.0 and total["value_sales_prev"] == 21.0
    empty = MonthWindow.of("2010-01-01", "2010-02-01")
    assert compare.yoy(small, ["brand"], "value_sales", empty).count() == 0
    assert compare.yoy(small, [], "value_sales", empty).count() == 0


def test_windows(spark, small):
    def bounds(w):
        r = spark.range(1).select(w.start.alias("s"), w.end.alias("e")).first()
        return str(r["s"]), str(r["e"])

    assert bounds(resolve_window(small, "MAT", "2024-06-15")) == ("2023-02-01", "2024-01-31")
    assert bounds(resolve_window(small, "YTD", "2023-12-15")) == ("2023-01-01", "2023-11-30")
    assert bounds(resolve_window(small)) == ("2023-01-01", "2024-01-31")
    assert bounds(resolve_window(small, start="2022-05", end="2030-01")) == ("2022-05-01", "2024-01-31")
    w = MonthWindow.of("2024-01-01", "2024-03-01")
    assert bounds(prev_year_window(w)) == ("2023-01-01", "2023-02-28")
    with pytest.raises(ValueError):
        resolve_window(small, "MAT")


def test_totals_and_filters(small):
    assert agg.aggregate(small.filter("false"), []).count() == 0
    assert agg.aggregate(small.filter("brand = 'V'"), []).first()["value_sales"] == 0.0
    kept = filters.apply_filters(small, {"brand": [" a", "Z "], "nope": "x", "market": " "})
    assert {r["brand"] for r in kept.collect()} == {"A", "Z"}
    labelled = agg.top_n_or_total(kept, ["brand"], "value_sales", 5, {"brand": ["A", "Z"]})
    assert labelled.columns == ["brand", "value_sales"] and labelled.first()[0] == "A, Z"
    bars = [tuple(r) for r in agg.bar_items(small, "brand", "unit_sales").orderBy("rank").collect()]
    assert [b[0] for b in bars] == [1, 2, 3, 4, 5, 6] and bars[0][1] == "A"


def test_mom_rows_match_pandas(spark):
    values = [None, 4.0, None, 8.0, 0.0, 6.0, 3.0]
    items = [(day(2024, 1 + i // 3), "A", v) for i, v in enumerate(values)]
    full = [(d, f"m{i}", "c", "k", b, v, 1.0) for i, (d, b, v) in enumerate(items)]
    df = spark.createDataFrame(full, COLS)
    got = [r["value_mom"] for r in compare.mom_rows(df, "value_sales").orderBy("date", "market").collect()]
    padded = pd.Series(values).ffill()
    want = (padded / padded.shift() - 1).replace([float("inf"), float("-inf")], float("nan")).fillna(0)
    assert got == pytest.approx(list(want))


def test_mat_windows_overlap_and_sum(spark):
    df = rows(spark, [(day(2020 + i // 12, i % 12 + 1), "A", 1.0) for i in range(30)])
    out = compare.mat_compare(df, [2021, 2022, 2021], 12, last_month=F.lit("2022-06-01").cast("date"))
    got = [(r["mat_label"], str(r["start"]), r["value_sales"]) for r in out.orderBy("pos").collect()]
    assert got == [("MAT 2021", "2021-01-01", 12.0), ("MAT 2022", "2021-07-01", 12.0)]
    growth = compare.mat_growth(out.withColumn("value_sales", F.when(F.col("pos") == 0, 16.0).otherwise(8.0)))
    assert growth.orderBy("rank").first()["growth_vs_next"] == 1.0


def test_shares_and_pareto(spark):
    df = rows(spark, [(day(2024, 1), b, v) for b, v in (("A", 60.0), ("B", 30.0), ("C", 10.0))])
    out = rank.pareto(df).orderBy("cum_share_pct").collect()
    assert [r["cum_share_pct"] for r in out] == [60.0, 90.0, 100.0]
    assert [r["in_80"] for r in out] == [True, False, False]
    facts = agg.concentration(df, "brand").first()
    assert facts["leader"] == "A" and facts["gap"] == 30.0 and facts["band"] == "concentrated"
    ends = rank.extremes(rows(spark, [(day(2024, 2), "A", 1.0), (day(2024, 1), "A", 1.0)]), ["brand"],
                         "value_sales").first()
    assert ends["min_date"] == day(2024, 1) and ends["max_date"] == day(2024, 1)


def test_series_gaps_and_forecasts(spark):
    df = rows(spark, [(day(2023, 1), "A", 1.0), (day(2023, 1), "A", 2.0), (day(2023, 4), "A", 5.0)])
    full = series.complete_months(df, ["brand"], "value_sales").orderBy("month").collect()
    assert [r["value_sales"] for r in full] == [3.0, None, None, 5.0]
    months = series.complete_months(df, ["brand"], "value_sales")
    assert {r["yhat"] for r in series.seasonal_naive(months, ["brand"], "value_sales", 2).collect()} == {5.0}
    year = rows(spark, [(day(2020 + i // 12, i % 12 + 1), "A", 100.0 + 10 * (i % 12) + i // 12) for i in range(36)])
    s = series.complete_months(year, ["brand"], "value_sales")
    ahead = series.forecast_seasonal_ar(s, ["brand"], "value_sales", 14).orderBy("month").collect()
    assert ahead[0]["yhat"] == pytest.approx(103.0) and ahead[13]["yhat"] == pytest.approx(114.0)
    fitted = series.fitted_seasonal_ar(s, ["brand"], "value_sales")
    assert series.backtest_mape(fitted, ["brand"], "value_sales").first()["mape"] < 0.01
    line = rows(spark, [(day(2020 + i // 12, i % 12 + 1), "A", 10.0 + i) for i in range(24)])
    s = series.complete_months(line, ["brand"], "value_sales")
    flat = series.forecast_trend_season(s, ["brand"], "value_sales", 3).orderBy("month").collect()
    assert flat[0]["yhat"] == pytest.approx(34.0)
    ar = series.forecast_ar_diff(s, ["brand"], "value_sales", 1).first()
    assert ar["yhat"] == pytest.approx(33.99)
    with pytest.raises(ValueError):
        series.forecast_ar_diff(s, ["brand"], "value_sales", 37)
    assert series.backtest_mape(fitted.limit(2), ["brand"], "value_sales").first()["mape"] is None


def test_history_with_forecast_keeps_last_points(spark):
    df = rows(spark, [(day(2023, m), "A", float(m)) for m in range(1, 11)])
    s = series.complete_months(df, ["brand"], "value_sales")
    out = series.history_and_forecast(s, series.seasonal_naive(s, ["brand"], "value_sales", 2), ["brand"], "value_sales", 3)
    got = [(r["kind"], r["month_label"]) for r in out.orderBy("month").collect()]
    assert got[0] == ("history", "Aug 2023") and len(got) == 5 and got[-1] == ("forecast", "Dec 2023")

"""Monthly series: gap filling, autocorrelation and forecasts, for all series at once.

A series is one value per calendar month of its keys, so windows partitioned by the
keys hold at most the months of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_label, month_start
from salesgrid.functions.sums import as_exact, same_keys

HORIZON = (1, 36)
Z95, Z80 = 1.959963984540054, 1.2815515655446004


def _horizon(h: int) -> int:
    if not HORIZON[0] <= h <= HORIZON[1]:
        raise ValueError("horizon must be between 1 and 36 months")
    return h


def complete_months(df: DataFrame, keys, value: str, date: str = "date") -> DataFrame:
    """One row per month from a series' first to its last month.

    Rows of a month are summed (null if all are null); missing months get null. Each month brings the
    missing ones up to the next month of its series, so the monthly sums are read once.
    """
    keys = list(keys)
    seen = df.filter(F.col(date).isNotNull())
    by_month = seen.groupBy(*keys, month_start(date).alias("month")).agg(
        F.sum(as_exact(df, value)).cast("double").alias(value)
    )
    following = F.lead("month").over(Window.partitionBy(*keys).orderBy("month"))
    last = F.coalesce(F.add_months(following, -1), F.col("month"))
    step = F.expr("interval 1 month")
    frame = by_month.withColumn("__last", last).select(
        *keys, F.col("month").alias("__own"), value,
        F.explode(F.sequence("month", "__last", step)).alias("month"),
    )
    seen_value = F.when(F.col("month") == F.col("__own"), F.col(value))
    return frame.select(*keys, "month", seen_value.alias(value))


def monthly_total(df: DataFrame, value: str = "value_sales", date: str = "date") -> DataFrame:
    """Grand total per month, gaps as 0."""
    return complete_months(df, [], value, date).withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0))
    )


def acf(series: DataFrame, keys, value: str, max_lag: int = 12) -> DataFrame:
    """Autocorrelation at lags 1..max_lag, mean-centred, over the whole series' squares."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("month")
    x = F.col(value) - F.avg(value).over(whole)
    based = series.withColumn("__x", x)
    lags = {f"__l{k}": F.lag("__x", k).over(order) * F.col("__x") for k in range(1, max_lag + 1)}
    based = based.withColumns(lags)
    squares = F.sum(F.col("__x") * F.col("__x"))
    values = F.array(
        *[
            F.struct(
                F.lit(k).alias("lag"),
                F.when(squares != 0, F.coalesce(F.sum(f"__l{k}"), F.lit(0.0)) / squares)
                .otherwise(0.0)
                .alias("acf"),
            )
            for k in range(1, max_lag + 1)
        ]
    )
    grouped = based.groupBy(*keys).agg(values.alias("a")) if keys else based.agg(values.alias("a"))
    return grouped.select(*keys, F.inline("a"))


def _per_series(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs).filter(F.col("last").isNotNull())


def _ahead(model: DataFrame, h: int) -> DataFrame:
    """One row per step 1..h after the series' last month."""
    steps = model.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(_horizon(h)))))
    return steps.withColumn("month", F.add_months("last", F.col("k").cast("int")))


def seasonal_naive(series: DataFrame, keys, value: str, h: int = 3) -> DataFrame:
    """Same month last year; the last known point where that is missing or the series is short."""
    keys = list(keys)
    known = F.col(value).isNotNull()
    model = _per_series(
        series,
        keys,
        F.max("month").alias("last"),
        F.max_by(value, F.when(known, F.col("month"))).alias("__known"),
        F.count(value).alias("__n"),
    )
    steps = _ahead(model, h).withColumn("__src", F.add_months("month", -12))
    past = series.select(*keys, F.col("month").alias("__src"), F.col(value).alias("__past"))
    out = same_keys(steps, past, [*keys, "__src"], "left")
    enough = F.coalesce(F.col("__past"), F.col("__known"))
    return out.select(
        *keys, "month", F.when(F.col("__n") >= 12, enough).otherwise(F.col("__known")).alias("yhat")
    )


def _slope_through_zero(y: Column, x: Column) -> Column:
    """Least squares of y on x without intercept, kept inside the stationary range."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.sum(F.when(both, x * x))
    raw = F.when(xx > 0, F.sum(F.when(both, x * y)) / xx)
    return F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))


def _geometric(phi: Column, k: Column) -> Column:
    """phi + phi^2 + ... + phi^k."""
    return phi * (1 - F.pow(phi, k)) / (1 - phi)


def forecast_ar_diff(series: DataFrame, keys, value: str, h: int = 12) -> DataFrame:
    """First differences as an AR(1): the ARIMA(1,1,0) model by conditional least squares."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("month")
    d = series.withColumn("__d", F.col(value) - F.lag(value).over(order))
    d = d.withColumn("__pd", F.lag("__d").over(order))
    known = F.when(F.col(value).isNotNull(), F.col("month"))
    model = _per_series(
        d,
        keys,
        F.max("month").alias("last"),
        F.max_by(value, known).alias("__x"),
        F.coalesce(
            F.max_by("__d", F.when(F.col("__d").isNotNull(), F.col("month"))), F.lit(0.0)
        ).alias("__dx"),
        _slope_through_zero(F.col("__d"), F.col("__pd")).alias("phi"),
    )
    yhat = F.col("__x") + F.col("__dx") * _geometric(F.col("phi"), F.col("k"))
    return _ahead(model, h).select(*keys, "month", yhat.alias("yhat"))


def _seasonal_steps(series: DataFrame, keys, value: str) -> DataFrame:
    """Add the lag-12 difference `__y`, its step `__z` and the step before `__pz`."""
    order = Window.partitionBy(*keys).orderBy("month")
    s = series.withColumn("__y", F.col(value) - F.lag(value, 12).over(order))
    s = s.withColumn("__py", F.lag("__y").over(order))
    s = s.withColumn("__z", F.col("__y") - F.col("__py"))
    s = s.withColumn("__pz", F.lag("__z").over(order))
    return s.withColumn("__year_ago", F.lag(value, 12).over(order))


def forecast_seasonal_ar(series: DataFrame, keys, value: str, h: int = 12) -> DataFrame:
    """Lag-12 then first differences as an AR(1), with 95 % bounds from the residuals."""
    keys = list(keys)
    s = _seasonal_steps(series, keys, value)
    phi = _slope_through_zero(F.col("__z"), F.col("__pz"))
    z, pz = F.col("__z"), F.col("__pz")
    both = z.isNotNull() & pz.isNotNull()

    def latest(c: str) -> Column:
        return F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("month"))), F.lit(0.0))

    # Sum of squared residuals from the products, so one aggregate is enough.
    zz, zp, pp = [F.sum(F.when(both, a * b)) for a, b in ((z, z), (z, pz), (pz, pz))]
    n = F.count(F.when(both, 1))
    sse = zz - 2 * phi * zp + phi * phi * pp
    model = _per_series(
        s,
        keys,
        F.max("month").alias("last"),
        latest(value).alias("__x"),
        latest("__y").alias("__yT"),
        latest("__z").alias("__zT"),
        phi.alias("phi"),
        F.when(n >= 2, F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 1))).alias("sigma"),
    )
    steps = _ahead(model, h)
    # Month k repeats the month `years` years before, which lies in the history.
    years = F.ceil(F.col("k") / 12).cast("int")
    steps = steps.withColumn("__years", years)
    steps = steps.withColumn("__src", F.add_months("month", -12 * F.col("__years")))
    past = series.select(*keys, F.col("month").alias("__src"), F.col(value).alias("__past"))
    steps = same_keys(steps, past, [*keys, "__src"], "left")
    drift = F.aggregate(
        F.sequence(F.lit(0), F.col("__years") - 1),
        F.lit(0.0),
        lambda acc, j: acc
        + F.col("__yT")
        + F.col("__zT") * _geometric(F.col("phi"), F.col("k") - 12 * j),
    )
    yhat = F.coalesce(F.col("__past"), F.col("__x")) + drift
    half = Z95 * F.col("sigma") * F.sqrt("k")
    return steps.select(
        *keys,
        "month",
        yhat.alias("yhat"),
        (yhat - half).alias("yhat_lo"),
        (yhat + half).alias("yhat_hi"),
    )


def fitted_seasonal_ar(series: DataFrame, keys, value: str) -> DataFrame:
    """One-step fitted values of `forecast_seasonal_ar`, null where the lags are missing."""
    keys = list(keys)
    s = _seasonal_steps(series, keys, value)
    whole = Window.partitionBy(*keys)
    z, pz = F.col("__z"), F.col("__pz")
    both = z.isNotNull() & pz.isNotNull()
    xx = F.sum(F.when(both, pz * pz)).over(whole)
    xy = F.sum(F.when(both, z * pz)).over(whole)
    phi = F.least(F.greatest(F.coalesce(F.when(xx > 0, xy / xx), F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    step = phi * pz
    return s.select(
        *keys, "month", value, (F.col("__year_ago") + F.col("__py") + step).alias("yhat")
    )


def forecast_trend_season(series: DataFrame, keys, value: str, h: int = 6) -> DataFrame:
    """Linear trend times a month-of-year index, with 80 % bounds from the residuals."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    first = F.min("month").over(whole)
    t = ((F.year("month") - F.year(first)) * 12 + F.month("month") - F.month(first)).cast("double")
    rows = series.withColumn("t", t)
    rows = rows.withColumns(
        {
            "__b": F.regr_slope(value, "t").over(whole),
            "__a": F.regr_intercept(value, "t").over(whole),
            "__moy": F.month("month"),
        }
    )
    trend = F.col("__a") + F.col("__b") * F.col("t")
    rows = rows.withColumn("__trend", trend)
    rows = rows.withColumn(
        "__idx",
        F.avg(F.when(F.col("__trend") != 0, F.col(value) / F.col("__trend"))).over(
            Window.partitionBy(*keys, "__moy")
        ),
    )
    error = F.col(value) - F.col("__trend") * F.col("__idx")
    model = _per_series(
        rows,
        keys,
        F.max("month").alias("last"),
        F.max("t").alias("__t"),
        F.max("__a").alias("__a"),
        F.max("__b").alias("__b"),
        F.stddev_samp(error).alias("sigma"),
    )
    season = rows.groupBy(*keys, "__moy").agg(F.max("__idx").alias("__idx"))
    steps = _ahead(model, h).withColumn("__moy", F.month("month"))
    steps = same_keys(steps, season, [*keys, "__moy"], "left")
    line = F.col("__a") + F.col("__b") * (F.col("__t") + F.col("k"))
    yhat = line * F.coalesce(F.col("__idx"), F.lit(1.0))
    half = Z80 * F.col("sigma")
    return steps.select(
        *keys,
        "month",
        yhat.alias("yhat"),
        (yhat - half).alias("yhat_lo"),
        (yhat + half).alias("yhat_hi"),
    )


def backtest_mape(fitted: DataFrame, keys, value: str, last: int = 12) -> DataFrame:
    """Mean absolute percentage error of the last 12 known points; null below three."""
    keys = list(keys)
    recent = Window.partitionBy(*keys).orderBy(F.desc("month"))
    known = fitted.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(recent))
    known = known.filter(F.col("__r") <= last)
    err = F.abs((F.col(value) - F.col("yhat")) / F.when(F.col(value) != 0, F.col(value)))
    mape = F.when(F.count("*") >= 3, F.avg(err)).alias("mape")
    return known.groupBy(*keys).agg(mape) if keys else known.agg(mape)


def history_and_forecast(
    history: DataFrame, forecast: DataFrame, keys, value: str, k: int = 24
) -> DataFrame:
    """The last k known months of each series followed by its forecast."""
    keys = list(keys)
    recent = Window.partitionBy(*keys).orderBy(F.desc("month"))
    past = history.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(recent))
    past = past.filter(F.col("__r") <= k).select(
        *keys, "month", F.lit("history").alias("kind"), F.col(value).alias("value")
    )
    ahead = forecast.select(
        *keys, "month", F.lit("forecast").alias("kind"), F.col("yhat").alias("value")
    )
    return past.unionByName(ahead).withColumn("month_label", month_label("month"))


def with_actuals(forecast: DataFrame, actual: DataFrame, keys, value: str) -> DataFrame:
    """Forecast rows with the actual value of their month, null where there is none yet."""
    keys = [*keys, "month"]
    return same_keys(forecast, actual.select(*keys, F.col(value).alias("actual")), keys, "left")


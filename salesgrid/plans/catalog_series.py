"""Queries of the time-series and test operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesgrid.operators import agg, series, stats
from salesgrid.operators.filters import tail_points
from salesgrid.plans.registry import (
    LINES,
    RANGE_TAIL,
    chi2_tail_sql,
    f_tail_sql,
    norm_quantile_sql,
    norm_tail_sql,
    query,
)
from salesgrid.sources.fact import sales_lines
from salesgrid.sources.files import stored

V = "CAST(sum(v) AS DOUBLE)"
BM = """m0 AS (SELECT brand, date AS month, CAST(sum(v) AS DOUBLE) AS x FROM lines GROUP BY 1, 2),
sp AS (SELECT brand, lo, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
  INTERVAL 1 MONTH)) AS d FROM (SELECT brand, min(month) AS lo, max(month) AS hi FROM m0 GROUP BY 1)),
m AS (SELECT sp.brand, CAST(sp.d AS DATE) AS month, m0.x FROM sp
  LEFT JOIN m0 ON m0.brand = sp.brand AND m0.month = CAST(sp.d AS DATE))"""
ENDS = """e AS (SELECT brand, max(month) AS last, arg_max(x, month) AS xe,
  arg_max(x, month) FILTER (x IS NOT NULL) AS xk, count(x) AS n FROM m GROUP BY 1)"""


def brand_series(spark, folder):
    """Complete monthly value series of every brand."""
    return series.complete_months(sales_lines(spark, folder, ("brand",)), ["brand"], "value_sales")


@query(
    "C8_monthly_total",
    f"""WITH {LINES}, t AS (SELECT date, {V} AS x FROM lines GROUP BY 1),
    c AS (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH))
      AS d FROM (SELECT min(date) AS lo, max(date) AS hi FROM t))
    SELECT CAST(d AS DATE) AS month, coalesce(x, 0) AS value_sales FROM c
    LEFT JOIN t ON t.date = CAST(c.d AS DATE)""",
)
def c8(spark, folder):
    return series.monthly_total(sales_lines(spark, folder, ()))


@query(
    "F1_complete_months",
    f"""WITH {LINES}, m0 AS (SELECT market, category, brand, date AS month, {V} AS x FROM lines
      GROUP BY 1, 2, 3, 4),
    sp AS (SELECT market, category, brand, unnest(generate_series(CAST(min(month) AS TIMESTAMP),
      CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM m0 GROUP BY 1, 2, 3)
    SELECT sp.market, sp.category, sp.brand, CAST(d AS DATE) AS month, x AS value_sales FROM sp
    LEFT JOIN m0 ON m0.market = sp.market AND m0.category = sp.category AND m0.brand = sp.brand
      AND m0.month = CAST(d AS DATE)""",
)
def f1(spark, folder):
    keys = ["market", "category", "brand"]
    return series.complete_months(sales_lines(spark, folder, keys), keys, "value_sales")


@query(
    "F2_acf",
    f"""WITH {LINES}, {BM}, c AS (SELECT brand, month, x - avg(x) OVER (PARTITION BY brand) AS b FROM m),
    l AS (SELECT c.*, lag, lag(b, CAST(lag AS INTEGER)) OVER (PARTITION BY brand, lag ORDER BY month) AS lb
      FROM c, range(1, 13) r(lag))
    SELECT brand, CAST(lag AS INTEGER) AS lag, round(coalesce(sum(b * lb), 0) / sum(b * b), 6) AS acf
    FROM l GROUP BY 1, 2""",
)
def f2(spark, folder):
    out = series.acf(brand_series(spark, folder), ["brand"], "value_sales", 12)
    return out.withColumn("acf", F.round("acf", 6))


@query(
    "F3_seasonal_naive",
    f"""WITH {LINES}, {BM}, {ENDS}, s AS (SELECT e.*, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE)
      AS month FROM e, range(1, 7) r(k))
    SELECT s.brand, s.month, CASE WHEN n >= 12 THEN coalesce(m.x, xe) ELSE xk END AS yhat FROM s
    LEFT JOIN m ON m.brand = s.brand AND m.month = CAST(s.month - INTERVAL 12 MONTH AS DATE)""",
)
def f3(spark, folder):
    return series.seasonal_naive(brand_series(spark, folder), ["brand"], "value_sales", 6)


def _phi_sql(z: str, pz: str) -> str:
    return f"""least(greatest(coalesce(sum({z} * {pz}) / nullif(sum({pz} * {pz})
      FILTER ({z} IS NOT NULL), 0), 0), -0.99), 0.99)"""


@query(
    "F4_forecast_ar_diff",
    f"""WITH {LINES}, {BM}, {ENDS},
    d AS (SELECT *, x - lag(x) OVER (PARTITION BY brand ORDER BY month) AS d FROM m),
    dd AS (SELECT *, lag(d) OVER (PARTITION BY brand ORDER BY month) AS pd FROM d),
    p AS (SELECT brand, {_phi_sql('d', 'pd')} AS phi,
      coalesce(arg_max(d, month) FILTER (d IS NOT NULL), 0) AS dx FROM dd GROUP BY 1)
    SELECT e.brand, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month,
    round(xk + dx * phi * (1 - pow(phi, k)) / (1 - phi), 3) AS yhat
    FROM e JOIN p USING (brand), range(1, 13) r(k)""",
)
def f4(spark, folder):
    out = series.forecast_ar_diff(brand_series(spark, folder), ["brand"], "value_sales", 12)
    return out.withColumn("yhat", F.round("yhat", 3))


SEASON = """y AS (SELECT *, x - lag(x, 12) OVER w AS y, lag(x, 12) OVER w AS xa FROM m
    WINDOW w AS (PARTITION BY brand ORDER BY month)),
  z AS (SELECT *, lag(y) OVER w AS py, y - lag(y) OVER w AS z FROM y
    WINDOW w AS (PARTITION BY brand ORDER BY month)),
  zz AS (SELECT *, lag(z) OVER (PARTITION BY brand ORDER BY month) AS pz FROM z),
  p AS (SELECT brand, """ + _phi_sql("z", "pz") + """ AS phi,
    coalesce(arg_max(y, month) FILTER (y IS NOT NULL), 0) AS yt,
    coalesce(arg_max(z, month) FILTER (z IS NOT NULL), 0) AS zt FROM zz GROUP BY 1),
  g AS (SELECT zz.brand, CASE WHEN count(*) >= 2 THEN sqrt(sum((z - phi * pz) * (z - phi * pz))
    / (count(*) - 1)) END AS sigma FROM zz JOIN p USING (brand) WHERE z IS NOT NULL AND pz IS NOT NULL
    GROUP BY 1)"""


@query(
    "F5_forecast_seasonal_ar",
    f"""WITH {LINES}, {BM}, {ENDS}, {SEASON},
    s AS (SELECT brand, xk, phi, yt, zt, sigma, k, CAST((k + 11) // 12 AS INTEGER) AS years,
      CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month
      FROM e JOIN p USING (brand) LEFT JOIN g USING (brand), range(1, 19) r(k)),
    f AS (SELECT s.*, coalesce(m.x, xk) + yt + zt * phi * (1 - pow(phi, k)) / (1 - phi)
      + CASE WHEN years > 1 THEN yt + zt * phi * (1 - pow(phi, k - 12)) / (1 - phi) ELSE 0 END AS yhat
      FROM s LEFT JOIN m ON m.brand = s.brand
        AND m.month = CAST(s.month - to_months(12 * years) AS DATE))
    SELECT brand, month, round(yhat, 3) AS yhat,
    round(yhat - 1.959963984540054 * sigma * sqrt(k), 2) AS yhat_lo,
    round(yhat + 1.959963984540054 * sigma * sqrt(k), 2) AS yhat_hi FROM f""",
)
def f5(spark, folder):
    out = series.forecast_seasonal_ar(brand_series(spark, folder), ["brand"], "value_sales", 18)
    return out.withColumns(
        {"yhat": F.round("yhat", 3), "yhat_lo": F.round("yhat_lo", 2), "yhat_hi": F.round("yhat_hi", 2)}
    )


@query(
    "F6_forecast_trend_season",
    f"""WITH {LINES}, {BM}, {ENDS},
    t AS (SELECT *, CAST(datediff('month', min(month) OVER (PARTITION BY brand), month) AS DOUBLE) AS t FROM m),
    r AS (SELECT brand, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, max(t) AS tmax FROM t GROUP BY 1),
    i AS (SELECT brand, month(month) AS moy, avg(x / (a + b * t)) AS idx FROM t JOIN r USING (brand) GROUP BY 1, 2),
    g AS (SELECT brand, stddev_samp(x - (a + b * t) * idx) AS sigma FROM t JOIN r USING (brand)
      JOIN i ON i.brand = t.brand AND i.moy = month(t.month) GROUP BY 1),
    s AS (SELECT e.brand, k, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM e, range(1, 7) q(k)),
    f AS (SELECT s.brand, s.month, (a + b * (tmax + k)) * idx AS yhat, sigma FROM s JOIN r USING (brand)
      JOIN g USING (brand) JOIN i ON i.brand = s.brand AND i.moy = month(s.month))
    SELECT brand, month, round(yhat, 3) AS yhat, round(yhat - 1.2815515655446004 * sigma, 3) AS yhat_lo,
    round(yhat + 1.2815515655446004 * sigma, 3) AS yhat_hi FROM f""",
)
def f6(spark, folder):
    out = series.forecast_trend_season(brand_series(spark, folder), ["brand"], "value_sales", 6)
    return out.withColumns({c: F.round(c, 3) for c in ("yhat", "yhat_lo", "yhat_hi")})


@query(
    "F7_backtest_mape",
    f"""WITH {LINES}, {BM}, {SEASON}, f AS (SELECT zz.brand, month, x, xa + py + phi * pz AS yhat,
      row_number() OVER (PARTITION BY brand ORDER BY month DESC) AS rn
      FROM zz JOIN p USING (brand) WHERE x IS NOT NULL)
    SELECT brand, round(CASE WHEN count(*) >= 3 THEN avg(abs((x - yhat) / nullif(x, 0))) END, 6) AS mape
    FROM f WHERE rn <= 12 GROUP BY 1""",
)
def f7(spark, folder):
    fitted = series.fitted_seasonal_ar(brand_series(spark, folder), ["brand"], "value_sales")
    out = series.backtest_mape(fitted, ["brand"], "value_sales")
    return out.withColumn("mape", F.round("mape", 6))


@query(
    "F8_history_and_forecast",
    f"""WITH {LINES}, {BM}, {ENDS}, h AS (SELECT brand, month, 'history' AS kind, x AS value FROM m
      WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY brand ORDER BY month DESC) <= 24),
    s AS (SELECT e.*, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM e, range(1, 4) r(k)),
    f AS (SELECT s.brand, s.month, 'forecast' AS kind, CASE WHEN n >= 12 THEN coalesce(m.x, xe) ELSE xk END
      AS value FROM s LEFT JOIN m ON m.brand = s.brand AND m.month = CAST(s.month - INTERVAL 12 MONTH AS DATE))
    SELECT *, strftime(month, '%b %Y') AS month_label FROM (SELECT * FROM h UNION ALL SELECT * FROM f)""",
)
def f8(spark, folder):
    past = brand_series(spark, folder)
    ahead = series.seasonal_naive(past, ["brand"], "value_sales", 3)
    return series.history_and_forecast(past, ahead, ["brand"], "value_sales", 24)


@query(
    "H5_forecast_with_actuals",
    f"""WITH {LINES}, {BM}, cut AS (SELECT * FROM m WHERE month < DATE '2001-08-01'),
    e AS (SELECT brand, max(month) AS last, arg_max(x, month) AS xe,
      arg_max(x, month) FILTER (x IS NOT NULL) AS xk, count(x) AS n FROM cut GROUP BY 1),
    s AS (SELECT e.*, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM e, range(1, 7) r(k))
    SELECT s.brand, s.month, CASE WHEN n >= 12 THEN coalesce(c.x, xe) ELSE xk END AS yhat, a.x AS actual
    FROM s LEFT JOIN cut c ON c.brand = s.brand AND c.month = CAST(s.month - INTERVAL 12 MONTH AS DATE)
    LEFT JOIN m a ON a.brand = s.brand AND a.month = s.month""",
)
def h5(spark, folder):
    full = brand_series(spark, folder)
    known = full.filter(F.col("month") < F.lit("2001-08-01").cast("date"))
    ahead = series.seasonal_naive(known, ["brand"], "value_sales", 6)
    return series.with_actuals(ahead, full, ["brand"], "value_sales")


# ---- S: hypothesis tests --------------------------------------------------------------

CBM = """d AS (SELECT category, brand, market, date, CAST(sum(v) AS DOUBLE) AS x FROM lines
  GROUP BY 1, 2, 3, 4)"""
GM = """gm AS (SELECT category, brand, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 1, 2)"""


def monthly_rows(spark, folder):
    """Monthly value by category, market and brand: the rows that the tests compare."""
    lines = sales_lines(spark, folder, ("market", "category", "brand"))
    return agg.grouped_sum(lines, ["category", "brand", "market", "date"], "value_sales")


@query(
    "S1_welch_t",
    f"""WITH {LINES}, {CBM}, s AS (SELECT count(x) FILTER (category = 'PROMO') AS na,
      count(x) FILTER (category = 'SMALL') AS nb, avg(x) FILTER (category = 'PROMO') AS ma,
      avg(x) FILTER (category = 'SMALL') AS mb, var_samp(x) FILTER (category = 'PROMO') AS va,
      var_samp(x) FILTER (category = 'SMALL') AS vb FROM d),
    u AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t,
      pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM s)
    SELECT na AS n_a, nb AS n_b, round(ma, 3) AS mean_a, round(mb, 3) AS mean_b, round(t, 6) AS t, round(df, 4) AS df,
    round({f_tail_sql('t * t', '1', 'df')}, 6) AS p FROM u""",
)
def s1(spark, folder):
    out = stats.welch_t(monthly_rows(spark, folder), "category", "PROMO", "SMALL", "value_sales")
    return out.withColumns(
        {"mean_a": F.round("mean_a", 3), "mean_b": F.round("mean_b", 3), "t": F.round("t", 6),
         "df": F.round("df", 4), "p": F.round("p", 6)}
    )


# Royston's polynomials for the outer weights and for mean and spread of the transform.
SHAPIRO = f"""o AS (SELECT category, brand, x, count(*) OVER (PARTITION BY category, brand) AS n,
    row_number() OVER (PARTITION BY category, brand ORDER BY x) AS i FROM d),
  om AS (SELECT *, {norm_quantile_sql('(i - 0.375) / (n + 0.25)')} AS m FROM o WHERE n >= 3),
  sh AS (SELECT category, brand, n, sum(m * m) AS mm, sum(m * x) AS mx, max(m) AS m1,
    max(m) FILTER (i = n - 1) AS m2, max(x) - min(x) AS r1,
    max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS r2, var_pop(x) * n AS ss, 1 / sqrt(n) AS u
    FROM om GROUP BY 1, 2, 3),
  sa AS (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) ELSE m1 / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2
      - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 END AS a1,
    m2 / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4
      - 3.582633 * u ** 5 AS a2 FROM sh),
  sl AS (SELECT *, a1 * r1 + CASE WHEN n = 3 THEN 0
      WHEN n <= 5 THEN (mx - m1 * r1) * sqrt((1 - 2 * a1 * a1) / (mm - 2 * m1 * m1))
      ELSE a2 * r2 + (mx - m1 * r1 - m2 * r2)
        * sqrt((1 - 2 * a1 * a1 - 2 * a2 * a2) / (mm - 2 * m1 * m1 - 2 * m2 * m2)) END AS line FROM sa),
  sw AS (SELECT category, brand, n, CASE WHEN ss > 0 THEN least(line * line / ss, 1.0) END AS w, ln(n) AS l FROM sl),
  sz AS (SELECT *, CASE WHEN n <= 11 THEN (-ln(0.459 * n - 2.273 - ln(1 - w)) - (0.5440 - 0.39978 * n
      + 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
    ELSE (ln(1 - w) - (-1.5861 - 0.31082 * l - 0.083751 * l * l + 0.0038915 * l * l * l))
      / exp(-0.4803 - 0.082676 * l + 0.0030302 * l * l) END AS z FROM sw)"""


@query(
    "S2_shapiro",
    f"""WITH {LINES}, {CBM}, {SHAPIRO}
    SELECT category, brand, n, round(w, 6) AS w, round(CASE WHEN n = 3
      THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0) ELSE {norm_tail_sql('z')} END, 6) AS p FROM sz""",
)
def s2(spark, folder):
    out = stats.shapiro(monthly_rows(spark, folder), ["category", "brand"], "value_sales")
    return out.withColumns({"w": F.round("w", 6), "p": F.round("p", 6)})


ANOVA_SQL = f"""g AS (SELECT category, sum(n * m) / sum(n) AS g FROM gm GROUP BY 1),
  sq AS (SELECT category, count(*) AS k, sum(n) AS n, sum(n * (m - g) * (m - g)) AS ssb,
    sum(CASE WHEN n > 1 THEN (n - 1) * v ELSE 0 END) AS ssw FROM gm JOIN g USING (category) GROUP BY 1),
  af AS (SELECT category, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2,
    (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM sq),
  ap AS (SELECT *, {f_tail_sql('f', 'df1', 'df2')} AS p FROM af)"""
ANOVA_ROWS = "SELECT category, df1, df2, round(f, 6) AS {name}, round(p, 6) AS p FROM ap"


LEVENE_SQL = f"""md AS (SELECT category, brand, quantile_cont(x, 0.5) AS med FROM d GROUP BY 1, 2),
  z AS (SELECT category, brand, abs(x - med) AS z FROM d JOIN md USING (category, brand)),
  gm AS (SELECT category, brand, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1, 2),
  {ANOVA_SQL}"""


@query("S3_levene", f"WITH {LINES}, {CBM}, {LEVENE_SQL} {ANOVA_ROWS.format(name='w')}")
def s3(spark, folder):
    out = stats.levene(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.select("category", "df1", "df2", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"))


@query("S4_anova", f"WITH {LINES}, {CBM}, {GM}, {ANOVA_SQL} {ANOVA_ROWS.format(name='f')}")
def s4(spark, folder):
    out = stats.anova(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.select("category", "df1", "df2", F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


@query(
    "S4b_anova_calendar_months",
    f"""WITH {LINES}, {CBM}, gm AS (SELECT 'all' AS category, month(date) AS brand, count(*) AS n,
      avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 2), {ANOVA_SQL} {ANOVA_ROWS.format(name='f')}""",
)
def s4b(spark, folder):
    rows = monthly_rows(spark, folder).withColumn("moy", F.month("date"))
    out = stats.anova(rows, [], "moy", "value_sales")
    return out.select(
        F.lit("all").alias("category"), "df1", "df2", F.round("f", 6).alias("f"), F.round("p", 6).alias("p")
    )


WELCH_SQL = f"""w AS (SELECT *, n / v AS w FROM gm),
  t AS (SELECT category, sum(w) AS tw, sum(w * m) / sum(w) AS g FROM w GROUP BY 1),
  a AS (SELECT category, count(*) AS k, sum(w * (m - g) * (m - g)) AS b,
    sum(pow(1 - w / tw, 2) / (n - 1)) AS l FROM w JOIN t USING (category) GROUP BY 1),
  u AS (SELECT category, CAST(k - 1 AS BIGINT) AS df1, (k * k - 1) / (3 * l) AS df2,
    (b / (k - 1)) / (1 + 2.0 * (k - 2) / (k * k - 1) * l) AS f FROM a),
  wp AS (SELECT *, {f_tail_sql('f', 'df1', 'df2')} AS p FROM u)"""


@query(
    "S5_welch_anova",
    f"""WITH {LINES}, {CBM}, {GM}, {WELCH_SQL}
    SELECT category, df1, round(df2, 4) AS df2, round(f, 6) AS f, round(p, 6) AS p FROM wp""",
)
def s5(spark, folder):
    out = stats.welch_anova(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.select(
        "category", "df1", F.round("df2", 4).alias("df2"), F.round("f", 6).alias("f"), F.round("p", 6).alias("p")
    )


KRUSKAL = """r AS (SELECT {key} AS category, {by} AS brand, rank() OVER (PARTITION BY {key} ORDER BY x)
    + (count(*) OVER (PARTITION BY {key}, x) - 1) / 2.0 AS r FROM d),
  t AS (SELECT category, sum(c * c * c - c) AS t FROM (SELECT {key} AS category, x,
    CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY 1, 2) GROUP BY 1),
  gs AS (SELECT category, brand, count(*) AS n, CAST(sum(r) AS DOUBLE) AS s FROM r GROUP BY 1, 2),
  a AS (SELECT category, count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q FROM gs GROUP BY 1),
  kh AS (SELECT category, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df,
    (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM a JOIN t USING (category)),
  kp AS (SELECT *, {tail} AS p FROM kh)"""
H_TAIL = chi2_tail_sql("h", "df")
KRUSKAL_ROWS = "SELECT category, n, df, round(h, 4) AS h, round(p, 6) AS p FROM kp"


@query("S6_kruskal", f"WITH {LINES}, {CBM}, {KRUSKAL.format(key='category', by='brand', tail=H_TAIL)} {KRUSKAL_ROWS}")
def s6(spark, folder):
    out = stats.kruskal(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.select("category", "n", "df", F.round("h", 4).alias("h"), F.round("p", 6).alias("p"))


@query(
    "S6b_kruskal_calendar_months",
    f"""WITH {LINES}, {CBM}, {KRUSKAL.format(key="'all'", by='month(date)', tail=H_TAIL)} {KRUSKAL_ROWS}""",
)
def s6b(spark, folder):
    rows = monthly_rows(spark, folder).withColumn("moy", F.month("date"))
    out = stats.kruskal(rows, [], "moy", "value_sales")
    return out.select(
        F.lit("all").alias("category"), "n", "df", F.round("h", 4).alias("h"), F.round("p", 6).alias("p")
    )


@query(
    "S7_tukey_hsd",
    f"""WITH {LINES}, {CBM}, {GM}, p AS (SELECT category, sum((n - 1) * v) / (sum(n) - count(*)) AS ms,
      CAST(sum(n) - count(*) AS BIGINT) AS df, count(*) AS k FROM gm GROUP BY 1),
    tq AS (SELECT a.category, a.brand AS group_a, b.brand AS group_b, b.m - a.m AS diff,
      abs(b.m - a.m) / sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, df, CAST(df AS DOUBLE) AS v, k
      FROM gm a JOIN gm b ON a.category = b.category AND a.brand < b.brand JOIN p ON p.category = a.category),
    {RANGE_TAIL}
    SELECT category, group_a, group_b, round(diff, 3) AS diff, round(q, 6) AS q, df, round(p, 4) AS p FROM rp""",
)
def s7(spark, folder):
    out = stats.tukey_hsd(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.withColumns({"diff": F.round("diff", 3), "q": F.round("q", 6), "p": F.round("p", 4)})


@query(
    "S8_games_howell",
    f"""WITH {LINES}, {CBM}, {GM}, p AS (SELECT category, count(*) AS k FROM gm WHERE n >= 2 GROUP BY 1),
    tq AS (SELECT a.category, a.brand AS group_a, b.brand AS group_b, b.m - a.m AS diff,
      abs(b.m - a.m) / sqrt((a.v / a.n + b.v / b.n) / 2) AS q,
      pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS v, k
      FROM gm a JOIN gm b ON a.category = b.category AND a.brand < b.brand AND a.n >= 2 AND b.n >= 2
      JOIN p ON p.category = a.category),
    {RANGE_TAIL}
    SELECT category, group_a, group_b, round(diff, 3) AS diff, round(q, 6) AS q, round(v, 4) AS df, round(p, 4) AS p FROM rp""",
)
def s8(spark, folder):
    out = stats.games_howell(monthly_rows(spark, folder), ["category"], "brand", "value_sales")
    return out.withColumns(
        {"diff": F.round("diff", 3), "q": F.round("q", 6), "df": F.round("df", 4), "p": F.round("p", 4)}
    )


# All three tests of every key of `d` and the choice among them; groups need two points, keys two groups.
COMPARED = f"""{SHAPIRO},
  sp AS (SELECT category, brand, CASE WHEN n = 3
    THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0) ELSE {norm_tail_sql('z')} END AS p FROM sz),
  two AS (SELECT category, brand FROM d GROUP BY 1, 2 HAVING count(x) >= 2),
  d2 AS (SELECT d.* FROM d JOIN two USING (category, brand) WHERE x IS NOT NULL),
  nm AS (SELECT two.category, count(*) AS groups, bool_and(coalesce(p > 0.05, false)) AS all_normal
    FROM two LEFT JOIN sp USING (category, brand) GROUP BY 1 HAVING count(*) >= 2),
  lv AS (WITH d AS (SELECT * FROM d2), {LEVENE_SQL} SELECT category, p FROM ap),
  an AS (WITH d AS (SELECT * FROM d2), {GM}, {ANOVA_SQL} SELECT category, f, p FROM ap),
  we AS (WITH d AS (SELECT * FROM d2), {GM}, {WELCH_SQL} SELECT category, f, p FROM wp),
  kr AS (WITH d AS (SELECT * FROM d2), {KRUSKAL.format(key='category', by='brand', tail=H_TAIL)} SELECT category, h, p FROM kp),
  ro AS (SELECT nm.*, CASE WHEN all_normal THEN coalesce(lv.p > 0.05, false) END AS equal_var
    FROM nm LEFT JOIN lv USING (category)),
  rc AS (SELECT *, CASE WHEN equal_var THEN 'anova' WHEN all_normal THEN 'welch' ELSE 'kruskal' END AS test FROM ro),
  re AS (SELECT rc.*, CASE test WHEN 'anova' THEN an.f WHEN 'welch' THEN we.f ELSE kr.h END AS statistic,
    CASE test WHEN 'anova' THEN an.p WHEN 'welch' THEN we.p ELSE kr.p END AS p FROM rc
    LEFT JOIN an USING (category) LEFT JOIN we USING (category) LEFT JOIN kr USING (category)),
  cg AS (SELECT *, coalesce(p < 0.05, false) AS significant, CASE WHEN p < 0.05 AND test = 'anova' THEN 'tukey'
    WHEN p < 0.05 AND test = 'welch' THEN 'games_howell' END AS post_hoc FROM re)"""


@query(
    "S9_compare_groups",
    f"""WITH {LINES}, {CBM}, {COMPARED} SELECT category, groups, all_normal, equal_var, test,
    round(statistic, 4) AS statistic, round(p, 6) AS p, significant, post_hoc FROM cg""",
)
def s9(spark, folder):
    out = stats.compare_groups(stored(monthly_rows(spark, folder)), ["category"], "brand", "value_sales")
    return out.withColumns({"statistic": F.round("statistic", 4), "p": F.round("p", 6)})


@query(
    "S9b_post_hoc_pairs",
    f"""WITH {LINES}, d AS (SELECT market AS category, brand, date_trunc('year', date) AS year,
      CAST(sum(v) AS DOUBLE) AS x FROM lines GROUP BY 1, 2, 3), {COMPARED},
    g2 AS (SELECT category, brand, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d2 GROUP BY 1, 2),
    po AS (SELECT category, sum((n - 1) * v) / (sum(n) - count(*)) AS ms, sum(n) - count(*) AS df, count(*) AS k
      FROM g2 GROUP BY 1),
    tq AS (SELECT a.category, post_hoc, a.brand AS group_a, b.brand AS group_b, b.m - a.m AS diff, k,
      abs(b.m - a.m) / sqrt((CASE post_hoc WHEN 'tukey' THEN ms / a.n + ms / b.n ELSE a.v / a.n + b.v / b.n END) / 2) AS q,
      CASE post_hoc WHEN 'tukey' THEN CAST(df AS DOUBLE) ELSE pow(a.v / a.n + b.v / b.n, 2)
        / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) END AS v
      FROM g2 a JOIN g2 b ON a.category = b.category AND a.brand < b.brand
      JOIN po ON po.category = a.category JOIN cg ON cg.category = a.category AND post_hoc IS NOT NULL),
    {RANGE_TAIL}
    SELECT category AS market, post_hoc, group_a, group_b, round(diff, 4) AS diff, round(q, 4) AS q,
    round(v, 4) AS df, round(p, 4) AS p, coalesce(p < 0.05, false) AS differs FROM rp""",
)
def s9b(spark, folder):
    """The brands of each market compared by their yearly sums, and the pairs that the test asks for."""
    yearly = sales_lines(spark, folder, ("market", "brand")).withColumn("year", F.trunc("date", "year"))
    rows = stored(agg.grouped_sum(yearly, ["market", "brand", "year"], "value_sales"))
    compared = stored(stats.compare_groups(rows, ["market"], "brand", "value_sales"))
    out = stats.post_hoc_pairs(rows, compared, ["market"], "brand", "value_sales")
    return out.withColumns({c: F.round(c, 4) for c in ("diff", "q", "df", "p")})


BY_MONTH = KRUSKAL.format(key="category", by="month(date)", tail=H_TAIL)


@query(
    "S10_seasonality_test",
    f"""WITH {LINES}, {CBM}, gm AS (SELECT category, month(date) AS brand, count(*) AS n, avg(x) AS m,
      var_samp(x) AS v FROM d GROUP BY 1, 2), {ANOVA_SQL},
    {BY_MONTH}
    SELECT category, round(f, 4) AS f, round(ap.p, 4) AS p_anova, round(h, 4) AS h, round(kp.p, 4) AS p_kruskal,
    ap.p < 0.05 OR kp.p < 0.05 AS seasonal FROM ap JOIN kp USING (category)""",
)
def s10(spark, folder):
    rows = monthly_rows(spark, folder)
    out = stats.seasonality_test(rows, ["category"], "value_sales")
    return out.withColumns({c: F.round(c, 4) for c in ("f", "h", "p_anova", "p_kruskal")})


@query(
    "S11_normal_curve",
    f"""WITH {LINES}, {CBM}, s AS (SELECT brand, avg(x) AS mu, stddev_samp(x) AS sigma, min(x) AS lo,
      max(x) AS hi FROM d GROUP BY 1)
    SELECT brand, CAST(i AS INTEGER) AS i, round(lo + (hi - lo) * i / 199, 6) AS x,
    round(1e6 * exp(-pow((lo + (hi - lo) * i / 199 - mu) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())), 6)
      AS density_ppm FROM s, range(200) r(i)""",
)
def s11(spark, folder):
    out = stats.normal_curve(monthly_rows(spark, folder), ["brand"], "value_sales")
    return out.select(
        "brand", "i", F.round("x", 6).alias("x"),
        F.round(1e6 * F.col("density"), 6).alias("density_ppm"),
    )


@query(
    "S12_kde",
    f"""WITH {LINES}, {CBM}, s AS (SELECT brand, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h,
      min(x) AS lo, max(x) AS hi FROM d GROUP BY 1),
    g AS (SELECT brand, n, h, CAST(i AS INTEGER) AS i, (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * i / 199 AS gx
      FROM s, range(200) r(i))
    SELECT g.brand, i, round(gx, 6) AS x,
    round(1e6 * sum(exp(-pow((gx - d.x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6)
      AS density_ppm FROM g JOIN d ON d.brand = g.brand GROUP BY g.brand, i, gx""",
)
def s12(spark, folder):
    out = stats.kde(monthly_rows(spark, folder), ["brand"], "value_sales")
    return out.select(
        "brand", "i", F.round("x", 6).alias("x"),
        F.round(1e6 * F.col("density"), 6).alias("density_ppm"),
    )


@query(
    "B15b_tail_of_series",
    f"WITH {LINES} SELECT date, {V} AS value_sales FROM lines GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
)
def b15b(spark, folder):
    rows = agg.grouped_sum(sales_lines(spark, folder, ()), ["date"], "value_sales")
    return tail_points(rows, 12)

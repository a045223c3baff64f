"""The named queries: each a (spark, folder) -> DataFrame function, most with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-11-15"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- SQL pieces shared by the oracles ------------------------------------------------

LINES = """lines AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, r_name AS market,
         c_mktsegment AS channel, p_type AS category, p_brand AS brand,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS v,
         CAST(l_quantity AS DECIMAL(18,4)) AS u
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""

FACT = LINES + """, cells AS (
  SELECT date, market, channel, category, brand, sum(v) AS v, sum(u) AS u
  FROM lines GROUP BY ALL),
fact AS (
  SELECT date, market, channel, category, brand, CAST(v AS DOUBLE) AS value_sales,
         CAST(u AS DOUBLE) AS unit_sales,
         round(100 * CAST(v AS DOUBLE) / CAST(sum(v) OVER
           (PARTITION BY date, market, channel, category) AS DOUBLE), 6) AS share
  FROM cells)"""

BOUNDS = f"""b AS (
  SELECT CAST(min(date) AS DATE) AS first_m, CAST(max(date) AS DATE) AS last_m,
         CAST(least(date_trunc('month', DATE '{AS_OF}') - INTERVAL 1 MONTH, max(date)) AS DATE)
           AS end_m
  FROM lines)"""


def total_sql(column: str) -> str:
    """Exact sum of a double column with four decimals."""
    return f"CAST(sum(CAST({column} AS DECIMAL(28,4))) AS DOUBLE)"


def mean_sql(column: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(28,{scale}))) AS DOUBLE) / count({column})"


def _beta_below(w: str, a: str, b: str) -> str:
    """Regularised incomplete beta by Simpson's rule over s, where t = w * s * s; a is a half or more."""
    return f"""(SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * CASE WHEN i = 0 AND 2 * ({a}) > 1 THEN 0 ELSE exp(({a}) * ln({w}) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b})
        + (({b}) - 1) * ln(1 - ({w}) * (i / 4000.0) * (i / 4000.0))) * 2 * pow(i / 4000.0, 2 * ({a}) - 1) END) / 12000.0
      FROM range(4001) s(i))"""


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution, integrated in SQL."""
    return f"(1 - {_beta_below(f'(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))', f'(({d1}) / 2.0)', f'(({d2}) / 2.0)')})"


def chi2_tail_sql(h: str, df: str) -> str:
    """Upper tail of the chi-squared distribution by Simpson's rule over s, where t = h * s * s."""
    return f"""(1 - (SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * CASE WHEN i = 0 AND ({df}) > 1 THEN 0 ELSE exp(({df}) / 2.0 * ln(({h}) / 2) - lgamma(({df}) / 2.0)
        - ({h}) / 2 * (i / 4000.0) * (i / 4000.0)) * 2 * pow(i / 4000.0, ({df}) - 1) END) / 12000.0
      FROM range(4001) s(i)))"""


def norm_tail_sql(z: str) -> str:
    """Upper tail of the standard normal distribution."""
    return f"(CASE WHEN ({z}) >= 0 THEN {chi2_tail_sql(f'({z}) * ({z})', '1')} / 2 ELSE 1 - {chi2_tail_sql(f'({z}) * ({z})', '1')} / 2 END)"


def _poly_sql(coefficients: str, x: str) -> str:
    """Horner's scheme over the written coefficients, highest power first."""
    first, *rest = coefficients.split()
    out = f"CAST({first} AS DOUBLE)"
    for c in rest:
        out = f"({out} * ({x}) + ({c}))"
    return out


def norm_quantile_sql(p: str) -> str:
    """Inverse of the standard normal distribution function, by Acklam's rational approximation."""
    # Acklam's coefficients.
    a = "-3.969683028665376e01 2.209460984245205e02 -2.759285104469687e02 1.383577518672690e02 -3.066479806614716e01 2.506628277459239e00"
    b = "-5.447609879822406e01 1.615858368580409e02 -1.556989798598866e02 6.680131188771972e01 -1.328068155288572e01 1.0"
    c = "-7.784894002430293e-03 -3.223964580411365e-01 -2.400758277161838e00 -2.549732539343734e00 4.374664141464968e00 2.938163982698783e00"
    d = "7.784695709041462e-03 3.224671290700398e-01 2.445134137142996e00 3.754408661907416e00 1.0"
    q, q2 = f"(({p}) - 0.5)", f"(({p}) - 0.5) * (({p}) - 0.5)"
    r = f"sqrt(-2 * ln(least(({p}), 1 - ({p}))))"
    return f"""(CASE WHEN least(({p}), 1 - ({p})) >= 0.02425 THEN {q} * {_poly_sql(a, q2)} / {_poly_sql(b, q2)}
      ELSE (CASE WHEN ({p}) < 0.5 THEN 1 ELSE -1 END) * {_poly_sql(c, r)} / {_poly_sql(d, r)} END)"""


# Tail of the studentised range for the rows of `tq` (k, q, v): Phi from its power series at steps of 0.01,
# the range of k normals by the trapezoid rule over the least of them, cubic between steps, and the
# trapezoid rule over the logarithm of the scale estimate.
RANGE_TAIL = """px AS (SELECT CAST(i AS BIGINT) AS i, i / 100.0 AS x FROM range(1, 801) r(i)),
  pu AS (SELECT i, 0.5 + sum(exp(-x * x / 2 - ln(2 * pi()) / 2 + (2 * n + 1) * ln(x) + n * ln(2.0)
    + lgamma(n + 1) - lgamma(2 * n + 2))) AS f FROM px, range(150) r(n) GROUP BY 1),
  phi AS (SELECT i, f FROM pu UNION ALL SELECT -i, 1 - f FROM pu UNION ALL SELECT 0, 0.5
    UNION ALL SELECT i, 1.0 FROM range(801, 2601) r(i)),
  ks AS (SELECT DISTINCT CAST(k AS DOUBLE) AS k FROM tq),
  gap AS (SELECT j, lo.i / 100.0 AS z, (lo.i + j) / 100.0 AS e, hi.f - lo.f AS g FROM range(1801) r(j)
    JOIN phi lo ON lo.i BETWEEN -800 AND 800 AND lo.i % 10 = 0 JOIN phi hi ON hi.i = lo.i + j),
  rt AS (SELECT k, j, sum(0.1 * k * exp(-z * z / 2) / sqrt(2 * pi()) * pow(g, k - 1)) AS c,
    sum(0.1 * k * (k - 1) * exp(-(z * z + e * e) / 2) / (2 * pi()) * pow(g, k - 2)) * 0.01 AS d
    FROM gap, ks GROUP BY 1, 2),
  rn AS (SELECT *, lead(c, 1, c) OVER w AS c1, lead(d, 1, 0) OVER w AS d1 FROM rt WINDOW w AS (PARTITION BY k ORDER BY j)),
  tn AS (SELECT *, row_number() OVER () AS row, 12 / sqrt(2 * v) AS top, 24 / sqrt(2 * v) + 30 / v AS wide FROM tq),
  ts AS (SELECT row, k, v, q, top - wide * i / 400.0 AS y FROM tn, range(401) r(i)),
  tw AS (SELECT row, k, exp(v * y - v * (exp(2 * y) - 1) / 2) AS mass, least(q * exp(y) * 100, 1800) AS w FROM ts),
  tu AS (SELECT row, k, mass, CAST(floor(w) AS BIGINT) AS j, w - floor(w) AS u FROM tw),
  tp AS (SELECT row, sum(mass * ((1 + 2 * u) * (1 - u) * (1 - u) * c + u * (1 - u) * (1 - u) * d
    + (3 - 2 * u) * u * u * c1 - (1 - u) * u * u * d1)) / sum(mass) AS below
    FROM tu JOIN rn ON rn.k = tu.k AND rn.j = tu.j GROUP BY 1),
  rp AS (SELECT tn.*, greatest(0, least(1, 1 - below)) AS p FROM tn LEFT JOIN tp USING (row))"""

RAW = """raw AS (
  SELECT
    CASE l_orderkey % 11
      WHEN 0 THEN CAST(datediff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR)
      WHEN 1 THEN strftime(l_shipdate, '%d-%m-%Y %H:%M:%S')
      WHEN 2 THEN CAST(day(l_shipdate) AS VARCHAR) || strftime(l_shipdate, ' %b %Y')
      WHEN 3 THEN strftime(l_shipdate, '%m/%d/%Y')
      WHEN 4 THEN ''
      WHEN 5 THEN 'n/a'
      WHEN 6 THEN CAST(datediff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR)
                  || '.5'
      WHEN 7 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "Month ",
    CASE WHEN l_orderkey % 11 = 8 THEN '  ' || r_name || ' ' ELSE r_name END AS "Country",
    c_mktsegment AS "Channel", p_type AS "Category", p_brand AS "Brand",
    CASE (l_orderkey + l_linenumber) % 13
      WHEN 0 THEN 'n/a' WHEN 1 THEN '-'
      WHEN 2 THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR) || ' '
      WHEN 3 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR)
      ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR) END AS "Value",
    CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR) AS "Units",
    CAST(NULL AS VARCHAR) AS "%Share"
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""

PARSED = RAW + """, texts AS (SELECT *, trim("Month ") AS t, trim("Value") AS vt FROM raw),
parsed AS (
  SELECT CASE WHEN regexp_full_match(t, '[0-9.]+')
      THEN TIMESTAMP '1899-12-30 00:00:00' + to_seconds(CAST(TRY_CAST(t AS DOUBLE) * 86400 AS BIGINT))
      ELSE try_strptime(t, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d-%m-%Y %H:%M:%S', '%d/%m/%Y',
                            '%d %b %Y', '%m/%d/%Y']) END AS ts,
    trim("Country") AS market, "Channel" AS channel, "Category" AS category, "Brand" AS brand,
    TRY_CAST(vt AS DOUBLE) AS value_sales, TRY_CAST("Units" AS DOUBLE) AS unit_sales,
    TRY_CAST("%Share" AS DOUBLE) AS share
  FROM texts),
ready AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS date, market, channel, category, brand,
                 value_sales, unit_sales, share FROM parsed)"""

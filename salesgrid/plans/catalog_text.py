"""Queries of the question, sentence, payload, dataset and answer jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions import formats as fmt
from salesgrid.operators import agg, compare, dataset, questions, verbalise
from salesgrid.operators import windows as win
from salesgrid.operators.spread import with_rank
from salesgrid.plans import answer as ans
from salesgrid.plans import payload as pay
from salesgrid.plans.catalog_sales import MAT, MAT_PREV, TWO, YOY, YTD, V, window, year_on_year
from salesgrid.plans.registry import AS_OF, BOUNDS, LINES, query, total_sql
from salesgrid.plans.sql import run_sql
from salesgrid.sources.fact import calendar, fact, months, read_table, sales_lines
from salesgrid.sources.files import stored

# One question per order line, in eleven forms, from the line's own values. The same text
# is SQL for both engines but for the month names.
ASKED = """CASE l_orderkey % 11
  WHEN 0 THEN concat('Top ', CAST(l_linenumber AS {string}), ' brands by value sales in MAT category: "', p_type, '"')
  WHEN 1 THEN concat('Unit sales YTD for brand: ', p_brand, ' and market: india')
  WHEN 2 THEN concat('Sales trend by brand from ', {month}, ' to Mar 2001')
  WHEN 3 THEN concat('category: ', lower(p_type), ' market: india total value sales')
  WHEN 4 THEN 'mat24 vs mat 2025 unit sales by brands, mat-2024 too'
  WHEN 5 THEN concat('yoy top 3 brands last 12 months channel:''', p_name, '''')
  WHEN 6 THEN concat('Monthly change (MoM) for ', p_brand, ', Brand#9 in 2001')
  WHEN 7 THEN 'Do not stop: tomato sales summary for automatic charting'
  WHEN 8 THEN concat('compare brands ', p_brand, ' and Brand#2 vs Brand#3')
  WHEN 9 THEN concat('What is the share of ', p_brand, ' over time?')
  ELSE concat('Overall sales of ', p_brand, ' in ', p_type) END"""
ASK_SPARK = ASKED.format(string="string", month="date_format(l_shipdate, 'MMM yyyy')")
ASK_DUCK = ASKED.format(string="VARCHAR", month="strftime(l_shipdate, '%b %Y')")
Q = f"""q AS (SELECT l_orderkey * 100 + l_linenumber AS question_id, {ASK_DUCK} AS text,
  lower({ASK_DUCK}) AS t FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def asked(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    part = read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey"))
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return rows.select(key.alias("question_id"), F.expr(ASK_SPARK).alias("text"))


MONTH_NUMBERS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
MONTH_RE = (
    r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\W*\d{4}\b"
)


# What the SQL of the questions looks for, written out so that the operator is not its own check.
SQL_CHART = r"\b(trends?|over time|time ?series|line charts?|charts?)\b"
SQL_TABLE = r"\b(top|bottom|tables?|rank(s|ed|ing)?)\b"
SQL_TEXT = r"\b(explain(s|ed)?|insights?|summary)\b"
SQL_MOM = r"\b(mom|m/m|month over month|monthly change)\b"
SQL_MAT = r"\b(mat(\s?-?(20)?\d{2})?|moving annual total|last 12|last twelve)\b"
SQL_YTD = r"\b(ytd|year to date|year-to-date)\b"
SQL_VALUE_END = (
    r"^(category|market|channel|brand)$|\s+\b(category|market|channel|brand)\b.*$"
    r"|(^|\s+)\b(from|between|in|for|by|over|last|ytd|mat|top|yoy|mom"
    r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\W*\d{4})\b.*$"
)
SQL_BRAND_LIST = r"\bbrands?(?:\s*[:\-]\s*|\s+)([a-z0-9 #_/,&+\-]+)"
SQL_LIST_SPLIT = r"\s*(?:,|&|\+|\band\b|\bvs\b|\bversus\b)\s*"
SQL_MAT_YEAR = r"\bmat[\s\-]?((?:20)?\d{2})\b"
SQL_COMPARE = r"\b(compare|vs|versus|comparison)\b"
SQL_TOTAL = r"(?i)\b(total|overall|aggregate|grand\s*total|sum|cumulative|combined|net\s+sales)\b"
SQL_TREND = r"(?i)\b(trend|over\s+time|month[-\s]*wise|monthly|line\s*chart|last\s+\d+\s+months)\b"


def _month_sql(i: int) -> str:
    hit = f"regexp_extract_all(t, '{MONTH_RE}')[{i}]"
    return (
        f"regexp_extract({hit}, '(\\d{{4}})', 1) || '-' || lpad(CAST(list_position({MONTH_NUMBERS},"
        f" substr({hit}, 1, 3)) AS VARCHAR), 2, '0')"
    )


def _filter_sql(dim: str) -> str:
    return f"""coalesce(
      nullif(trim(regexp_extract(t, '{dim}\\s*[:=]\\s*"([^"]+)"', 1)), ''),
      nullif(trim(regexp_extract(t, '{dim}\\s*[:=]\\s*''([^'']+)''', 1)), ''),
      nullif(trim(regexp_replace(regexp_extract(t, '{dim}\\s*[:=]\\s*([a-z0-9#][a-z0-9#\\s\\-&]*)', 1), '{SQL_VALUE_END}', '')), ''))"""


INTENT = f"""i AS (SELECT question_id, t,
  CASE WHEN regexp_matches(t, '{SQL_CHART}') THEN 'chart'
       WHEN regexp_matches(t, '{SQL_TABLE}') THEN 'topn'
       WHEN regexp_matches(t, '{SQL_TEXT}') THEN 'text' ELSE 'topn' END AS task,
  regexp_matches(t, '\\bunits?\\b') AS unit, regexp_matches(t, '\\byoy\\b') AS is_yoy,
  regexp_matches(t, '{SQL_MOM}') AS mom,
  TRY_CAST(nullif(regexp_extract(t, 'top\\s+(\\d+)', 1), '') AS BIGINT) AS n,
  CASE WHEN regexp_matches(t, '{SQL_YTD}') THEN 'YTD'
       WHEN regexp_matches(t, '{SQL_MAT}') THEN 'MAT' END AS mode,
  {_month_sql(1)} AS m1, {_month_sql(2)} AS m2,
  regexp_matches(t, '\\bby\\s+brands?\\b') AS by_brand,
  {_filter_sql('category')} AS filter_category, {_filter_sql('market')} AS filter_market,
  {_filter_sql('channel')} AS filter_channel, {_filter_sql('brand')} AS filter_brand FROM q)"""


@query(
    "J1_extract_intents",
    f"""WITH {Q}, {INTENT}, r AS (SELECT *, is_yoy AND regexp_matches(t, '\\b(top|bottom)\\b') AS yr FROM i)
    SELECT question_id, task, CASE WHEN unit THEN 'unit_sales' ELSE 'value_sales' END
      || CASE WHEN NOT is_yoy THEN '' WHEN unit THEN ',unit_yoy' ELSE ',value_yoy' END AS measures,
    concat_ws(',', CASE WHEN task <> 'topn' AND NOT yr THEN 'date' END, CASE WHEN (by_brand OR yr OR
      regexp_matches(t, '\\btop(\\s+\\d+)?\\s+brands?\\b')) AND (filter_brand IS NULL OR by_brand)
      THEN 'brand' END) AS dims, coalesce(n, 10) AS top_n,
    CASE WHEN yr THEN 'value_yoy' WHEN n IS NOT NULL THEN 'value_sales' WHEN is_yoy THEN 'value_yoy'
      WHEN mom THEN 'value_mom' END AS sort_by, is_yoy, mom, mode, by_brand
    FROM r""",
)
def j1(spark, folder):
    out = questions.extract_intents(asked(spark, folder))
    return out.select(
        "question_id", "task", F.array_join("measures", ",").alias("measures"),
        F.array_join("dims", ",").alias("dims"), "top_n", "sort_by", "is_yoy", "mom", "mode",
        "by_brand",
    )


@query(
    "J2_month_ranges",
    f"""WITH {Q}, {INTENT} SELECT question_id, m1 AS range_start, m2 AS range_end FROM i
    WHERE mode IS NULL AND m2 IS NOT NULL""",
)
def j2(spark, folder):
    out = questions.extract_intents(asked(spark, folder))
    return out.select("question_id", "range_start", "range_end").filter("range_end IS NOT NULL")


@query(
    "J3_filters",
    f"""WITH {Q}, {INTENT} SELECT question_id, filter_category, filter_market, filter_channel,
    filter_brand FROM i""",
)
def j3(spark, folder):
    out = questions.extract_intents(asked(spark, folder))
    return out.select("question_id", *[f"filter_{d}" for d in questions.FILTER_DIMS])


@query(
    "J4_match_brands",
    f"""WITH {Q}, k AS (SELECT question_id, text, t FROM q),
    e AS (SELECT *, list_filter(list_transform(flatten(list_transform(regexp_extract_all(t, '{SQL_BRAND_LIST}', 1),
      lambda s: regexp_split_to_array(s, '{SQL_LIST_SPLIT}'))),
      lambda s: regexp_extract_all(s, '[a-z0-9]+')), lambda s: len(s) > 0) AS items,
      regexp_extract_all(t, '[a-z0-9]+') AS w FROM k),
    b AS (SELECT DISTINCT p_brand AS brand, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS name FROM part),
    d AS (SELECT DISTINCT text, items, flatten(list_transform(items, lambda s: list_transform(range(1, 4),
      lambda n: array_to_string(s[1:n], '')))) AS begun, flatten(list_transform(range(1, 4), lambda n: list_transform(
      range(1, len(w) + 2 - n), lambda i: array_to_string(w[i:i + n - 1], '')))) AS runs FROM e),
    h AS (SELECT d.text, string_agg(brand, ',' ORDER BY brand) AS brands FROM d JOIN b ON
      CASE WHEN len(items) > 0 THEN list_contains(begun, name) ELSE list_contains(runs, name) END GROUP BY 1)
    SELECT question_id, text, coalesce(brands, '') AS brands FROM k LEFT JOIN h USING (text)""",
)
def j4(spark, folder):
    brands = read_table(spark, folder, "part").select(F.col("p_brand").alias("brand")).distinct()
    out = questions.match_brands(asked(spark, folder), brands)
    return out.select("question_id", "text", F.array_join("brands", ",").alias("brands"))


@query(
    "J5_mat_years",
    f"""WITH {Q}, y AS (SELECT question_id, t, list_transform(regexp_extract_all(t, '{SQL_MAT_YEAR}', 1),
      lambda s: CASE WHEN s::INT < 100 THEN s::INT + 2000 ELSE s::INT END) AS y FROM q)
    SELECT question_id, array_to_string(list_transform(list_filter(y, lambda x, i:
      list_position(y, x) = i), lambda x: x::VARCHAR), ',') AS mat_years,
    regexp_matches(t, '{SQL_MAT}') AND (regexp_matches(t, '{SQL_COMPARE}')
      OR len(list_distinct(y)) >= 2) AS is_mat_compare FROM y""",
)
def j5(spark, folder):
    out = questions.extract_mat_years(asked(spark, folder))
    years = F.array_join(F.col("mat_years").cast("array<string>"), ",")
    return out.select("question_id", years.alias("mat_years"), "is_mat_compare")


@query(
    "J6_calc_mode",
    f"""WITH {Q} SELECT question_id, CASE WHEN regexp_matches(text, '{SQL_TOTAL}') AND NOT
    regexp_matches(text, '{SQL_TREND}') THEN 'total' WHEN
    regexp_matches(text, '{SQL_TREND}') THEN 'trend' ELSE 'other' END AS calc_mode FROM q""",
)
def j6(spark, folder):
    return questions.calc_mode(asked(spark, folder)).select("question_id", "calc_mode")


# ---- sentences ------------------------------------------------------------------------


def rupees_sql(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) >= 1e7 THEN format('₹{{:.2f}}Cr', {x} / 1e7) WHEN abs({x}) >= 1e5 "
        f"THEN format('₹{{:.2f}}L', {x} / 1e5) WHEN {x} IS NOT NULL THEN format('₹{{:,.0f}}', {x}) "
        f"ELSE 'NA' END"
    )


def km_sql(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) >= 1e6 THEN format('{{:.1f}}M', {x} / 1e6) WHEN abs({x}) >= 1e3 "
        f"THEN format('{{:.1f}}K', {x} / 1e3) WHEN {x} IS NOT NULL THEN format('{{:.0f}}', {x}) END"
    )


def signed_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NA' WHEN {x} > 0 THEN '+' ELSE '' END || coalesce(format('{{:.2f}}%', {x} * 100), '')"


SPAN = "strftime(lo, '%b %d, %Y') || ' – ' || strftime(last_day(end_m), '%b %d, %Y')"
YTD_ITEMS = f"""i AS (SELECT category, brand, {V} AS x, any_value(end_m) AS end_m,
    CAST(date_trunc('year', any_value(end_m)) AS DATE) AS lo,
    row_number() OVER (PARTITION BY category ORDER BY {V} DESC, brand) AS rank
    FROM lines, b WHERE {YTD} GROUP BY 1, 2),
  g AS (SELECT category, any_value(lo) AS lo, any_value(end_m) AS end_m, list(struct_pack(l := brand, v := x)
    ORDER BY rank) AS xs, sum(x) AS shown, max(x) FILTER (rank = 1) - max(x) FILTER (rank = 2) AS gap,
    count(*) AS n FROM i WHERE rank <= 10 GROUP BY 1)"""
JOIN = "array_to_string({0}[1:-2], ', ') || ' and ' || {0}[-1]"


def _ytd_items(spark, folder):
    w = window(spark, folder, "YTD")
    lines = sales_lines(spark, folder, ("category", "brand"), w)
    sums = agg.grouped_sum(lines, ["category", "brand"], "value_sales")
    ranked = with_rank(sums, ["category"], "value_sales", tie=("brand",))
    return w, ranked.withColumnsRenamed({"brand": "label", "value_sales": "value"})


@query(
    "J7_say_top_n",
    f"""WITH {LINES}, {BOUNDS}, {YTD_ITEMS},
    s AS (SELECT *, list_transform(xs, lambda e: e.l || ' (' || {rupees_sql('e.v')} || ')') AS names,
      list_transform(xs[1:3], lambda e: e.l || ' ' || format('{{:.1f}}%', e.v / shown * 100)) AS sh FROM g)
    SELECT category, 0 AS pos, 'YTD window: ' || {SPAN} || '.' AS sentence FROM s
    UNION ALL SELECT category, 1, 'Largest value sales of ' || n || ' shown: ' || {JOIN.format('names')} || '.' FROM s
    UNION ALL SELECT category, 2, 'First to second: ' || xs[1].l || ' sells ' || {rupees_sql('gap')} || ' more than ' || xs[2].l || '.' FROM s
    UNION ALL SELECT category, 3, 'Parts of what these ' || n || ' sell: ' || {JOIN.format('sh')} || '.' FROM s""",
)
def j7_top(spark, folder):
    w, items = _ytd_items(spark, folder)
    return verbalise.say_top_n(items, ["category"], "value_sales", "YTD", w.start, w.end, variant=0)


@query(
    "J7b_say_total",
    f"""WITH {LINES}, {BOUNDS}, s AS (SELECT category, CAST(sum(u) AS DOUBLE) AS x, any_value(end_m) AS end_m,
      CAST(any_value(end_m) - INTERVAL 11 MONTH AS DATE) AS lo FROM lines, b WHERE {MAT} GROUP BY 1)
    SELECT category, 0 AS pos, 'MAT window: ' || {SPAN} || '.' AS sentence FROM s
    UNION ALL SELECT category, 1, category || ', whole window: ' || {km_sql('x')} || ' units.' FROM s
    UNION ALL SELECT category, 2, 'The mean month has ' || {km_sql('(x / 12)')} || ' units.' FROM s""",
)
def j7_total(spark, folder):
    w = window(spark, folder, "MAT")
    sums = agg.grouped_sum(sales_lines(spark, folder, ("category",), w), ["category"], "unit_sales")
    facts = sums.withColumn("label", F.col("category")).withColumnRenamed("unit_sales", "total")
    return verbalise.say_total(facts, ["category"], "unit_sales", "MAT", w.start, w.end, variant=0)


MAT3 = """p AS (SELECT 'MAT ' || y AS l, CAST(make_date(y, 9, 1) - INTERVAL 11 MONTH AS DATE) AS s,
    last_day(make_date(y, 9, 1)) AS e FROM (VALUES (1999), (2000), (2001)) AS years(y)),
  x AS (SELECT category, l, s, e, CAST(sum(v) AS DOUBLE) AS x, row_number() OVER (PARTITION BY category
    ORDER BY CAST(sum(v) AS DOUBLE) DESC, l) AS r FROM lines, p WHERE date BETWEEN s AND e GROUP BY 1, 2, 3, 4),
  g AS (SELECT category, list(struct_pack(l := l, s := s, e := e, x := x) ORDER BY r) AS t FROM x GROUP BY 1)"""


def _step_sql(a: int, b: int) -> str:
    return f"t[{a}].l || ' measured on ' || t[{b}].l || ': ' || {signed_sql(f'(t[{a}].x / t[{b}].x - 1)')} || '.'"


@query(
    "J7c_say_mat",
    f"""WITH {LINES}, {MAT3}
    SELECT category, 0 AS pos, t[1].l || ' is highest with ' || {rupees_sql('t[1].x')} || ' in value sales.' AS sentence FROM g
    UNION ALL SELECT category, 1, 'Months behind each total: ' || array_to_string(list_transform(t,
      lambda q: q.l || ': ' || q.s::VARCHAR || ' → ' || q.e::VARCHAR), '; ') || '.' FROM g
    UNION ALL SELECT category, 2, {_step_sql(1, 2)} FROM g
    UNION ALL SELECT category, 3, {_step_sql(2, 3)} FROM g
    UNION ALL SELECT category, 4, 'Yearly rate over the two steps: ' || format('{{:.2f}}%', (sqrt(t[1].x / t[3].x) - 1) * 100) || '.' FROM g""",
)
def j7_mat(spark, folder):
    years = [1999, 2000, 2001]
    span = win.hull(*[w for _, w in compare.mat_windows(years, 9)])
    lines = sales_lines(spark, folder, ("category",), span)
    periods = compare.mat_compare(lines, years, 9, ["category"])
    best = Window.partitionBy("category").orderBy(F.desc("value_sales"), "mat_label")
    periods = periods.withColumn("rank", F.row_number().over(best))
    return verbalise.say_mat(periods, ["category"], variant=0)


YOY_SAID = f"""y AS ({TWO.format(dims='category, brand', cur=MAT, prev=MAT_PREV)}),
  z AS (SELECT *, {YOY} AS g FROM y),
  r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY g DESC NULLS LAST, brand) AS rank FROM z),
  a AS (SELECT *, lag(g) OVER w AS up, lead(g) OVER w AS dn, avg(g) OVER (PARTITION BY category) AS m
    FROM r WINDOW w AS (PARTITION BY category ORDER BY rank))"""


@query(
    "J7d_say_yoy",
    f"""WITH {LINES}, {BOUNDS}, {YOY_SAID}
    SELECT category, 0 AS pos, 'YoY ranking of the top 10: ' || string_agg(rank || '. ' || brand || ' (' ||
      {signed_sql('g')} || ')', '; ' ORDER BY rank) || '.' AS sentence FROM a WHERE rank <= 10 GROUP BY 1
    UNION ALL SELECT category, rank::INT, '#' || rank || ' ' || brand || ': ' || {signed_sql('g')} || ', ' ||
      CASE WHEN rank = 1 THEN {signed_sql('(g - dn)')} || ' against #2'
        ELSE {signed_sql('(g - up)')} || ' against #' || (rank - 1) END || ', a change of ' ||
      {rupees_sql('(c - p)')} || ', ' || CASE WHEN g >= m THEN 'above' ELSE 'below' END || ' the average (' ||
      format('{{:.2f}}%', m * 100) || ').' FROM a WHERE rank <= 4
    UNION ALL SELECT category, 5, CASE WHEN count(*) FILTER (g > 0) > 0 AND count(*) FILTER (g < 0) = 0
      THEN 'All brands grow year on year.' WHEN count(*) FILTER (g < 0) > 0 AND count(*) FILTER (g > 0) = 0
      THEN 'All brands decline year on year.' ELSE count(*) FILTER (g > 0) || ' brands grow and ' ||
      count(*) FILTER (g < 0) || ' decline.' END FROM a GROUP BY 1""",
)
def j7_yoy(spark, folder):
    mat, lines = year_on_year(spark, folder, ("category", "brand"))
    rows = compare.yoy(lines, ["category", "brand"], "value_sales", mat)
    items = rows.select("category", "brand", F.col("value_sales_curr").alias("curr"),
                        F.col("value_sales_prev").alias("prev"), F.col("value_yoy").alias("yoy_pct"))
    ranked = stored(with_rank(stored(items), ["category"], "yoy_pct", tie=("brand",)))
    return verbalise.say_yoy(ranked, ["category"], variant=0)


TREND = """m AS (SELECT category, brand, date, CAST(sum(v) AS DOUBLE) AS x FROM lines GROUP BY 1, 2, 3),
  o AS (SELECT category, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1),
  od AS (SELECT category, any_value(hi) AS hi, min(date) FILTER (x = lo) AS lod, min(date) FILTER (x = hi) AS hid
    FROM m JOIN o USING (category) GROUP BY 1),
  bb AS (SELECT category, brand, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1, 2),
  bd AS (SELECT category, brand, any_value(lo) AS lo, any_value(hi) AS hi, min(date) FILTER (x = lo) AS lod
    FROM m JOIN bb USING (category, brand) GROUP BY 1, 2),
  dr AS (SELECT *, (hi - lo) / hi AS d, row_number() OVER (PARTITION BY category ORDER BY (hi - lo) / hi DESC,
    brand) AS r FROM bd WHERE hi > 0 AND lo <> 0),
  tr AS (SELECT category, strftime(lod, '%b %Y') AS l, count(*) AS n, min(lod) AS d FROM bd GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, min(lod)) = 1)"""


@query(
    "J7e_say_trend",
    f"""WITH {LINES}, {TREND}
    SELECT category, 0 AS pos, 'The peak is ' || strftime(hid, '%b %Y') || ' at ' || {rupees_sql('hi')} ||
      '; the low is ' || strftime(lod, '%b %Y') || '.' AS sentence FROM od
    UNION ALL SELECT category, CAST(1 + (r - 1) // 10 AS INTEGER), 'Drops from high to low, places ' || min(r) || ' to ' || max(r) || ': ' ||
      string_agg(brand || ' ~' || format('{{:.0f}}', d * 100) || '%', ', ' ORDER BY r) || '.' FROM dr GROUP BY 1, 2
    UNION ALL SELECT category, CAST(1 + coalesce((SELECT max((r - 1) // 10) + 1 FROM dr WHERE dr.category = tr.category), 0) AS INTEGER),
      'Low month of several items: ' || l || '.' FROM tr WHERE n >= 2""",
)
def j7_trend(spark, folder):
    lines = sales_lines(spark, folder, ("category", "brand"))
    points = agg.grouped_sum(lines, ["category", "brand", "date"], "value_sales")
    return verbalise.say_trend(points, ["category"], variant=0)


@query(
    "J7f_say_latest",
    f"""WITH {LINES}, m AS (SELECT date, brand, {V} AS x FROM lines GROUP BY 1, 2),
    d AS (SELECT max(date) AS a, max(date) FILTER (date < (SELECT max(date) FROM m)) AS b FROM m),
    r AS (SELECT m.*, row_number() OVER (ORDER BY x DESC, brand) AS r FROM m, d WHERE date = a),
    p AS (SELECT m.* FROM m, d WHERE date = b),
    f AS (SELECT r1.brand AS l, r1.x AS v, r1.x / p.x - 1 AS c, r2.brand AS l2, r2.x AS v2, r3.brand AS l3,
      r3.x AS v3 FROM r r1 JOIN r r2 ON r2.r = 2 JOIN r r3 ON r3.r = 3 LEFT JOIN p ON p.brand = r1.brand
      WHERE r1.r = 1)
    SELECT 0 AS pos, l || ' leads the latest month with ' || {km_sql('v')} || ' value sales' || coalesce(' (' ||
      CASE WHEN c >= 0 THEN 'up' ELSE 'down' END || ' ' || format('{{:.1f}}%', abs(c) * 100) ||
      ' on the month before)', '') || '.' AS sentence FROM f
    UNION ALL SELECT 1, 'Lead over ' || l2 || ': ' || {km_sql('(v - v2)')} || '.' FROM f
    UNION ALL SELECT 2, 'Third is ' || l3 || ' with ' || {km_sql('v3')} || '.' FROM f""",
)
def j7_latest(spark, folder):
    facts = compare.latest_leader(sales_lines(spark, folder, ("brand",)), "brand", "value_sales")
    return verbalise.say_latest(facts, "value_sales", variant=0)


@query(
    "J7g_say_concentration",
    f"""WITH {LINES}, s AS (SELECT category, {V} AS x FROM lines GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY x DESC, category) AS r, {total_sql('x')} OVER () AS t FROM s),
    f AS (SELECT max(category) FILTER (r = 1) AS l, max(x) FILTER (r = 1) AS v, max(category) FILTER (r = 2) AS l2,
      max(x) FILTER (r = 2) AS v2, any_value(t) AS t, sum((x / t) * (x / t)) AS h FROM r)
    SELECT 0 AS pos, format('{{:.0f}}%', v / t * 100) || ' of value sales come from one category: ' || l || ', ' ||
      format('{{:,.0f}}', v) || '.' AS sentence FROM f
    UNION ALL SELECT 1, CASE WHEN h >= 0.2 THEN 'Few items make most of the sum.' ELSE
      'No item makes much of the sum.' END FROM f WHERE h >= 0.2 OR h <= 0.1
    UNION ALL SELECT CASE WHEN h >= 0.2 OR h <= 0.1 THEN 2 ELSE 1 END, l2 || ' comes next; ' || l || ' sells ' ||
      format('{{:,.0f}}', v - v2) || ' more (' || format('{{:+.0f}}%', (v - v2) / v2 * 100) || ').' FROM f""".replace(
        f"{total_sql('x')} OVER ()", "CAST(sum(CAST(x AS DECIMAL(28,4))) OVER () AS DOUBLE)"
    ),
)
def j7_concentration(spark, folder):
    facts = agg.concentration(sales_lines(spark, folder, ("category",)), "category")
    return verbalise.say_concentration(facts, "category", "value_sales")


@query(
    "J7h_say_fallback",
    f"""WITH {LINES}, s AS (SELECT category, brand, {V} AS x FROM lines GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY {V} DESC, brand) = 1)
    SELECT category, CASE WHEN category = 'LARGE' THEN 'Nothing in these figures stands out.'
    ELSE 'Largest value sales: ' || brand || ', ' || format('{{:,.0f}}', x) || '.' END AS sentence FROM s""",
)
def j7_fallback(spark, folder):
    rows = agg.grouped_sum(sales_lines(spark, folder, ("category", "brand")), ["category", "brand"],
                           "value_sales")
    top = agg.first_per_key(rows, ["category"], [F.desc("value_sales"), F.asc("brand")])
    facts = top.select(
        "category", F.when(F.col("category") != "LARGE", F.col("brand")).alias("label"),
        F.col("value_sales").alias("value"), F.lit("value_sales").alias("measure"),
    )
    return verbalise.say_fallback(facts, ["category"])


@query(
    "J8_route_payload",
    """WITH o AS (SELECT o_orderkey, ['MAT_COMPARE', 'YTD', 'BAR', 'LINE', ''][1 + o_orderkey % 5] AS mode,
      ['mat', 'ytd', 'total value_sales', ''][1 + o_custkey % 4] AS calc, o_orderkey % 7 = 0 AS trend,
      o_orderkey % 9 = 0 AS yoy, o_custkey % 3 AS n, o_custkey % 2 = 0 AS bb FROM orders)
    SELECT o_orderkey, CASE WHEN mode = 'MAT_COMPARE' THEN 'mat_compare' WHEN trend THEN 'trend'
      WHEN yoy THEN 'yoy' WHEN calc = 'mat' AND n >= 2 AND bb THEN 'mat_top_n'
      WHEN calc = 'mat' AND n = 1 THEN 'mat_total'
      WHEN (mode = 'YTD' OR calc = 'ytd') AND n >= 2 AND bb THEN 'ytd_top_n'
      WHEN (mode = 'YTD' OR calc = 'ytd') AND n = 1 THEN 'ytd_total'
      WHEN mode = 'BAR' AND n = 1 THEN 'total' ELSE 'none' END AS family FROM o""",
)
def j8(spark, folder):
    orders = read_table(spark, folder, "orders")
    modes = F.array(*[F.lit(m) for m in ("MAT_COMPARE", "YTD", "BAR", "LINE", "")])
    calcs = F.array(*[F.lit(m) for m in ("mat", "ytd", "total value_sales", "")])
    rows = orders.select(
        "o_orderkey",
        F.get(modes, (F.col("o_orderkey") % 5).cast("int")).alias("mode"),
        F.get(calcs, (F.col("o_custkey") % 4).cast("int")).alias("calculation_mode"),
        F.lit(False).alias("has_mat"),
        (F.col("o_orderkey") % 7 == 0).alias("has_trend"),
        (F.col("o_orderkey") % 9 == 0).alias("has_yoy"),
        (F.col("o_custkey") % 3).alias("n_items"),
        (F.col("o_custkey") % 2 == 0).alias("by_brand"),
    )
    return verbalise.route_payload(rows).select("o_orderkey", "family")


@query(
    "J9_number_formats",
    f"""WITH {LINES}, m AS (SELECT brand, date, {V} AS x FROM lines GROUP BY 1, 2),
    g AS (SELECT *, x / lag(x) OVER (PARTITION BY brand ORDER BY date) - 1 AS g FROM m)
    SELECT brand, date, {km_sql('x')} AS km, {rupees_sql('(x * 10)')} AS rs,
    format('{{:.1f}}%', g * 100) AS pct, {signed_sql('g')} AS signed,
    '₹' || regexp_replace(format('{{:.2f}}', x / 1e5), '\\.00$', '') || ' Cr' AS crore,
    'Jan–' || strftime(date, '%b %Y') || ' (YTD)' AS period
    FROM g""",
)
def j9(spark, folder):
    lines = sales_lines(spark, folder, ("brand",))
    rows = compare.mom(lines, ["brand"], "value_sales")
    x, g = F.col("value_sales"), F.col("value_mom")
    text = F.concat(F.date_format("date", "yyyy"), F.lit("-01 to "), F.date_format("date", "yyyy-MM"), F.lit(" ytd"))
    return rows.select(
        "brand", "date", fmt.k_m(x).alias("km"), fmt.rupees(x * 10).alias("rs"),
        fmt.pct(g).alias("pct"), fmt.signed_pct(g).alias("signed"), fmt.crore(x / 1e5).alias("crore"),
        fmt.period_text(text).alias("period"),
    )


@query(
    "J10_wording_bands",
    f"""WITH {LINES}, m AS (SELECT brand, date, {V} AS x FROM lines GROUP BY 1, 2),
    g AS (SELECT *, 100 * (x / lag(x) OVER w - 1) AS g, x / 300000 AS s, lag(x) OVER w / 300000 AS ps FROM m
      WINDOW w AS (PARTITION BY brand ORDER BY date)),
    h AS (SELECT *, CASE WHEN abs(s) <= 1 THEN s * 100 ELSE s END AS sp, CASE WHEN abs(ps) <= 1 THEN ps * 100
      ELSE ps END AS pp FROM g)
    SELECT brand, date, CASE WHEN g >= 15 THEN 'surged' WHEN g >= 8 THEN 'grew' WHEN g >= 3 THEN 'inched up'
      WHEN g > -3 THEN 'was flat' WHEN g > -8 THEN 'softened' WHEN g > -15 THEN 'declined' ELSE 'contracted' END AS word,
    CASE WHEN sp >= 50 THEN 'dominates with ' || format('{{:.1f}}%', sp) || ' share'
      WHEN sp >= 35 THEN 'leads with ' || format('{{:.1f}}%', sp) || ' share'
      WHEN sp >= 28 THEN 'holds ' || format('{{:.1f}}%', sp) || ' share'
      WHEN sp >= 22 THEN 'has a narrow lead at ' || format('{{:.1f}}%', sp)
      ELSE 'has ' || format('{{:.1f}}%', sp) || ' share' END AS phrase,
    CASE WHEN pp IS NULL THEN 'vs' WHEN abs(sp - pp) < 2 THEN 'is neck-and-neck with'
      WHEN abs(sp - pp) < 5 THEN 'has a narrow lead over' WHEN abs(sp - pp) < 10 THEN 'leads over'
      ELSE 'is well ahead of' END AS edge FROM h""",
)
def j10(spark, folder):
    rows = compare.mom(sales_lines(spark, folder, ("brand",)), ["brand"], "value_sales")
    first = F.lit(0)
    share, before = F.col("value_sales") / 300000, F.col("value_sales_prev") / 300000
    return rows.select(
        "brand", "date", fmt.growth_words(100 * F.col("value_mom"), first).alias("word"),
        fmt.share_phrase(share, first).alias("phrase"),
        fmt.pair_edge(share, before, first).alias("edge"),
    )


# ---- instruction rows -----------------------------------------------------------------


def summary_rows(spark, folder):
    """Yearly category and market rows in the shape of the instruction source."""
    lines = sales_lines(spark, folder, ("market", "category", "brand"))
    keys = ["category", "market", "year"]
    lines = lines.withColumn("year", F.year("date"))
    brands = agg.grouped_sum(lines, [*keys, "brand"], "value_sales")
    totals = agg.grouped_sum(brands, keys, "value_sales").withColumnRenamed("value_sales", "total")
    best = Window.partitionBy(*keys).orderBy(F.desc("value_sales"), "brand")
    top = brands.withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    wide = top.join(totals, keys)
    share = F.round(F.col("value_sales") / F.col("total"), 4)
    leader = F.struct(
        "rank", "brand", share.alias("share"), F.round(F.col("value_sales") / 1e5, 2).alias("ytd_cr")
    )
    one = wide.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(leader)).alias("leaders"))
    series = Window.partitionBy("category", "market").orderBy("year")
    prev = F.lag("total").over(series)
    return one.select(
        "category",
        "market",
        F.concat(F.col("year").cast("string"), F.lit("-01 to "), F.col("year").cast("string"),
                 F.lit("-12 YTD")).alias("period"),
        F.round(F.col("total") / 1e5, 2).alias("ytd_sales_cr"),
        F.round(F.col("total") / prev - 1, 4).alias("yoy"),
        "leaders",
    )


@query("J11_nlg_summaries")
def j11(spark, folder):
    rows = summary_rows(spark, folder).withColumn("task", F.lit("ytd_summary"))
    return dataset.nlg_summaries(rows, k=3, k_ytd=4)


@query("J12_nlg_pairs")
def j12(spark, folder):
    rows = summary_rows(spark, folder).filter(F.size("leaders") == 2)
    a, b = F.get("leaders", 0), F.get("leaders", 1)
    none = F.lit(None).cast("double")
    pairs = rows.select(
        F.lit("brand_pair").alias("task"), "category", "market", "period",
        a["brand"].alias("brand_a"), b["brand"].alias("brand_b"),
        a["ytd_cr"].alias("ytd_cr_a"), b["ytd_cr"].alias("ytd_cr_b"),
        a["share"].alias("share_a"), b["share"].alias("share_b"), none.alias("yoy_a"), none.alias("yoy_b"),
    )
    return dataset.nlg_pairs(pairs, 3, ("category", "market", "period", "brand_a", "brand_b"))


SAID = """CASE o_orderkey % 3 WHEN 0 THEN 'Sales reached ₹' || a || ' Cr, up ' || p || '%'
  WHEN 1 THEN 'Sales reached ₹' || a2 || ' Cr' ELSE 'Up ' || p2 || '% on ₹ ' || a || ' Cr' END"""


def said_rows(spark, folder):
    """One sentence per order with its amount and growth; some sentences misstate one."""
    orders = read_table(spark, folder, "orders")
    cr = F.round(F.col("o_totalprice") / 1e4, 2)
    yoy = (F.col("o_custkey") % 41 - 20) / 100.0
    f2, f1 = lambda c: F.format_string("%.2f", c), lambda c: F.format_string("%.1f", c)
    kind = F.col("o_orderkey") % 3
    a, a2, p, p2 = f2(cr), f2(cr + 1), f1(yoy * 100), f1(yoy * 100 + 3)
    said = (
        F.when(kind == 0, F.concat(F.lit("Sales reached ₹"), a, F.lit(" Cr, up "), p, F.lit("%")))
        .when(kind == 1, F.concat(F.lit("Sales reached ₹"), a2, F.lit(" Cr")))
        .otherwise(F.concat(F.lit("Up "), p2, F.lit("% on ₹ "), a, F.lit(" Cr")))
    )
    return orders.select(
        "o_orderkey", cr.alias("ytd_sales_cr"), yoy.alias("yoy"), said.alias("text")
    )


SAID_SQL = f"""s0 AS (SELECT o_orderkey, round(o_totalprice / 1e4, 2) AS cr, (o_custkey % 41 - 20) / 100.0 AS yoy FROM orders),
  s1 AS (SELECT o_orderkey, cr, yoy, format('{{:.2f}}', cr) AS a, format('{{:.2f}}', cr + 1) AS a2,
    format('{{:.1f}}', CAST(yoy AS DOUBLE) * 100) AS p, format('{{:.1f}}', CAST(yoy AS DOUBLE) * 100 + 3) AS p2 FROM s0),
  s AS (SELECT o_orderkey, cr, CAST(yoy AS DOUBLE) AS yoy, {SAID} AS text FROM s1)"""


@query(
    "J13_numbers_supported",
    f"""WITH {SAID_SQL}, n AS (SELECT o_orderkey, cr, yoy, text,
      list_transform(regexp_extract_all(text, '₹\\s*([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: x::DOUBLE) AS m,
      list_transform(regexp_extract_all(text, '(-?[0-9]+(?:\\.[0-9]+)?)%', 1), lambda x: x::DOUBLE) AS q FROM s)
    SELECT o_orderkey, text, len(list_filter(m, lambda x: abs(x - cr) > 0.02 + 1e-9)) = 0 AND
      len(list_filter(q, lambda x: abs(x - CASE WHEN x < 0 THEN yoy ELSE abs(yoy) END * 100) > 0.2 + 1e-9)) = 0 AS supported FROM n""",
)
def j13(spark, folder):
    return dataset.numbers_supported(said_rows(spark, folder)).select("o_orderkey", "text", "supported")


@query(
    "J14_not_wordy",
    """SELECT conv_id, turn, text FROM conversations WHERE CASE WHEN trim(regexp_replace(text, '•|\\s+', ' ', 'g')) = ''
    THEN 0 ELSE len(regexp_split_to_array(trim(regexp_replace(text, '•|\\s+', ' ', 'g')), '\\s+')) END <= 26""",
)
def j14(spark, folder):
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return dataset.not_wordy(rows, "text")


def instruction_rows(spark, folder):
    """One instruction row per order; its source JSON names a task, or there is none."""
    orders = read_table(spark, folder, "orders")
    kind = F.col("o_orderkey") % 4
    task = F.when(kind == 0, "ytd_summary").when(kind == 1, "MAT_summary").otherwise("brand_pair")
    source = F.to_json(F.struct(task.alias("task"), "o_custkey"))
    text = F.when(kind == 3, "Write a line.").otherwise(
        F.concat(F.lit("Write a line.\n\nJSON:\n"), source)
    )
    return orders.select("o_orderkey", text.alias("instruction"))


TASKS = """t AS (SELECT o_orderkey, ['ytd_summary', 'mat_summary', 'brand_pair', ''][1 + o_orderkey % 4] AS task FROM orders)"""


@query(
    "J15_oversample",
    f"""WITH {TASKS} SELECT o_orderkey FROM t, range(3) r(i) WHERE i = 0 OR task = 'ytd_summary'""",
)
def j15(spark, folder):
    return dataset.oversample(instruction_rows(spark, folder), "ytd_summary", 3).select("o_orderkey")


@query(
    "J16_task_counts",
    f"WITH {TASKS} SELECT task, count(*) * CASE WHEN task = 'ytd_summary' THEN 3 ELSE 1 END AS rows FROM t GROUP BY 1",
)
def j16(spark, folder):
    return dataset.task_counts(dataset.oversample(instruction_rows(spark, folder)))


@query(
    "J17_split_train_val",
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 9000
    THEN 'train' ELSE 'val' END AS split FROM documents""",
)
def j17(spark, folder):
    return dataset.split_train_val(read_table(spark, folder, "documents").select("doc_id"), "doc_id")


SENTENCES = """s AS (SELECT {id}, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,
  '\\n+', ' ', 'g'), '([.!?])\\s+([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30)),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM {table})
SELECT {id}, CAST(i - 1 AS INTEGER) AS pos, l[i] AS sentence FROM (SELECT {id}, l, unnest(range(1, len(l) + 1)) AS i FROM s)"""


@query("J18_split_sentences", "WITH " + SENTENCES.format(id="doc_id", table="documents"))
def j18(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return dataset.split_sentences(docs, "text")


@query("J18b_split_conversations", "WITH " + SENTENCES.format(id="conv_id, turn", table="conversations"))
def j18b(spark, folder):
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return dataset.split_sentences(turns, "text")


def _payloads(spark, folder, kinds=pay.KINDS, page_size=pay.PAGE):
    years, known = [1999, 2000, 2001], months(spark, folder)
    last, ytd = win.last_month(known), win.resolve_window(known, "YTD", as_of=AS_OF)
    grown = (win.mat_period(2001, 9), win.ytd_period(2001, 9))
    span = win.hull(
        ytd, *[w for _, w in compare.mat_windows(years, 9, last)],
        *[win.with_prev_year(win.MonthWindow.period(p, True)) for p in grown],
    )
    lines = sales_lines(spark, folder, ("category", "brand"), span)
    return pay.build_payloads(lines, years, 9, ytd, last=last, kinds=kinds, page_size=page_size)


def _yoy_items(label: str, cur: str, prev: str) -> str:
    return f"""SELECT '{label}' AS kind, category, row_number() OVER (PARTITION BY category ORDER BY g DESC, brand) AS place,
      brand AS label, c AS value FROM (SELECT *, CASE WHEN p <> 0 THEN c / p - 1 ELSE 0 END AS g FROM
        (SELECT category, brand, CAST(sum(v) FILTER (date BETWEEN {cur}) AS DOUBLE) AS c,
         CAST(sum(v) FILTER (date BETWEEN {prev}) AS DOUBLE) AS p FROM lines GROUP BY 1, 2
         HAVING count(*) FILTER (date BETWEEN {cur}) > 0))"""


@query(
    "J19_build_payloads",
    f"""WITH {LINES}, {BOUNDS}, {MAT3}, i AS (
    SELECT 'mat_compare' AS kind, category, r AS place, l AS label, x AS value FROM x
    UNION ALL {_yoy_items('mat_yoy', "DATE '2000-10-01' AND DATE '2001-09-30'", "DATE '1999-10-01' AND DATE '2000-09-30'")}
    UNION ALL {_yoy_items('ytd_yoy', "DATE '2001-01-01' AND DATE '2001-09-30'", "DATE '2000-01-01' AND DATE '2000-09-30'")}
    UNION ALL SELECT 'total', category, 1, category, CAST(sum(v) AS DOUBLE) FROM lines, b WHERE {YTD} GROUP BY 2
    UNION ALL SELECT 'trend', category, row_number() OVER (PARTITION BY category ORDER BY brand), brand, min(x) FROM
      (SELECT category, brand, date, CAST(sum(v) AS DOUBLE) AS x FROM lines, b WHERE {YTD} GROUP BY 1, 2, 3) GROUP BY 2, 4)
    SELECT kind, category, CAST((place - 1) // 10 + 1 AS INTEGER) AS page, place, label, round(value, 2) AS value FROM i""",
)
def j19(spark, folder):
    """Every item of every payload, read back from the JSON of pages of ten."""
    at = {"mat_compare": "$.mat_compare.periods", "total": "$.bar.items", "trend": "$.trend.by_brand"}
    items = F.get_json_object("payload", "$.yoy.items")
    for kind, path in at.items():
        items = F.when(F.col("kind") == kind, F.get_json_object("payload", path)).otherwise(items)
    form = """array<struct<rank: bigint, mat_label: string, label: string, brand: string,
      value: double, curr: double, min: struct<value: double>>>"""
    rows = _payloads(spark, folder, page_size=10).select("kind", "category", "page", F.explode(F.from_json(items, form)).alias("i"))
    return rows.select(
        "kind", "category", "page", F.col("i.rank").alias("place"),
        F.coalesce("i.mat_label", "i.label", "i.brand").alias("label"),
        F.round(F.coalesce("i.value", "i.curr", "i.min.value"), 2).alias("value"),
    )


@query(
    "J20_payload_mode",
    f"WITH {LINES} SELECT DISTINCT category, 'mat_yoy' AS calculation_mode FROM lines",
)
def j20(spark, folder):
    out = pay.payload_mode(_payloads(spark, folder, ("mat_yoy",)), "mat_yoy")
    return out.select("category", "calculation_mode")


@query("J21_paraphrase")
def j21(spark, folder):
    facts = compare.latest_leader(sales_lines(spark, folder, ("brand",)), "brand", "value_sales")
    said = verbalise.say_latest(facts, "value_sales", variant=0)
    w, items = _ytd_items(spark, folder)
    tops = verbalise.say_top_n(items, ["category"], "value_sales", "YTD", w.start, w.end, variant=0)
    rows = said.select("sentence").unionByName(tops.select("sentence"))
    return dataset.paraphrase(rows, "sentence", "sentence", 5)


@query(
    "J22_select_insight_types",
    f"""WITH {LINES}, m AS (SELECT category, date, {V} AS x FROM lines GROUP BY 1, 2),
    g AS (SELECT *, 100 * (x / lag(x) OVER (PARTITION BY category ORDER BY date) - 1) AS g FROM m)
    SELECT category, date, concat_ws(',', CASE WHEN abs(coalesce(g, 0)) >= 3 THEN 'category_yoy_growth' END,
      CASE WHEN month(date) % 2 > 0 THEN 'rank_up' END, CASE WHEN month(date) % 3 > 0 THEN 'top_gainer_brand' END)
      AS insight_types FROM g""",
)
def j22(spark, folder):
    rows = compare.mom(sales_lines(spark, folder, ("category",)), ["category"], "value_sales")
    facts = rows.select(
        "category", "date", (100 * F.col("value_mom")).alias("yoy_pct"),
        (F.month("date") % 2).alias("rank_changes"), (F.month("date") % 3).alias("topn"),
    )
    out = dataset.select_insight_types(facts)
    return out.select("category", "date", F.array_join("insight_types", ",").alias("insight_types"))


# ---- SQL and answers ------------------------------------------------------------------


@query(
    "Q1_read_only_sql",
    f"""WITH {LINES} SELECT category, {V} AS value_sales, count(DISTINCT brand) AS brands FROM lines
    WHERE date >= DATE '2000-01-01' GROUP BY 1""",
)
def q1(spark, folder):
    fact(spark, folder).createOrReplaceTempView("fact")
    return run_sql(
        spark,
        """SELECT category, CAST(sum(CAST(value_sales AS decimal(28,4))) AS double) AS value_sales,
        count(DISTINCT brand) AS brands FROM fact WHERE date >= DATE '2000-01-01' GROUP BY 1;""",
    )


def _ask(spark, folder, intent, dims=("market", "channel", "category", "brand")):
    known = months(spark, folder)
    return ans.answer(sales_lines(spark, folder, dims, ans.months_read(intent, AS_OF, known)), intent, AS_OF, known)


@query(
    "Q2_answer_top_n",
    f"""WITH {LINES}, {BOUNDS} SELECT brand, {V} AS value_sales FROM lines, b WHERE {MAT} AND
    category = 'PROMO' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def q2(spark, folder):
    intent = ans.Intent(dims=("brand",), filters={"category": "promo"}, mode="MAT", top_n=3)
    return _ask(spark, folder, intent, ("category", "brand"))


@query(
    "Q2b_answer_yoy",
    f"""WITH {LINES}, {BOUNDS}, y AS ({TWO.format(dims='brand', cur=MAT, prev=MAT_PREV)})
    SELECT brand, c AS value_sales_curr, coalesce(p, 0) AS value_sales_prev,
    round(coalesce({YOY}, 0), 6) AS value_yoy FROM y ORDER BY {YOY} DESC NULLS LAST, brand LIMIT 10""",
)
def q2b(spark, folder):
    intent = ans.parse_question(spark, "yoy top 10 sales by brand MAT")
    out = _ask(spark, folder, intent, ("brand",))
    return out.withColumn("value_yoy", F.round("value_yoy", 6))


@query(
    "Q2c_answer_mat_compare",
    f"""WITH {LINES}, {BOUNDS}, p AS (SELECT y, CAST(least(make_date(y, 10, 1), last_m) AS DATE) AS e FROM b,
      (VALUES (2001), (2000)) AS years(y))
    SELECT CAST(CASE WHEN y = 2001 THEN 0 ELSE 1 END AS INTEGER) AS pos, 'MAT ' || y AS mat_label,
    CAST(e - INTERVAL 11 MONTH AS DATE) AS start, last_day(e) AS "end", CAST(sum(u) AS DOUBLE) AS unit_sales
    FROM lines, p WHERE date BETWEEN e - INTERVAL 11 MONTH AND e GROUP BY y, e""",
)
def q2c(spark, folder):
    intent = ans.parse_question(spark, "compare unit sales mat 2001 vs mat 2000")
    return _ask(spark, folder, intent, ())


@query(
    "Q2d_answer_mom",
    f"""WITH {LINES}, m AS (SELECT date, {V} AS x FROM lines WHERE market = 'ASIA' AND date BETWEEN
      DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1), g AS (SELECT *, lag(x) OVER (ORDER BY date) AS px FROM m)
    SELECT date, x AS value_sales, coalesce(px, 0) AS value_sales_prev, round(coalesce(x / px - 1, 0), 6)
    AS value_mom FROM g""",
)
def q2d(spark, folder):
    intent = ans.parse_question(spark, "mom sales in market: 'asia' from Jan 2000 to Dec 2000")
    out = _ask(spark, folder, intent, ("market",))
    return out.withColumn("value_mom", F.round("value_mom", 6))


@query(
    "Q2e_answer_chart",
    f"""WITH {LINES}, {BOUNDS} SELECT date, brand, {V} AS value_sales FROM lines, b WHERE {YTD} GROUP BY 1, 2""",
)
def q2e(spark, folder):
    intent = ans.parse_question(spark, "sales trend by brand ytd")
    return _ask(spark, folder, intent, ("brand",))


@query(
    "Q2f_answer_total",
    f"""WITH {LINES} SELECT 'economy' AS category, {V} AS value_sales FROM lines WHERE category = 'ECONOMY'""",
)
def q2f(spark, folder):
    intent = ans.parse_question(spark, "what are the sales of category: economy")
    return _ask(spark, folder, intent, ("category",))

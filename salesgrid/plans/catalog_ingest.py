"""Queries of the source and ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesgrid.operators import agg
from salesgrid.plans.registry import FACT, LINES, PARSED, RAW, query
from salesgrid.sources import fact as src
from salesgrid.sources import files, ingest


def raw_sheet(spark, folder):
    """Order lines as a badly kept sheet: text cells, mixed dates, junk and padded values."""
    lines = src.read_table(spark, folder, "lineitem")
    part = src.read_table(spark, folder, "part")
    orders = src.read_table(spark, folder, "orders")
    customer = src.read_table(spark, folder, "customer")
    nation = src.read_table(spark, folder, "nation")
    region = src.read_table(spark, folder, "region")
    bought = (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    full = lines.join(bought, F.col("o_orderkey") == F.col("l_orderkey")).join(
        part, F.col("p_partkey") == F.col("l_partkey")
    )
    kind = F.col("l_orderkey") % 11
    ship = F.col("l_shipdate")
    serial = F.datediff(ship, F.lit("1899-12-30")).cast("string")
    date = (
        F.when(kind == 0, serial)
        .when(kind == 1, F.date_format(ship, "dd-MM-yyyy HH:mm:ss"))
        .when(kind == 2, F.date_format(ship, "d MMM yyyy"))
        .when(kind == 3, F.date_format(ship, "MM/dd/yyyy"))
        .when(kind == 4, "")
        .when(kind == 5, "n/a")
        .when(kind == 6, F.concat(serial, F.lit(".5")))
        .when(kind == 7, F.date_format(ship, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ship, "yyyy-MM-dd"))
    )
    money = F.col("l_extendedprice").cast("decimal(18,4)").cast("string")
    value_kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 13
    value = (
        F.when(value_kind == 0, "n/a")
        .when(value_kind == 1, "-")
        .when(value_kind == 2, F.concat(F.lit(" "), money, F.lit(" ")))
        .when(value_kind == 3, F.concat(F.lit("-"), money))
        .otherwise(money)
    )
    name = F.col("r_name")
    return full.select(
        date.alias("Month "),
        F.when(kind == 8, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("Country"),
        F.col("c_mktsegment").alias("Channel"),
        F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Brand"),
        value.alias("Value"),
        F.col("l_quantity").cast("decimal(18,4)").cast("string").alias("Units"),
        F.lit(None).cast("string").alias("%Share"),
    )



@query(
    "A1_load_with_mapper",
    "SELECT p_type AS category, p_brand AS brand, p_retailprice AS value_sales FROM part",
)
def a1(spark, folder):
    mapper = {"category": "p_type", "brand": "p_brand", "value_sales": "p_retailprice"}
    table = src.load_fact(spark, f"{folder}/part.parquet", mapper)
    return table.select("category", "brand", "value_sales")


@query(
    "A2_autodetect_mapper",
    f"""WITH {RAW} SELECT "Month " AS date, "Country" AS market, "Channel" AS channel,
    "Category" AS category, "Brand" AS brand, "Value" AS value_sales, "Units" AS unit_sales,
    "%Share" AS share FROM raw""",
)
def a2(spark, folder):
    raw = raw_sheet(spark, folder)
    return src.apply_mapper(raw, ingest.autodetect_mapper(raw.columns))


@query(
    "A3_normalise_headers",
    f"""WITH {RAW} SELECT "Month " AS month, "Country" AS country, "Channel" AS channel,
    "Category" AS category, "Brand" AS brand, "Value" AS value, "Units" AS units,
    "%Share" AS "%share" FROM raw""",
)
def a3(spark, folder):
    return ingest.normalise_headers(raw_sheet(spark, folder))


@query(
    "A4_parse_mixed_dates",
    f"""WITH {PARSED} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, count(*) AS n
    FROM parsed GROUP BY 1""",
)
def a4(spark, folder):
    raw = raw_sheet(spark, folder)
    rows = ingest.parse_dates(raw.select(F.col("Month ").alias("date")))
    text = F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("parsed")
    return rows.groupBy(text).agg(F.count("*").alias("n"))


@query(
    "A5_month_start",
    f"WITH {PARSED} SELECT date, count(*) AS n FROM ready GROUP BY 1",
)
def a5(spark, folder):
    raw = raw_sheet(spark, folder)
    rows = ingest.to_month(ingest.parse_dates(raw.select(F.col("Month ").alias("date"))))
    return rows.groupBy("date").agg(F.count("*").alias("n"))


@query(
    "A6_coerce_numeric",
    f"WITH {PARSED} SELECT brand, value_sales, unit_sales, share FROM ready",
)
def a6(spark, folder):
    raw = raw_sheet(spark, folder)
    rows = src.apply_mapper(raw, ingest.autodetect_mapper(raw.columns))
    return ingest.coerce_numeric(rows).select("brand", "value_sales", "unit_sales", "share")


@query(
    "A7_quarantine_invalid_dates",
    f"WITH {PARSED} SELECT market, channel, category, brand FROM ready WHERE date IS NULL",
)
def a7(spark, folder):
    _, bad = ingest.split_invalid_dates(ingest.read_raw(raw_sheet(spark, folder)))
    return bad.select("market", "channel", "category", "brand")


@query(
    "A8_validate_schema",
    f"""WITH {RAW} SELECT brand, 'Missing required column: ' || c AS error, n FROM
    (SELECT "Brand" AS brand, count(*) AS n FROM raw GROUP BY 1),
    (VALUES ('date'), ('market'), ('value_sales'), ('unit_sales')) AS missing(c)""",
)
def a8(spark, folder):
    raw = ingest.normalise_headers(raw_sheet(spark, folder)).withColumnRenamed("%share", "share")
    errors = F.array(*[F.lit(e) for e in ingest.validate_schema(raw)])
    per_brand = raw.groupBy("brand").agg(F.count("*").alias("n"))
    return per_brand.select("brand", F.explode(errors).alias("error"), "n")


@query(
    "A9_validate_basic",
    f"""WITH {PARSED}, c AS (SELECT bool_or(date IS NULL) AS a, bool_or(value_sales < 0) AS b,
    bool_or(unit_sales < 0) AS d FROM ready)
    SELECT 'Null dates found.' AS error FROM c WHERE a UNION ALL
    SELECT 'Negative value_sales found.' FROM c WHERE b UNION ALL
    SELECT 'Negative unit_sales found.' FROM c WHERE d""",
)
def a9(spark, folder):
    return ingest.validate_basic(ingest.read_raw(raw_sheet(spark, folder)))


@query(
    "A10_derive_fields",
    f"""WITH {FACT}, p AS (SELECT *, last_value(value_sales IGNORE NULLS) OVER w AS pad FROM fact
      WINDOW w AS (PARTITION BY market, channel, category, brand ORDER BY date
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT date, market, channel, category, brand, value_sales, share,
      round(CASE WHEN lag(pad, 12) OVER s <> 0 THEN pad / lag(pad, 12) OVER s - 1 END, 6)
        AS value_yoy,
      round(share - lag(share, 12) OVER s, 6) AS share_yoy
    FROM p WINDOW s AS (PARTITION BY market, channel, category, brand ORDER BY date)""",
)
def a10(spark, folder):
    rows = ingest.derive_fields(src.fact(spark, folder))
    return rows.select(
        "date", *src.DIMS, "value_sales", "share",
        F.round("value_yoy", 6).alias("value_yoy"), F.round("share_yoy", 6).alias("share_yoy"),
    )


@query(
    "A11_fact_table",
    f"WITH {FACT} SELECT date, market, channel, category, brand, value_sales, unit_sales, share,"
    " year(date) AS year FROM fact",
)
def a11(spark, folder):
    """The fact written, and read back through its view."""
    src.save_fact(src.fact(spark, folder), files.scratch(spark, "fact"), "stored_fact")
    return spark.table("stored_fact").withColumn("year", F.year("date").cast("bigint"))


@query(
    "A12_ingest_summary",
    f"""WITH {PARSED} SELECT count(date) AS rows, min(date) AS min_date, max(date) AS max_date,
    count(*) FILTER (WHERE date IS NULL) AS invalid_date_rows FROM ready""",
)
def a12(spark, folder):
    return ingest.ingest_summary(ingest.read_raw(raw_sheet(spark, folder)))


@query(
    "A12b_rejection_causes",
    f"""WITH {PARSED}, numbers AS (SELECT vt, TRY_CAST(vt AS DOUBLE) AS v, "Units" AS ut,
      TRY_CAST("Units" AS DOUBLE) AS u, trim("%Share") AS st, TRY_CAST("%Share" AS DOUBLE) AS s FROM texts),
    dates AS (SELECT t, l_day FROM (SELECT t, CASE WHEN regexp_full_match(t, '[0-9.]+') THEN 1
      WHEN try_strptime(t, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d-%m-%Y %H:%M:%S', '%d/%m/%Y', '%d %b %Y', '%m/%d/%Y'])
      IS NOT NULL THEN 1 END AS l_day FROM texts))
    SELECT 'date missing' AS cause, count(*) AS rows, CAST(NULL AS VARCHAR) AS example FROM dates WHERE coalesce(t, '') = ''
    UNION ALL SELECT 'date unreadable', count(*), min(t) FROM dates WHERE t <> '' AND l_day IS NULL
    UNION ALL SELECT 'value_sales not a number', count(*), min(vt) FROM numbers WHERE vt <> '' AND v IS NULL
    UNION ALL SELECT 'value_sales negative', count(*), min(vt) FROM numbers WHERE v < 0
    UNION ALL SELECT 'unit_sales not a number', count(*), min(ut) FROM numbers WHERE ut <> '' AND u IS NULL
    UNION ALL SELECT 'unit_sales negative', count(*), min(ut) FROM numbers WHERE u < 0
    UNION ALL SELECT 'share not a number', count(*), min(st) FROM numbers WHERE st <> '' AND s IS NULL
    UNION ALL SELECT 'share negative', count(*), min(st) FROM numbers WHERE s < 0""",
)
def a12b(spark, folder):
    return ingest.rejection_causes(raw_sheet(spark, folder))


@query(
    "A13_clean_dims",
    f"""WITH {RAW} SELECT trim("Country") AS market, "Channel" AS channel, count(*) AS n
    FROM raw GROUP BY 1, 2""",
)
def a13(spark, folder):
    raw = raw_sheet(spark, folder)
    rows = ingest.clean_dims(src.apply_mapper(raw, ingest.autodetect_mapper(raw.columns)))
    return rows.groupBy("market", "channel").agg(F.count("*").alias("n"))


@query("A14_json_lines", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def a14(spark, folder):
    """Every event written as a JSON line and read back."""
    events = src.read_table(spark, folder, "events")
    path = files.scratch(spark, "events")
    files.write_jsonl(
        events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k")), path
    )
    return files.read_jsonl(spark, path, "event_id bigint, k bigint")


@query(
    "A14b_broken_json_lines",
    """SELECT CASE WHEN event_id % 7 IN (0, 3) THEN 'broken' ELSE 'read' END AS kind, event_id % 7 AS form,
      count(*) AS n, CAST(sum(CASE WHEN event_id % 7 NOT IN (0, 3) THEN CAST(props->>'$.k' AS BIGINT) END) AS BIGINT) AS k
    FROM events GROUP BY 1, 2""",
)
def a14b(spark, folder):
    """Events as JSON lines, some cut off and some with a text for a number: rows and broken lines, counted."""
    events = src.read_table(spark, folder, "events")
    k = F.from_json("props", "k bigint").getField("k")
    line = F.to_json(F.struct("event_id", k.alias("k")), {"ignoreNullFields": "false"})
    form = F.col("event_id") % 7
    line = F.when(form == 0, F.regexp_replace(line, "[}]$", "")).when(
        form == 3, F.to_json(F.struct("event_id", F.lit("none").alias("k")))
    ).otherwise(line)
    path = files.scratch(spark, "lines")
    events.select(line.alias("value")).write.text(path)
    rows, broken = files.read_jsonl_checked(spark, path, "event_id bigint, k bigint")
    number = F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("bigint")
    broken = broken.select(F.lit("broken").alias("kind"), number.alias("event_id"), F.lit(None).cast("bigint").alias("k"))
    both = rows.select(F.lit("read").alias("kind"), "event_id", "k").unionByName(broken)
    return both.groupBy("kind", (F.col("event_id") % 7).alias("form")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(
    "A15_csv",
    f"""WITH {LINES} SELECT date, brand AS name, CAST(sum(v) AS DOUBLE) AS value_sales FROM lines
    GROUP BY 1, 2""",
)
def a15(spark, folder):
    """Monthly brand totals written as CSV and read back."""
    lines = src.sales_lines(spark, folder, ("brand",))
    path = files.scratch(spark, "totals")
    files.write_csv(agg.grouped_sum(lines, ["date", "brand"], "value_sales"), path)
    rows = src.load_fact(spark, path, {"name": "brand"}, "csv")
    return rows.select(
        F.col("date").cast("date").alias("date"), "name", F.col("value_sales").cast("double").alias("value_sales")
    )


@query(
    "A16_missing_percent",
    f"""WITH {PARSED} SELECT 'date' AS "column", round(100.0 * avg((date IS NULL)::INT), 6)
      AS missing_pct FROM ready
    UNION ALL SELECT 'value_sales', round(100.0 * avg((value_sales IS NULL)::INT), 6) FROM ready
    UNION ALL SELECT 'unit_sales', round(100.0 * avg((unit_sales IS NULL)::INT), 6) FROM ready
    UNION ALL SELECT 'share', round(100.0 * avg((share IS NULL)::INT), 6) FROM ready
    UNION ALL SELECT 'market', round(100.0 * avg((market IS NULL)::INT), 6) FROM ready""",
)
def a16(spark, folder):
    rows = ingest.read_raw(raw_sheet(spark, folder))
    out = ingest.missing_percent(rows.select("date", "value_sales", "unit_sales", "share", "market"))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "A17_duplicate_stats",
    f"""WITH {PARSED}, d AS (SELECT count(*) AS n FROM ready GROUP BY date, market, channel,
      category, brand)
    SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
      round(100.0 * CAST(sum(n) - count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6)
        AS duplicate_pct FROM d""",
)
def a17(spark, folder):
    rows = ingest.read_raw(raw_sheet(spark, folder)).select("date", *src.DIMS)
    return ingest.duplicate_stats(rows).withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@query(
    "A18_dedupe_and_drop_nulls",
    f"""WITH {PARSED} SELECT DISTINCT date, market, channel, category, brand FROM ready
    WHERE date IS NOT NULL""",
)
def a18(spark, folder):
    rows = ingest.read_raw(raw_sheet(spark, folder)).select("date", *src.DIMS)
    return ingest.dedupe(ingest.drop_null_rows(rows))


@query(
    "A19_entities",
    """WITH d AS (SELECT DISTINCT p_type AS category, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY brand) AS r FROM d)
    SELECT category, (r - 1) // 10 + 1 AS page, string_agg(brand, ',' ORDER BY r) AS brands FROM r GROUP BY 1, 2""",
)
def a19(spark, folder):
    out = agg.entities(src.sales_lines(spark, folder, ("category", "brand")), page_size=10)
    return out.select("category", "page", F.array_join("brands", ",").alias("brands"))


@query(
    "A20_full_ingest",
    f"""WITH {PARSED}, cells AS (SELECT date, market, channel, category, brand,
      CAST(sum(CAST(abs(value_sales) AS DECIMAL(28,4))) AS DOUBLE) AS value_sales
      FROM ready WHERE date IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, last_value(value_sales IGNORE NULLS) OVER (PARTITION BY market, channel,
      category, brand ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad
      FROM cells),
    g AS (SELECT date, market, channel, category, brand,
      round(CASE WHEN lag(pad, 12) OVER s <> 0 THEN pad / lag(pad, 12) OVER s - 1 END, 6) AS value_yoy FROM f
      WINDOW s AS (PARTITION BY market, channel, category, brand ORDER BY date))
    SELECT date, market, channel, category, brand, abs(value_sales) AS value_sales, unit_sales, value_yoy
    FROM ready LEFT JOIN g USING (date, market, channel, category, brand)""",
)
def a20(spark, folder):
    """The sheet without its minus signs, ingested: the derived rows, and those without a date."""
    sheet = raw_sheet(spark, folder).withColumn("Value", F.regexp_replace("Value", "-(?=[0-9])", ""))
    good, rejected = ingest.ingest(sheet)
    out = good.unionByName(rejected, allowMissingColumns=True)
    return out.select(
        "date", *src.DIMS, "value_sales", "unit_sales", F.round("value_yoy", 6).alias("value_yoy")
    )

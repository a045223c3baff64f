import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesgrid.functions.dates import parse_mixed_date, parse_month
from salesgrid.operators.windows import MonthWindow, in_window
from salesgrid.sources import fact as src
from salesgrid.sources import files, ingest

CELLS = {
    "45292": "2024-01-01 00:00:00",
    "45292.5": "2024-01-01 12:00:00",
    "01-12-2025 00:00:00": "2025-12-01 00:00:00",
    "01/12/2025": "2025-12-01 00:00:00",
    "12/25/2025": "2025-12-25 00:00:00",
    "25 Nov 2025": "2025-11-25 00:00:00",
    "5 september 2025": "2025-09-05 00:00:00",
    "November 25, 2025": "2025-11-25 00:00:00",
    " 2025-03-04 ": "2025-03-04 00:00:00",
    "2025/03/04": "2025-03-04 00:00:00",
    "2025-03": "2025-03-01 00:00:00",
    "20250304": "2025-03-04 00:00:00",
    "Jan 2024": "2024-01-01 00:00:00",
    "": None, "n/a": None, "45-45-2020": None, "31-02-2020": None, "12:30": None,
    "3 foo 2020": None, "9999999": None, None: None,
}


def test_mixed_dates(spark):
    df = spark.createDataFrame([(k,) for k in CELLS], "c string")
    got = df.select("c", F.date_format(parse_mixed_date("c"), "yyyy-MM-dd HH:mm:ss").alias("d"))
    assert {r["c"]: r["d"] for r in got.collect()} == CELLS
    months = spark.createDataFrame([("Feb 2024",), ("2024-02-17",), ("x",)], "c string")
    got = [r[0] for r in months.select(parse_month("c")).collect()]
    assert got == [dt.date(2024, 2, 1), dt.date(2024, 2, 1), None]


def test_mapper_headers_and_schema(spark):
    cols = ["Month", "Country", "Channel", "Category", "Brand", "Value", "Units", "%Share"]
    mapper = ingest.autodetect_mapper(cols)
    assert mapper["date"] == "Month" and mapper["share"] == "%Share" and len(mapper) == 8
    df = spark.createDataFrame([("a", "b")], [" Date ", "MARKET"])
    assert ingest.normalise_headers(df).columns == ["date", "market"]
    missing = ingest.validate_schema(ingest.normalise_headers(df))
    assert "Missing required column: brand" in missing and len(missing) == 6


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "Month string, Country string, Channel string, Category string, Brand string, "
        "Value string, Units string, `%Share` string"
    )


def test_ingest_and_quarantine(spark, tmp_path):
    rows = [("01-01-2024", " India ", "MT", "Biscuits", "Alpha", "10.5", "3", "x"),
            ("junk", "India", "MT", "Biscuits", "Alpha", "1d", "2", "1")]
    clean = ingest.read_raw(raw(spark, rows))
    good = ingest.quarantine(clean, str(tmp_path / "bad"))
    row = good.first()
    assert good.count() == 1 and row["market"] == "India" and row["share"] is None
    bad = spark.read.option("header", True).csv(str(tmp_path / "bad")).collect()
    assert len(bad) == 1 and bad[0]["value_sales"] is None
    assert ingest.ingest(raw(spark, rows))[0].count() == 1
    negative = [("01-01-2024", "India", "MT", "Biscuits", "Alpha", "-1", "3", "1")]
    with pytest.raises(ValueError, match="Negative value_sales"):
        ingest.ingest(raw(spark, negative))


def test_derive_fields_pads_and_lags_rows(spark):
    rows = [(dt.date(2020 + i // 12, i % 12 + 1, 1), "m", "c", "k", "b", v, 1.0, float(i))
            for i, v in enumerate([100.0, None, 0.0] + [50.0] * 9 + [150.0, 60.0, 9.0])]
    out = ingest.derive_fields(spark.createDataFrame(rows, src.FACT_SCHEMA)).orderBy("date").collect()
    assert out[12]["value_yoy"] == 0.5 and out[12]["share_yoy"] == 12.0
    assert abs(out[13]["value_yoy"] + 0.4) < 1e-12  # the missing month is padded with 100
    assert out[14]["value_yoy"] is None and out[11]["value_yoy"] is None


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    one = ingest.duplicate_stats(df).first()
    assert one["duplicates"] == 1 and abs(one["duplicate_pct"] - 100 / 3) < 1e-9
    pct = {r["column"]: r["missing_pct"] for r in ingest.missing_percent(df).collect()}
    assert pct["a"] == 0 and abs(pct["b"] - 200 / 3) < 1e-9
    assert ingest.dedupe(df).count() == 2 and ingest.drop_null_rows(df).count() == 1


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "rows"
    path.mkdir()
    (path / "a.json").write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2, "b": "y"}\n')
    df = files.read_jsonl(spark, str(path), "a int, b string")
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").count() == 2
    files.write_csv(df, str(tmp_path / "csv"))
    assert src.load_fact(spark, str(tmp_path / "csv"), {"brand": "b"}, "csv").columns == ["a", "brand"]


def test_broken_json_lines_are_kept(spark, tmp_path):
    bad = ["{broken", '{"a": 2, "b": "y"', '{"a": "no", "b": "z"}', "[]", "7"]
    good = ['{"a": 1, "b": "x"}', '{"a": 3}', '{"b": null, "c": 5}']
    (tmp_path / "a.json").write_text("\n".join([good[0], "", *bad, "   ", *good[1:]]) + "\n")
    rows, broken = files.read_jsonl_checked(spark, str(tmp_path), "a int, b string")
    assert {tuple(r) for r in rows.collect()} == {(1, "x"), (3, None), (None, None)}
    assert sorted(r["line"] for r in broken.collect()) == sorted(bad) and broken.count() == len(bad)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text("")
    assert [x.count() for x in files.read_jsonl_checked(spark, str(tmp_path / "none"), "a int")] == [0, 0]


def test_saved_fact_is_pruned_by_window(spark, tmp_path):
    fact = src.fact(spark, "/root/testdata/sf0.001")
    stored = src.save_fact(fact, str(tmp_path / "fact"), "stored_fact")
    assert stored.dtypes == fact.dtypes and stored.count() == fact.count()
    inside = in_window(spark.table("stored_fact"), MonthWindow.of("2000-01-01", "2000-04-01"))
    text = inside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text
    want = fact.where("date >= '2000-01-01' and date < '2000-04-01'")
    assert inside.count() == want.count() > 0


def test_rows_of_one_month_share_its_growth(spark):
    rows = [(f"{y}-03-01", "m", "c", "k", "b", v, 1.0, None) for y, v in ((2023, 4.0), (2023, 6.0), (2024, 15.0), (2024, 5.0))]
    rows += [(f"2023-{m:02d}-01", "m", "c", "k", "b", 1.0, 1.0, None) for m in range(4, 13)]
    rows += [(f"2024-{m:02d}-01", "m", "c", "k", "b", 1.0, 1.0, None) for m in (1, 2)]
    df = spark.createDataFrame(rows, "date string, market string, channel string, category string, brand string, value_sales double, unit_sales double, share double")
    out = ingest.derive_rows(df.withColumn("date", F.col("date").cast("date")))
    assert out.count() == len(rows)
    got = [r["value_yoy"] for r in out.where("date = '2024-03-01'").collect()]
    assert got == [1.0, 1.0]


def test_rejections_are_counted_by_cause(spark):
    rows = [
        ("2024-01-01", "1.5", "2"), (" ", "n/a", "-1"), (None, "", None), ("someday", "-2", "x"), ("31-02-2020", " -3 ", "1e2"),
    ]
    raw = spark.createDataFrame(rows, "Month string, Value string, Units string")
    got = {r["cause"]: (r["rows"], r["example"]) for r in ingest.rejection_causes(raw).collect()}
    assert got == {
        "date missing": (2, None), "date unreadable": (2, "31-02-2020"),
        "value_sales not a number": (1, "n/a"), "value_sales negative": (2, "-2"),
        "unit_sales not a number": (1, "x"), "unit_sales negative": (1, "-1"),
        **{f"{c} column missing": (5, None) for c in ("market", "channel", "category", "brand", "share")},
    }
    typed = spark.sql("SELECT date'2024-01-01' AS date, CAST(-1 AS DOUBLE) AS value, 'x' AS other").limit(0)
    assert {r["rows"] for r in ingest.rejection_causes(typed).collect()} == {0}

"""Operators that read or shuffle their rows once, and that give the rows they gave before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesgrid.operators import rank, series, stats
from salesgrid.plans.catalog_ingest import raw_sheet
from salesgrid.sources import ingest
from salesgrid.sources.fact import sales_lines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def day(y, m):
    return dt.date(y, m, 1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema).repartition(2)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Order tables with repeated and null keys."""
    folder = str(tmp_path_factory.mktemp("star"))
    when = dt.datetime(2001, 3, 9)
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
                     " l_discount double, l_shipdate timestamp_ntz",
                     [(1, 1, 1, 2.0, 10.0, 0.0, when), (1, 1, 1, 2.0, 10.0, 0.0, when), (2, 2, 1, 1.0, 20.0, 0.5, when),
                      (None, 1, 1, 1.0, 5.0, 0.0, when), (2, None, 1, 1.0, 7.0, 0.0, when), (9, 1, 1, 1.0, 1.0, 0.0, when)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 2), (2, 2), (3, 1), (4, None), (None, 1)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 1, "s1"), (2, 1, "s2"), (2, 2, None), (None, 1, "s3")]),
        "nation": ("n_nationkey int, n_regionkey int", [(1, 1), (2, 2)]),
        "region": ("r_regionkey int, r_name string", [(1, "north"), (2, "south")]),
        "part": ("p_partkey long, p_type string, p_brand string", [(1, "t1", "b1"), (2, "t2", "b2"), (2, "t2", None), (None, "t3", "b3")]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


LEAVES = ("l_orderkey", "o_orderkey", "c_custkey", "n_nationkey", "r_regionkey", "p_partkey")


def leaves(df):
    """The tables of the plan's joins from left to right, by their keys."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    texts = [found.apply(i).output().toString() for i in range(found.size())]
    return [next(k for k in LEAVES if k in t) for t in texts]


def test_lines_meet_orders_with_their_buyers(spark, star):
    lines = sales_lines(spark, star)
    assert leaves(lines) == list(LEAVES)
    seen = sorted((r["market"], r["channel"] or "", r["brand"] or "", float(r["value_sales"])) for r in lines.collect())
    # order 2 comes twice, as do customer 2 and part 2: eight rows of one line
    eight = [(m, c, b, 10.0) for m, c in (("north", "s2"), ("south", "")) for b in ("", "b2") for _ in range(2)]
    assert seen == sorted([("north", "s1", "b1", 10.0)] * 2 + eight)


def test_raw_sheet_meets_orders_with_their_buyers(spark, star):
    sheet = raw_sheet(spark, star)
    assert leaves(sheet) == list(LEAVES)
    assert sheet.count() == 10


def test_pairwise_tests_read_their_rows_once(spark):
    data = [("k", "a", 1.0), ("k", "a", 3.0), ("k", "b", 2.0), ("k", "b", 6.0), ("k", None, 4.0), (None, "a", 1.0)]
    df = rows(spark, data, "c string, g string, y double")
    for run in (stats.tukey_hsd, stats.games_howell):
        out = run(df, ["c"], "g", "y")
        assert "LogicalRDD" not in plan(out)
        (r,) = out.collect()
        assert (r["c"], r["group_a"], r["group_b"], r["diff"]) == ("k", "a", "b", 2.0)


def test_monthly_outliers_read_their_rows_once(spark):
    values = [10.0, 11.0, 12.0, 13.0, 90.0]
    data = [(None, day(2020, i + 1), v) for i, v in enumerate(values)]
    data += [("few", day(2020, i + 1), v) for i, v in enumerate((1.0, 1.0, 9.0))] + [("none", day(2020, 1), None)]
    df = rows(spark, data, "brand string, date date, value_sales double")
    out = rank.iqr_outliers(df, ["brand"], min_points=4, monthly=True)
    assert plan(out).count("LogicalRDD") == 1
    assert out.columns == ["brand", "date", "value_sales", "lower_bound", "upper_bound"]
    assert [tuple(r) for r in out.collect()] == [(None, day(2020, 5), 90.0, 8.0, 16.0)]
    general = rank.iqr_outliers(df, ["brand"], min_points=4)
    assert [tuple(r) for r in general.collect()] == [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("keys", [["brand"], []])
def test_complete_months_reads_its_rows_once(spark, keys):
    data = [(None, day(2019, 11), 1.0), (None, day(2020, 2), 2.0), (None, day(2020, 2), 3.0), (None, None, 9.0)]
    data += [("b", day(2020, 1), None)] if keys else []
    df = rows(spark, data, "brand string, date date, value double")
    out = series.complete_months(df, keys, "value")
    assert plan(out).count("LogicalRDD") == 1
    assert out.columns == [*keys, "month", "value"]
    seen = sorted(((r["month"], r["value"]) for r in out.filter(F.col("brand").isNull() if keys else F.lit(True)).collect()))
    assert seen == [(day(2019, 11), 1.0), (day(2019, 12), None), (day(2020, 1), None), (day(2020, 2), 5.0)]
    assert series.complete_months(df.limit(0), keys, "value").collect() == []


def test_ingest_parses_its_cells_once(spark):
    data = [("2024-01-05", "5", "x"), ("Jan 2024", "7", None), ("n/a", "1", "y")]
    df = rows(spark, data, "`Month ` string, Value string, `x y,(z)` string")
    names = {"Country": "m", "Channel": "c", "Category": "k", "Brand": "b", "Units": "1", "%Share": "50"}
    df = df.withColumns({n: F.lit(v) for n, v in names.items()}).withColumn("nothing", F.lit(None))
    good, rejected = ingest.ingest(df)
    for part in (good, rejected):
        assert "LogicalRDD" not in plan(part) and "RLIKE" not in plan(part)
    got = sorted((r["value_sales"], r["x y,(z)"] or "", r["nothing"]) for r in good.collect())
    assert got == [(5.0, "x", None), (7.0, "", None)]
    assert [(r["value_sales"], r["x y,(z)"]) for r in rejected.collect()] == [(1.0, "y")]

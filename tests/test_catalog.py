import re

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "Q0_mat_top_brands", "A4_parse_mixed_dates", "A10_derive_fields", "B4_window_mat", "B6_window_range",
    "C3_top_n", "C12_desc_stats", "C24b_box_stats", "D1_yoy", "D5_mom_rows", "D6_mat_compare", "D12_yoy_facts",
    "E3_pareto", "E10_iqr_outliers", "F2_acf", "F5_forecast_seasonal_ar", "H5_forecast_with_actuals",
    "S5_welch_anova", "S6_kruskal", "J1_extract_intents", "J4_match_brands", "J7d_say_yoy", "J18_split_sentences",
    "J19_build_payloads", "Q2b_answer_yoy", "A11_fact_table", "A14_json_lines", "A15_csv", "A20_full_ingest",
    "H4_totals_to_detail", "H6_date_in_window",
)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0]["value_sales"] >= rows[-1]["value_sales"]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, name):
    problem, n = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert problem is None and n > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_pushed_to_the_scan(spark):
    text = plan(entry.queries()["B2_in_window"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_shipdate" in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_tax" not in columns and "l_suppkey" not in columns


@pytest.mark.parametrize(
    "name",
    ("C18_yoy_items", "C19_mat_items", "C22_best_yoy", "D1_yoy", "D1b_yoy_top_n", "D2_yoy_total", "D6_mat_compare",
     "D7_mat_growth", "D8_mat_yoy", "D9_ytd_yoy", "H1_left_join_null_safe", "H2_two_totals_side_by_side",
     "H6_date_in_window", "J7c_say_mat", "Q2b_answer_yoy", "Q2c_answer_mat_compare"),
)
def test_compared_windows_bound_the_scan(spark, name):
    """Every read of the measures compares the ship date itself with a literal or a subquery's value."""
    scans = [x for x in plan(entry.queries()[name](spark, FOLDER)).splitlines()
             if "FileScan parquet" in x and re.search(r"FileScan parquet \[[^\]]*l_(quantity|extendedprice)", x)]
    bound = r"l_shipdate#\d+ >= (Subquery|ReusedSubquery|scalar-subquery|\d{4}-)"
    assert scans and all(re.search(bound, x) for x in scans)


@pytest.mark.parametrize("name", ("C11_describe", "D12_yoy_facts", "E10_iqr_outliers", "J7d_say_yoy", "J19_build_payloads", "J20_payload_mode"))
def test_shared_parts_are_planned_once(spark, name):
    assert plan(entry.queries()[name](spark, FOLDER)).count("FileScan parquet") < 20


@pytest.mark.parametrize("name", ("D1_yoy", "D6_mat_compare", "E3_pareto", "J4_match_brands", "S6_kruskal", "F5_forecast_seasonal_ar"))
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

import random

import numpy as np
import pytest

from salesgrid.operators.spread import cut, exact_quantiles, with_rank, with_running
from pyspark.sql import functions as F


def sample(n=3000):
    """One key holds a third of the rows, one value repeats, one value lies far outside."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 5.0 if i % 5 == 0 else round(1e9 + rng.random(), 4)
        rows.append((i, key, -1e12 if i == 1 else value))
    return rows + [(n, "a", None)]


def test_running_total_matches_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "id int, k string, x double")
    got = with_running(df, ["k"], "x", {"n": F.lit(1), "ids": F.col("id")}, tie=("id",)).collect()
    want = {}
    for key in {r[1] for r in rows}:
        part = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        ids = 0
        for n, r in enumerate(part, start=1):
            ids += r[0]
            want[r[0]] = (n, ids)
    assert {r["id"]: (r["n"], r["ids"]) for r in got} == want


def test_rank_descending_without_keys(spark):
    rows = sample(500)
    df = spark.createDataFrame(rows, "id int, k string, x double")
    got = {r["id"]: r["rank"] for r in with_rank(df, [], "x", tie=("id",)).collect()}
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, start=1)}


def test_exact_quantiles(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "id int, k string, x double")
    wanted = {"p10": 0.1, "q1": 0.25, "med": 0.5, "p99": 0.99, "top": 1.0}
    for r in exact_quantiles(df, ["k"], "x", wanted).collect():
        values = [v for _, k, v in rows if k == r["k"] and v is not None]
        for name, p in wanted.items():
            assert np.isclose(r[name], np.quantile(values, p), rtol=1e-12), (r["k"], name)
    short = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", wanted, short=True).collect()}
    for r in exact_quantiles(df, ["k"], "x", wanted).collect():
        assert all(np.isclose(r[n], short[r["k"]][n], rtol=1e-12) for n in wanted)
    assert exact_quantiles(df.filter("x IS NULL"), ["k"], "x", wanted).collect() == []
    assert exact_quantiles(df.filter("x IS NULL"), [], "x", wanted).collect() == []
    whole = exact_quantiles(df, [], "x", {"med": 0.5}).first()["med"]
    assert np.isclose(whole, np.median([v for *_, v in rows if v is not None]), rtol=1e-12)


@pytest.mark.parametrize("value", ("exp(2 * randn(5))", "1.0D", "pmod(id * 7919, 1000003) / 8", "pmod(id, 7) * 1.0D"))
def test_quantiles_of_many_rows_are_exact(spark, value):
    """So many rows that the sketch rounds and only the bracket is ordered."""
    df = spark.range(300_000).selectExpr("id", f"{value} AS x").cache()
    x = np.array([r["x"] for r in df.select("x").collect()])
    wanted = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "med": 0.5, "p999": 0.999, "top": 1.0}
    got = exact_quantiles(df, [], "x", wanted).first()
    assert all(np.isclose(got[n], np.quantile(x, p), rtol=1e-12) for n, p in wanted.items())
    df.unpersist()


@pytest.mark.parametrize("value", ("exp(2 * randn(5))", "1.0D"))
def test_ranges_are_even_for_skew_and_ties(spark, value):
    df = spark.range(40_000).selectExpr("id", f"{value} AS x")
    sizes = [r["count"] for r in cut(df, [], "x", tie=("id",), rows=2_000).groupBy("__r").count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) == 20 and max(sizes) <= 2 * 2_000


@pytest.mark.parametrize("descending", (False, True))
def test_cut_groups_are_ranked_as_whole_ones(spark, descending):
    rows = sample()
    df = spark.createDataFrame(rows, "id int, k string, x double")
    got = with_running(df, ["k"], "x", {"n": F.lit(1)}, descending, ("id",), rows=100).collect()
    want = {}
    for key in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == key]
        part.sort(key=lambda r: (r[2] is None, (-r[2] if descending else r[2]) if r[2] is not None else 0, r[0]))
        want |= {r[0]: n for n, r in enumerate(part, start=1)}
    assert {r["id"]: r["n"] for r in got} == want

import math
import random

import numpy as np
import pytest

from salesgrid.functions import tails
from salesgrid.operators import agg, stats


def test_tail_probabilities():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.f_upper(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(3.8415, 1) == pytest.approx(0.05, abs=1e-5)
    assert tails.chi2_upper(30.0, 4) == pytest.approx(4.894e-6, rel=1e-3)
    assert tails.norm_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert tails.studentized_range_upper([3.877], [3], [10])[0] == pytest.approx(0.05, abs=2e-4)
    assert tails.studentized_range_upper([3.633], [4], [1e6])[0] == pytest.approx(0.05, abs=2e-4)


def test_shapiro_known_values(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("w", float(v)) for v in weights] + [("two", 1.0), ("two", 2.0)], "g string, y double")
    out = stats.shapiro(df, ["g"], "y").collect()
    assert len(out) == 1  # two points are too few
    assert out[0]["w"] == pytest.approx(0.7888, abs=1e-3)
    assert out[0]["p"] == pytest.approx(0.0067, abs=5e-4)


def groups(spark, seed=3, shift=0.0, scale=1.0):
    rng = random.Random(seed)
    rows = [(g, round(rng.gauss(10 + i * shift, 1 + i * (scale - 1)), 1)) for i, g in enumerate("abc") for _ in range(40)]
    return rows, spark.createDataFrame([("k", *r) for r in rows], "cat string, g string, y double")


def test_kruskal_and_anova_by_brute_force(spark):
    rows, df = groups(spark, shift=0.3)
    y = np.array([r[1] for r in rows])
    g = np.array([r[0] for r in rows])
    ranks = np.array([np.mean(np.where(np.sort(y) == v)[0]) + 1 for v in y])
    n = len(y)
    h = 12 / (n * (n + 1)) * sum(ranks[g == k].sum() ** 2 / (g == k).sum() for k in "abc") - 3 * (n + 1)
    _, c = np.unique(y, return_counts=True)
    h /= 1 - (c**3 - c).sum() / (n**3 - n)
    assert stats.kruskal(df, ["cat"], "g", "y").first()["h"] == pytest.approx(h)
    ssb = sum((g == k).sum() * (y[g == k].mean() - y.mean()) ** 2 for k in "abc")
    ssw = sum(((y[g == k] - y[g == k].mean()) ** 2).sum() for k in "abc")
    f = (ssb / 2) / (ssw / (n - 3))
    assert stats.anova(df, ["cat"], "g", "y").first()["f"] == pytest.approx(f)
    assert stats.anova(df, [], "g", "y").first()["f"] == pytest.approx(f)
    pairs = stats.tukey_hsd(df, ["cat"], "g", "y").collect()
    assert len(pairs) == 3 and all(0 <= r["p"] <= 1 for r in pairs)


def test_choice_of_test(spark):
    _, same = groups(spark, seed=5, shift=2.0)
    row = stats.compare_groups(same, ["cat"], "g", "y").first()
    assert row["test"] == "anova" and row["significant"] and row["post_hoc"] == "tukey"
    skewed = spark.createDataFrame(
        [("k", g, float(2**i + j)) for j, g in enumerate("ab") for i in range(20)], "cat string, g string, y double"
    )
    row = stats.compare_groups(skewed, ["cat"], "g", "y").first()
    assert row["test"] == "kruskal" and row["post_hoc"] is None and row["equal_var"] is None


def routed(spark):
    """Three tests at once: equal variances, unequal ones, and skewed values; the last key is null."""
    equal, wide = groups(spark, seed=5, shift=2.0)[0], groups(spark, seed=5, shift=2.0, scale=6.0)[0]
    rows = [("equal", *r) for r in equal] + [("wide", *r) for r in wide]
    rows += [(None, g, float(2**i + j)) for j, g in enumerate("ab") for i in range(20)] + [("one", "a", 1.0)]
    return spark.createDataFrame(rows, "cat string, g string, y double")


def test_each_test_reads_only_its_keys(spark, monkeypatch):
    seen = {}

    def spy(name, run):
        def counted(df, keys, *rest):
            seen[name] = {r[0] for r in df.select(keys[0]).distinct().collect()}
            return run(df, keys, *rest)

        return counted

    monkeypatch.setattr(stats, "ROUTED", {k: (spy(k, run), stat) for k, (run, stat) in stats.ROUTED.items()})
    monkeypatch.setattr(stats, "levene", spy("levene", stats.levene))
    df = routed(spark)
    out = {r["cat"]: r for r in stats.compare_groups(df, ["cat"], "g", "y").collect()}
    assert {k: r["test"] for k, r in out.items()} == {"equal": "anova", "wide": "welch", None: "kruskal"}
    assert seen == {"levene": {"equal", "wide"}, "anova": {"equal"}, "welch": {"wide"}, "kruskal": {None}}
    for key, run, stat in (("equal", stats.anova, "f"), ("wide", stats.welch_anova, "f"), (None, stats.kruskal, "h")):
        own = run(df.where(df.cat.eqNullSafe(key)), ["cat"], "g", "y", 2).first()
        assert out[key]["statistic"] == pytest.approx(own[stat]) and out[key]["p"] == pytest.approx(own["p"])


def test_post_hoc_pairs_run_for_the_named_test_only(spark):
    df = routed(spark)
    compared = stats.compare_groups(df, ["cat"], "g", "y")
    pairs = stats.post_hoc_pairs(df, compared, ["cat"], "g", "y").collect()
    assert {(r["cat"], r["post_hoc"]) for r in pairs} == {("equal", "tukey"), ("wide", "games_howell")} and len(pairs) == 6
    for key, run in (("equal", stats.tukey_hsd), ("wide", stats.games_howell)):
        want = {(r["group_a"], r["group_b"]): r["p"] for r in run(df.where(df.cat == key), [], "g", "y").collect()}
        got = {(r["group_a"], r["group_b"]): r["p"] for r in pairs if r["cat"] == key}
        assert got == pytest.approx(want)
    same = df.where("cat = 'equal'")
    whole = stats.post_hoc_pairs(same, stats.compare_groups(same, [], "g", "y"), [], "g", "y")
    assert whole.count() == 3 and "cat" not in whole.columns
    none = stats.compare_groups(df.limit(0), ["cat"], "g", "y")
    assert none.count() == 0 and stats.post_hoc_pairs(df.limit(0), none, ["cat"], "g", "y").count() == 0


def test_studentized_range_by_table_and_brute_force():
    # upper 5 % points of the studentised range for (k, df), from tables of three and of two decimals
    q, k, df = [3.877, 4.232, 3.151, 2.772], [3, 5, 2, 2], [10, 20, 10, 1e9]
    assert tails.studentized_range_upper(q, k, df) == pytest.approx([0.05] * 4, abs=1e-4)
    assert tails.studentized_range_upper([5.01], [20], [1e9])[0] == pytest.approx(0.05, abs=7e-4)
    z, s = np.linspace(-8, 8, 801), np.linspace(1e-6, 4, 1601)
    for qi, ki, v in ((0.3, 2, 4.0), (2.5, 7, 9.5), (6.0, 40, 31.2)):
        pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        inside = [ki * np.trapezoid(pdf * (tails.norm_cdf(z + qi * si) - tails.norm_cdf(z)) ** (ki - 1), z) for si in s]
        mass = s ** (v - 1) * np.exp(-v * s * s / 2)
        want = 1 - np.trapezoid(mass * inside, s) / np.trapezoid(mass, s)
        assert tails.studentized_range_upper([qi], [ki], [v])[0] == pytest.approx(want, abs=1e-7)
    odd = tails.studentized_range_upper([math.nan, 1.0, 1.0, math.inf], [3, 1, 3, 3], [5, 5, 0, 5])
    assert np.isnan(odd).all() and len(tails.studentized_range_upper([], [], [])) == 0


def test_pairs_meet_by_equal_keys_without_a_nested_loop(spark):
    df = spark.range(60).selectExpr("id % 20 AS g", "cast(id * id % 7 AS double) AS y")
    for run in (stats.tukey_hsd, stats.games_howell):
        out = run(df, [], "g", "y")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        seen = [(r["group_a"], r["group_b"]) for r in out.collect()]
        assert sorted(seen) == [(a, b) for a in range(20) for b in range(a + 1, 20)]


def test_kde_by_brute_force(spark):
    rng = random.Random(11)
    sets = {
        "heavy": [math.exp(rng.gauss(0, 2)) for _ in range(400)],
        "ties": [1.0] * 50 + [2.0] * 7 + [-3.0],
        "two": [0.0, 1.0],
        None: [1e6 + rng.random() for _ in range(30)],
    }
    rows = [(g, v) for g, vs in sets.items() for v in vs]
    rows += [("heavy", None), ("heavy", math.nan), ("ties", math.inf), ("same", 5.0), ("same", 5.0), ("one", 1.0)]
    out = stats.kde(spark.createDataFrame(rows, "g string, y double"), ["g"], "y", 50).collect()
    assert len(out) == 50 * len(sets) and {r["g"] for r in out} == set(sets)
    for g, values in sets.items():
        y = np.array(values)
        h = y.std(ddof=1) * len(y) ** -0.2
        x = np.linspace(y.min() - 3 * h, y.max() + 3 * h, 50)
        want = np.exp(-(((x[:, None] - y) / h) ** 2) / 2).sum(axis=1) / (len(y) * h * math.sqrt(2 * math.pi))
        got = [r["density"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["i"])]
        assert got == pytest.approx(want, rel=1e-7, abs=1e-9 * want.max())


def test_density_and_histogram_sum_to_one(spark):
    _, df = groups(spark)
    kde = stats.kde(df, ["g"], "y").toPandas()
    for _, part in kde.groupby("g"):
        part = part.sort_values("x")
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1, abs=0.01)
    hist = agg.histogram(df, ["g"], "y", 7).toPandas()
    assert hist["count"].sum() == 120
    assert ((hist["right"] - hist["left"]) * hist["density"]).sum() == pytest.approx(3)

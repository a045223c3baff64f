"""Hypothesis tests over groups: moments, ranks and pairs in Spark, one row per test.

`keys` name the tests (say, categories); `by` names the groups compared inside a test
(say, brands). With no keys there is one test over everything.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.functions.sums import same_keys
from salesgrid.functions.tails import (
    chi2_upper_p,
    f_upper_p,
    norm_upper_p,
    studentized_range_p,
    t_two_sided_p,
)
from salesgrid.operators.spread import exact_quantiles, value_counts
from salesgrid.sources.files import stored

ALPHA = 0.05


def _per(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _with(df: DataFrame, other: DataFrame, keys, names: list[str]) -> DataFrame:
    """Join one-row-per-test values to group rows."""
    if keys:
        return same_keys(df, other, keys)
    return df.withColumns({n: other.select(n).scalar() for n in names})


def moments(df: DataFrame, keys, by: str, y: str, min_points: int = 1) -> DataFrame:
    """n, mean m and sample variance v of every group."""
    seen = df.filter(F.col(y).isNotNull())
    out = seen.groupBy(*keys, by).agg(
        F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")
    )
    return out.filter(F.col("n") >= min_points)


def welch_t(df: DataFrame, group: str, a, b, y: str) -> DataFrame:
    """Two-sample t-test with unequal variances of groups a and b."""
    aggs = []
    for tag, value in (("a", a), ("b", b)):
        x = F.when(F.col(group) == value, F.col(y))
        aggs += [
            F.count(x).alias(f"n_{tag}"),
            F.avg(x).alias(f"mean_{tag}"),
            F.var_samp(x).alias(f"__v{tag}"),
        ]
    one = df.filter(F.col(group).isin(a, b)).agg(*aggs)
    sa, sb = F.col("__va") / F.col("n_a"), F.col("__vb") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(sa + sb)
    dof = F.pow(sa + sb, F.lit(2)) / (
        sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)
    )
    ready = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (sa + sb > 0)
    one = one.withColumn("t", F.when(ready, t)).withColumn("df", F.when(ready, dof))
    return one.drop("__va", "__vb").withColumn("p", t_two_sided_p("t", "df"))


def anova(df: DataFrame, keys, by: str, y: str, min_points: int = 1) -> DataFrame:
    """One-way analysis of variance from group moments."""
    keys = list(keys)
    groups = moments(df, keys, by, y, min_points)
    grand = _per(groups, keys, (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("__g"))
    groups = _with(groups, grand, keys, ["__g"])
    off = F.col("m") - F.col("__g")
    within = F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v")).otherwise(0.0)
    out = _per(
        groups,
        keys,
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * off * off).alias("ss_between"),
        F.sum(within).alias("ss_within"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = (F.col("ss_between") / d1) / (F.col("ss_within") / d2)
    ready = (d1 >= 1) & (d2 >= 1) & (F.col("ss_within") > 0)
    out = out.withColumns({"df1": d1, "df2": d2, "f": F.when(ready, f)})
    return out.drop("k", "n").withColumn("p", f_upper_p("f", "df1", "df2"))


def welch_anova(df: DataFrame, keys, by: str, y: str, min_points: int = 2) -> DataFrame:
    """Analysis of variance that allows unequal variances."""
    keys = list(keys)
    groups = moments(df, keys, by, y, max(2, min_points))
    groups = groups.withColumn("w", F.when(F.col("v") > 0, F.col("n") / F.col("v")))
    totals = _per(
        groups,
        keys,
        F.sum("w").alias("__w"),
        (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("__g"),
    )
    groups = _with(groups, totals, keys, ["__w", "__g"])
    off = F.col("m") - F.col("__g")
    part = F.pow(1 - F.col("w") / F.col("__w"), F.lit(2)) / (F.col("n") - 1)
    out = _per(
        groups,
        keys,
        F.count("*").alias("k"),
        F.sum(F.col("w") * off * off).alias("__b"),
        F.sum(part).alias("__l"),
        F.count(F.when(F.col("w").isNull(), 1)).alias("__flat"),
    )
    k = F.col("k").cast("double")
    f = (F.col("__b") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("__l"))
    ready = (k >= 2) & (F.col("__flat") == 0)
    out = out.withColumns(
        {
            "df1": F.col("k") - 1,
            "df2": F.when(ready & (F.col("__l") > 0), (k * k - 1) / (3 * F.col("__l"))),
            "f": F.when(ready, f),
        }
    )
    return out.drop("k", "__b", "__l", "__flat").withColumn("p", f_upper_p("f", "df1", "df2"))


def kruskal(df: DataFrame, keys, by: str, y: str, min_points: int = 1) -> DataFrame:
    """Kruskal-Wallis test with average ranks and tie correction.

    Distinct values are ranked with their counts, so equal values meet once and no
    single task orders all rows.
    """
    keys = list(keys)
    seen = df.filter(F.col(y).isNotNull())
    if min_points > 1:
        small = seen.groupBy(*keys, by).agg(F.count("*").alias("__s"))
        small = small.filter(F.col("__s") >= min_points)
        seen = same_keys(seen, small, [*keys, by]).drop("__s")
    ranks = value_counts(seen, keys, y).withColumn(
        "__rank", F.col("__b") + (F.col("__c") + 1) / 2
    )
    cells = seen.groupBy(*keys, by, y).agg(F.count("*").alias("__m"))
    ranked = same_keys(cells, ranks, [*keys, y])
    groups = ranked.groupBy(*keys, by).agg(
        F.sum(F.col("__m") * F.col("__rank")).alias("__r"), F.sum("__m").alias("__n")
    )
    c = F.col("__c").cast("double")
    ties = _per(ranks, keys, F.sum(c * c * c - c).alias("__t"))
    out = _per(
        groups,
        keys,
        F.count("*").alias("k"),
        F.sum("__n").alias("n"),
        F.sum(F.col("__r") * F.col("__r") / F.col("__n")).alias("__s"),
    )
    out = _with(out, ties, keys, ["__t"])
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)
    correct = 1 - F.col("__t") / (n * n * n - n)
    ready = (F.col("k") >= 2) & (n > 1)
    h = F.when(ready & (F.when(ready, correct) > 0), raw / correct)
    out = out.withColumns({"df": F.col("k") - 1, "h": h})
    return out.drop("k", "__s", "__t").withColumn("p", chi2_upper_p("h", "df"))


def levene(df: DataFrame, keys, by: str, y: str, min_points: int = 1) -> DataFrame:
    """Equal-variance test on absolute distances from the group medians."""
    keys = list(keys)
    median = exact_quantiles(df, [*keys, by], y, {"__med": 0.5})
    away = same_keys(df.filter(F.col(y).isNotNull()), median, [*keys, by])
    away = away.withColumn("__z", F.abs(F.col(y) - F.col("__med")))
    out = anova(away, keys, by, "__z", min_points)
    return out.withColumnRenamed("f", "w").drop("ss_between", "ss_within")


PAIR_BLOCKS = 8


def _pairs(groups: DataFrame, keys, by: str) -> DataFrame:
    """Every two groups of a test, once each.

    These tests answer for each pair of groups, so their result is the pairs: what is
    joined are the group summaries of one test, never its rows. Groups are dealt into blocks by
    hash, and the sides meet on (keys, block of one, block of the other): an equi-join with or
    without keys, which spreads one test of many groups over all pairs of blocks.
    """
    side = ["n", "m", "v"]
    block = F.pmod(F.xxhash64(by), F.lit(PAIR_BLOCKS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))
    a = groups.select(
        *keys, F.col(by).alias("group_a"), *[F.col(c).alias(f"{c}_a") for c in side],
        block.alias("__block_a"), every.alias("__block_b"),
    )
    b = groups.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col(by).alias("group_b"),
        *[F.col(c).alias(f"{c}_b") for c in side],
        block.alias("__own"), every.alias("__other"),
    )
    on = (F.col("__block_a") == F.col("__other")) & (F.col("__block_b") == F.col("__own"))
    on = on & (F.col("group_a") < F.col("group_b"))
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"__{k}"])
    return a.join(b, on).drop(*[f"__{k}" for k in keys], "__block_a", "__block_b", "__own", "__other")


def tukey_hsd(df: DataFrame, keys, by: str, y: str) -> DataFrame:
    """Pairwise differences against the studentised range, common variance.

    The group summaries are written once, as both sides of the pairs and the pooled variance read them.
    """
    keys = list(keys)
    groups = stored(moments(df, keys, by, y), "groups")
    within = F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v")).otherwise(0.0))
    dof = F.sum("n") - F.count("*")
    pooled = _per(
        groups,
        keys,
        F.when(dof > 0, within / dof).alias("__ms"),
        dof.alias("df"),
        F.count("*").alias("__k"),
    )
    out = _with(_pairs(groups, keys, by), pooled, keys, ["__ms", "df", "__k"])
    diff = F.col("m_b") - F.col("m_a")
    se = F.sqrt(F.col("__ms") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = out.withColumns({"diff": diff, "q": F.when(se > 0, F.abs(diff) / se)})
    out = out.withColumn("p", studentized_range_p("q", "__k", "df"))
    return out.select(*keys, "group_a", "group_b", "diff", "q", "df", "p")


def games_howell(df: DataFrame, keys, by: str, y: str) -> DataFrame:
    """Pairwise differences against the studentised range, own variances (summaries written once, as above)."""
    keys = list(keys)
    groups = stored(moments(df, keys, by, y, 2), "groups")
    size = _per(groups, keys, F.count("*").alias("__k"))
    out = _with(_pairs(groups, keys, by), size, keys, ["__k"])
    diff = F.col("m_b") - F.col("m_a")
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    se = F.sqrt((sa + sb) / 2)
    both = sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)
    dof = F.when(both > 0, (sa + sb) * (sa + sb) / both)
    out = out.withColumns({"diff": diff, "q": F.when(se > 0, F.abs(diff) / se), "df": dof})
    out = out.withColumn("p", studentized_range_p("q", "__k", "df"))
    return out.select(*keys, "group_a", "group_b", "diff", "q", "df", "p")


# Acklam's rational approximation of the normal quantile.
QUANTILE_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
QUANTILE_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0,
)
# Royston's polynomials for the two outer weights (in 1/sqrt(n)) and for
# the mean and spread of the transformed statistic.
WEIGHT_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
WEIGHT_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SMALL_MEAN = (-0.0006714, 0.025054, -0.39978, 0.5440)
SMALL_SPREAD = (-0.0020322, 0.062767, -0.77857, 1.3822)
LARGE_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
LARGE_SPREAD = (0.0030302, -0.082676, -0.4803)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (relative error about 1e-9)."""
    low = F.least(p, 1 - p)
    r = F.sqrt(-2 * F.log(low))
    tail = _poly(QUANTILE_C, r) / _poly(QUANTILE_D, r)
    q = p - 0.5
    middle = q * _poly(QUANTILE_A, q * q) / _poly(QUANTILE_B, q * q)
    return F.when(low >= 0.02425, middle).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def shapiro(df: DataFrame, keys, y: str) -> DataFrame:
    """Shapiro-Wilk normality test per group of `keys`, Royston's weights; 3 points needed.

    The weights depend on each value's rank only, so the statistic is a sum over ranked
    values: ranks come from counts of distinct values, and no group is collected.
    """
    keys = list(keys)
    ranked = value_counts(df, keys, y)
    size = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.var_pop(y).alias("__var")
    )
    rows = same_keys(ranked, size.filter(F.col("n") >= 3), keys)
    spread = F.explode(F.sequence(F.col("__b") + 1, F.col("__b") + F.col("__c")))
    rows = rows.select(*keys, "n", "__var", F.col(y).cast("double").alias("x"), spread.alias("i"))
    n, i, x = F.col("n"), F.col("i"), F.col("x")
    m = normal_quantile((i - 0.375) / (n + 0.25))
    rows = rows.withColumn("m", m)

    def at(rank: Column) -> Column:
        return F.max(F.when(i == rank, x))

    one = rows.groupBy(*keys, "n", "__var").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("m") * x).alias("mx"),
        at(F.lit(1)).alias("x1"),
        at(F.lit(2)).alias("x2"),
        at(n - 1).alias("x3"),
        at(n).alias("x4"),
    )
    mn = normal_quantile((n - 0.375) / (n + 0.25))
    mp = normal_quantile((n - 1 - 0.375) / (n + 0.25))
    one = one.withColumns({"mn": mn, "mp": mp, "u": 1 / F.sqrt(n.cast("double"))})
    root = F.sqrt("mm")
    an = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(
        _poly(WEIGHT_LAST, F.col("u")) + F.col("mn") / root
    )
    ap = _poly(WEIGHT_SECOND, F.col("u")) + F.col("mp") / root
    one = one.withColumns({"an": an, "ap": ap})
    outer = F.col("mx") - F.col("mn") * (F.col("x4") - F.col("x1"))
    inner = outer - F.col("mp") * (F.col("x3") - F.col("x2"))
    an2, ap2, mn2, mp2 = [F.col(c) * F.col(c) for c in ("an", "ap", "mn", "mp")]
    phi_small = (F.col("mm") - 2 * mn2) / (1 - 2 * an2)
    phi_large = (F.col("mm") - 2 * mn2 - 2 * mp2) / (1 - 2 * an2 - 2 * ap2)
    lead = F.col("an") * (F.col("x4") - F.col("x1"))
    second = F.col("ap") * (F.col("x3") - F.col("x2"))
    line = (
        F.when(n == 3, lead)
        .when(n <= 5, lead + outer / F.sqrt(phi_small))
        .otherwise(lead + second + inner / F.sqrt(phi_large))
    )
    w = F.when(F.col("__var") > 0, F.least(line * line / (F.col("__var") * n), F.lit(1.0)))
    one = one.withColumn("w", w)
    ln = F.log(n.cast("double"))
    small = (
        -F.log(0.459 * n - 2.273 - F.log1p(-F.col("w"))) - _poly(SMALL_MEAN, n.cast("double"))
    ) / F.exp(_poly(SMALL_SPREAD, n.cast("double")))
    large = (F.log1p(-F.col("w")) - _poly(LARGE_MEAN, ln)) / F.exp(_poly(LARGE_SPREAD, ln))
    one = one.withColumn("__z", F.when(n <= 11, small).otherwise(large))
    exact = 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75)))
    one = one.withColumn("__p", norm_upper_p("__z"))
    p = F.when(n == 3, F.greatest(exact, F.lit(0.0))).otherwise(F.col("__p"))
    return one.select(*keys, "n", "w", p.alias("p"))


WHOLE = "__whole"


def _named_keys(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """Keys to join by: a constant one where there is a single test over everything."""
    return (df, list(keys)) if keys else (df.withColumn(WHOLE, F.lit(True)), [WHOLE])


def _of_keys(df: DataFrame, routes: DataFrame, keys, wanted: Column) -> DataFrame:
    """The rows of the keys whose route is the wanted one (null keys are keys too)."""
    chosen = routes.filter(wanted).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(chosen, on, "left_semi")


def route_tests(df: DataFrame, keys, by: str, y: str) -> DataFrame:
    """Which test each of `keys` needs: one row per key with two groups of two points or more.

    Normality comes first. Only keys whose groups are all normal (Shapiro-Wilk above 5 %) are
    tested for equal variances: equal gives `anova`, unequal `welch`; all others `kruskal`.
    The keys with their normality are written once, as both the variance test and its routes read them.
    """
    keys = list(keys)
    normal = shapiro(df, [*keys, by], y).select(*keys, by, F.col("p").alias("__sp"))
    sized = moments(df, keys, by, y, 2).select(*keys, by)
    checked = same_keys(sized, normal, [*keys, by], "left")
    normality = checked.groupBy(*keys).agg(
        F.min(F.coalesce(F.col("__sp") > ALPHA, F.lit(False))).alias("all_normal"),
        F.count("*").alias("groups"),
    )
    normality = stored(normality.filter(F.col("groups") >= 2), "normality")
    spread = levene(_of_keys(df, normality, keys, F.col("all_normal")), keys, by, y, 2)
    out = same_keys(normality, spread.select(*keys, F.col("p").alias("__lp")), keys, "left")
    equal = F.when(F.col("all_normal"), F.coalesce(F.col("__lp") > ALPHA, F.lit(False)))
    test = F.when(equal, "anova").when(F.col("all_normal"), "welch").otherwise("kruskal")
    return out.select(*keys, "groups", "all_normal", equal.alias("equal_var"), test.alias("test"))


ROUTED = {"anova": (anova, "f"), "welch": (welch_anova, "f"), "kruskal": (kruskal, "h")}


def compare_groups(df: DataFrame, keys, by: str, y: str) -> DataFrame:
    """The fitting test for each of `keys`: ANOVA, Welch ANOVA or Kruskal-Wallis.

    Groups need two points. `route_tests` picks the test; each test then reads only the rows of
    its own keys. `post_hoc` names the pairwise test to follow (`post_hoc_pairs`).
    """
    rows, names = _named_keys(df, keys)
    routes = stored(route_tests(rows, names, by, y), "routes")
    tested = []
    for test, (run, stat) in ROUTED.items():
        own = _of_keys(rows, routes, names, F.col("test") == test)
        tested.append(run(own, names, by, y, 2).select(*names, F.col(stat).alias("statistic"), "p"))
    out = same_keys(routes, reduce(DataFrame.unionByName, tested), names, "left")
    found = F.coalesce(F.col("p") < ALPHA, F.lit(False))
    post_hoc = F.when(found & (F.col("test") == "anova"), "tukey").when(
        found & (F.col("test") == "welch"), "games_howell"
    )
    return out.select(
        *keys, "groups", "all_normal", "equal_var", "test", "statistic", "p",
        found.alias("significant"), post_hoc.alias("post_hoc"),
    )


def post_hoc_pairs(df: DataFrame, compared: DataFrame, keys, by: str, y: str) -> DataFrame:
    """The pairwise test that `compared` (from `compare_groups`) names, run for the keys it names it for.

    One row per pair of groups with two points or more: `post_hoc`, diff, q, df (as a double), p
    and `differs` at 5 %. Keys without a finding, or compared by ranks, have no pairs.
    """
    rows, names = _named_keys(df, keys)
    named = _named_keys(compared, keys)[0].select(*names, "post_hoc")
    enough = moments(rows, names, by, y, 2).select(*names, by)
    rows = same_keys(rows, enough, [*names, by])
    pairs = []
    for post_hoc, run in (("tukey", tukey_hsd), ("games_howell", games_howell)):
        out = run(_of_keys(rows, named, names, F.col("post_hoc") == post_hoc), names, by, y)
        pairs.append(out.withColumn("post_hoc", F.lit(post_hoc)).withColumn("df", F.col("df").cast("double")))
    out = reduce(DataFrame.unionByName, pairs)
    differs = F.coalesce(F.col("p") < ALPHA, F.lit(False))
    return out.select(*keys, "post_hoc", "group_a", "group_b", "diff", "q", "df", "p", differs.alias("differs"))


def seasonality_test(df: DataFrame, keys, y: str, date: str = "date") -> DataFrame:
    """Do sales differ between calendar months, by ANOVA or Kruskal-Wallis at 5 %?"""
    keys = list(keys)
    rows = df.withColumn("__moy", F.month(date))
    a = anova(rows, keys, "__moy", y).select(*keys, "f", F.col("p").alias("p_anova"))
    k = kruskal(rows, keys, "__moy", y).select(*keys, "h", F.col("p").alias("p_kruskal"))
    if keys:
        out = same_keys(a, k, keys)
    else:
        out = a.withColumns({n: k.select(n).scalar() for n in ("h", "p_kruskal")})
    seasonal = (F.col("p_anova") < ALPHA) | (F.col("p_kruskal") < ALPHA)
    return out.withColumn("seasonal", F.coalesce(seasonal, F.lit(False)))


def _grid(lo: Column, hi: Column, points: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(i.alias("i"), (lo + (hi - lo) * i / (points - 1)).alias("x")),
    )


def normal_curve(df: DataFrame, by, y: str, points: int = 200) -> DataFrame:
    """Density of the fitted normal at equally spaced points from least to greatest value."""
    one = df.groupBy(*by).agg(
        F.avg(y).alias("mu"), F.stddev_samp(y).alias("sigma"),
        F.min(y).alias("lo"), F.max(y).alias("hi"),
    ).filter(F.col("sigma") > 0)
    rows = one.select(*by, "mu", "sigma", F.inline(_grid(F.col("lo"), F.col("hi"), points)))
    z = (F.col("x") - F.col("mu")) / F.col("sigma")
    return rows.withColumn("density", F.exp(-z * z / 2) / (F.col("sigma") * math.sqrt(2 * math.pi)))


KDE_TERMS, KDE_CELLS = 12, 4


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the probabilists' Hermite polynomials of degree 0 to terms - 1."""
    rows = [[1.0], [0.0, 1.0]]
    for n in range(1, terms - 1):
        up = [0.0, *rows[n]]
        for m, c in enumerate(rows[n - 1]):
            up[m] -= n * c
        rows.append(up)
    return rows[:terms]


def kde(df: DataFrame, by, y: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid, Scott bandwidth.

    Values are binned into cells of a quarter bandwidth, and each cell keeps the first twelve
    moments about its centre. The kernel's Hermite series gives a cell's part at a grid point from
    these moments, with an error below 1e-14 of the kernel's height, so the work is one pass over the
    rows plus cells times grid points, and only cells and grid points are shuffled. Groups of fewer than two
    values or of equal values have no density and no rows; null and non-finite values take no part.
    """
    by = list(by)
    x = F.col(y).cast("double")
    seen = df.select(*by, x.alias("__y")).filter(F.abs("__y") < float("inf"))
    one = seen.groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_samp("__y").alias("__s"),
        F.min("__y").alias("__lo"), F.max("__y").alias("__hi"),
    ).filter(F.col("__s") > 0)
    h = F.col("__s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    one = one.withColumn("h", h)
    at = (F.col("__y") - F.col("__lo")) / F.col("h")
    rows = same_keys(seen, one, by).withColumns({"__at": at, "__cell": F.floor(at * KDE_CELLS)})
    rows = rows.withColumn("__u", F.col("__at") - (F.col("__cell") + 0.5) / KDE_CELLS)
    power, moments_of = F.lit(1.0), []
    for i in range(KDE_TERMS):
        moments_of.append(F.sum(power).alias(f"__m{i}"))
        power = power * F.col("__u")
    cells = rows.groupBy(*by, "n", "h", "__lo", "__hi", "__cell").agg(*moments_of)
    series = _hermite(KDE_TERMS)
    parts = [
        sum(
            (F.col(f"__m{i}") * (series[i][m] / math.factorial(i)) for i in range(m, KDE_TERMS, 2)), F.lit(0.0)
        ).alias(f"__p{m}")
        for m in range(KDE_TERMS)
    ]
    lo, hi = F.col("__lo") - cut * F.col("h"), F.col("__hi") + cut * F.col("h")
    centre = F.col("__lo") + (F.col("__cell") + 0.5) / KDE_CELLS * F.col("h")
    grid = cells.select(*by, "n", "h", centre.alias("__centre"), *parts, F.inline(_grid(lo, hi, points)))
    grid = grid.withColumn("__z", (F.col("x") - F.col("__centre")) / F.col("h"))
    z, curve = F.col("__z"), F.lit(0.0)
    for m in reversed(range(KDE_TERMS)):
        curve = curve * z + F.col(f"__p{m}")
    sums = grid.groupBy(*by, "i", "x", "n", "h").agg(F.sum(curve * F.exp(-z * z / 2)).alias("__d"))
    density = F.col("__d") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return sums.select(*by, "i", "x", density.alias("density"))

"""Ordered computations over groups that may be too large for one task.

Running totals, ranks and exact quantiles need an order inside a group. A window
over the whole group would bring it into one task, so a large group is first cut
into ranges of about equally many rows. The bounds are taken from a sample of the
group: of the rows of each hash bucket the one with the least hash, so the sample
is bounded, depends on the rows alone, and recomputed tasks agree. Rows of equal
value are told apart by their tie columns, so ties are cut like anything else.
Each range is ordered on its own and starts from the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesgrid.functions.sums import same_keys

SAMPLE = 4096  # rows of a group that its bounds are taken from, at most
RANGES = 256  # ranges of a group, at most
SKETCH = 10_000  # accuracy of the sketch that brackets a quantile
RANGE_ROWS = 20_000  # a group of no more rows stays whole


def _place(df: DataFrame, order: str, descending: bool, tie: tuple[str, ...]) -> Column:
    """What rows are ordered by: the value, nulls last, then the ties (a hash of the row if none)."""
    x = -F.col(order) if descending else F.col(order)
    if tie:
        rest = [c for t in tie for c in (F.col(t).isNull(), F.col(t))]
    else:
        rest = [F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])]
    parts = [F.col(order).isNull(), x, *rest]
    return F.struct(*[c.alias(f"p{i}") for i, c in enumerate(parts)])


def cut(
    df: DataFrame,
    keys: list[str],
    order: str,
    descending: bool = False,
    tie: tuple[str, ...] = (),
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add `__at`, the place of a row, and `__r`, the range of its group that holds it."""
    df = df.withColumn("__at", _place(df, order, descending, tie))
    spot = df.select(*keys, "__at", F.xxhash64("__at").alias("__h"))
    least = (
        spot.groupBy(*keys, F.pmod("__h", F.lit(SAMPLE)).alias("__b"))
        .agg(F.min(F.struct("__h", "__at")).alias("__s"), F.count("*").alias("__c"))
    )
    sample = F.sort_array(F.collect_list("__s.__at"))
    number = F.least(F.lit(RANGES), F.ceil(F.sum("__c") / rows)).cast("int")
    few = least.groupBy(*keys).agg(sample.alias("__s"), number.alias("__k"))
    at = F.transform(
        F.sequence(F.lit(1), F.col("__k") - 1),
        lambda i: F.element_at("__s", (F.floor(i * F.size("__s") / F.col("__k")) + 1).cast("int")),
    )
    bounds = F.when(F.col("__k") > 1, at).otherwise(F.slice("__s", 1, 0))
    few = few.select(*keys, bounds.alias("__bounds"))
    df = same_keys(df, few, keys) if keys else df.withColumn("__bounds", few.scalar())
    # Binary search: how many of the sorted bounds are at or before the row, one step per power of two.
    steps = [2**i for i in reversed(range((RANGES - 1).bit_length()))]
    passed = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda n, s: F.when(F.get("__bounds", n + s - 1) <= F.col("__at"), n + s).otherwise(n),
    )
    return df.withColumn("__r", F.coalesce(passed, F.lit(0))).drop("__bounds")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, Column],
    descending: bool = False,
    tie: tuple[str, ...] = (),
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add running totals (this row included) of `totals` within `keys`, by the number `order`.

    Nulls of `order` come last. `tie` fixes the order of equal values. Keep the
    totals exact (integers, decimals) where results must not vary between runs.
    Rows alike in `order` and `tie` share a range, so let `tie` tell rows apart.
    """
    keys = list(keys)
    cols = df.columns
    names = {name: f"__add_{name}" for name in totals}
    df = df.withColumns({names[n]: c for n, c in totals.items()})
    df = cut(df, keys, order, descending, tie, rows)
    ranked = keys + ["__r"]
    # one row per range: at most RANGES of a group meet here
    before = (
        Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        df.groupBy(*ranked)
        .agg(*[F.sum(a).alias(a) for a in names.values()])
        .select(*ranked, *[F.sum(a).over(before).alias(f"__from{a}") for a in names.values()])
    )
    inside = (
        Window.partitionBy(*ranked)
        .orderBy("__at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.withColumns({f"__in{a}": F.sum(a).over(inside) for a in names.values()})
    if not keys:
        starts = F.broadcast(starts)  # RANGES rows at most
    out = same_keys(out, starts, ranked)
    zero = F.lit(0)
    return out.select(
        *cols,
        *[
            (F.coalesce(F.col(f"__from{a}"), zero) + F.col(f"__in{a}")).alias(n)
            for n, a in names.items()
        ],
    )


def with_rank(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str = "rank",
    descending: bool = True,
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """Row number 1..n within `keys`, for groups of any size."""
    return with_running(df, keys, order, {name: F.lit(1).cast("bigint")}, descending, tie)


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Distinct non-null values per group with their count `__c` and the rows before: `__b`."""
    counts = (
        df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("__c"))
    )
    run = with_running(counts, keys, col, {"__upto": F.col("__c")})
    return run.withColumn("__b", F.col("__upto") - F.col("__c")).drop("__upto")


def exact_quantiles(
    df: DataFrame, keys: list[str], col: str, wanted: dict[str, float], short: bool = False
) -> DataFrame:
    """Linear-interpolated exact quantiles per group; one row per group with a value.

    Groups known to be `short`, such as a row a month, are gathered by one aggregate. Otherwise a
    mergeable sketch, whose ranks are off by one part in SKETCH at most, brackets each quantile.
    A second pass counts the values below the bracket and orders only those inside it, counted by
    value, so of a group a few parts in SKETCH meet, whatever its size (all of it up to SKETCH rows).
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    seen = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull())
    if short:
        picked = [F.percentile("__x", p).alias(name) for name, p in wanted.items()]
        out = seen.groupBy(*keys).agg(F.count("*").alias("__n"), *picked)
        return out.filter(F.col("__n") > 0).drop("__n")
    points = [min(1.0, max(0.0, p + side * 3 / SKETCH)) for p in wanted.values() for side in (-1, 1)]
    sketch = seen.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.percentile_approx("__x", points, SKETCH).alias("__q")
    )
    if keys:
        placed = same_keys(seen, sketch, keys)
    else:
        both = sketch.select(F.struct("__n", "__q")).scalar()
        placed = seen.withColumns({"__n": both.getField("__n"), "__q": both.getField("__q")})
    # each row with the quantiles that it counts for: with its value inside the bracket, without one below it
    few = F.col("__n") <= SKETCH  # all of it is inside: three parts would be fewer rows than ranks needed
    counted = F.array_compact(F.array(*[
        F.when(few | (F.col("__x") <= F.col("__q")[2 * i + 1]),
               F.struct(F.lit(i).alias("i"), F.when(few | (F.col("__x") >= F.col("__q")[2 * i]), F.col("__x")).alias("v")))
        for i in range(len(wanted))
    ]))
    cells = (
        placed.select(*keys, "__n", F.explode(counted).alias("__e")).select(*keys, "__n", "__e.i", "__e.v")
        .groupBy(*keys, "i", "v").agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    )
    upto = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("__upto", F.sum("__c").over(upto)).withColumn("__b", F.col("__upto") - F.col("__c"))
    aggs = []
    for i, (name, p) in enumerate(wanted.items()):
        at = F.lit(p) * (F.col("__n") - 1)
        below, above = F.floor(at), F.ceil(at)

        def pick(rank: Column) -> Column:
            return F.max(F.when((F.col("i") == i) & (F.col("__b") <= rank) & (rank < F.col("__upto")), F.col("v")))

        lo, hi = pick(below), pick(above)
        aggs.append((lo + (hi - lo) * F.max(at - below)).alias(name))
    out = run.groupBy(*keys).agg(F.count("*").alias("__rows"), *aggs)
    return out.filter(F.col("__rows") > 0).drop("__rows")


def top_rows(df: DataFrame, order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """The first n rows of the order; with `name`, numbered 1..n (only those n rows meet)."""
    top = df.orderBy(*order).limit(n)
    if name is None:
        return top
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))

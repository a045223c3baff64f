"""The sales fact over the order tables, and its storage as Parquet.

`sales_lines` joins only the tables that the asked-for dimensions need, so a
brand total reads lineitem and part alone. Orders meet their buyers first, so the lines
are shuffled by order and by part only, never by customer. No side is broadcast by hint: the
planner decides from the tables' sizes, and splits skewed join keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salesgrid.functions.dates import month_start
from salesgrid.functions.sums import exact_sum
from salesgrid.operators.windows import MonthWindow, Months

DIMS = ("market", "channel", "category", "brand")
OPTIONAL_DIMS = ("segment", "manufacturer")
MEASURES = ("value_sales", "unit_sales", "share")

FACT_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(d, T.StringType()) for d in DIMS]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """The month of every line: one column, enough to resolve a window."""
    return read_table(spark, folder, "lineitem").select(month_start("l_shipdate").alias("date"))


def months(spark: SparkSession, folder: str) -> Months:
    """The first and last month of the lines, read now."""
    return Months.read(calendar(spark, folder))


def sales_lines(
    spark: SparkSession, folder: str, dims=DIMS, window: MonthWindow | None = None
) -> DataFrame:
    """One row per order line: month, the asked-for dimensions, exact value and units.

    With `window` only its months are read. A comparison of windows passes their `hull`.
    """
    lines = read_table(spark, folder, "lineitem")
    if window is not None:
        kind = dict(lines.dtypes)["l_shipdate"]
        start, stop = window.bounds(spark, kind)
        lines = lines.filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < stop))
    lines = lines.select(
        "l_orderkey",
        "l_partkey",
        month_start("l_shipdate").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .cast("decimal(18,4)")
        .alias("value_sales"),
        F.col("l_quantity").cast("decimal(18,4)").alias("unit_sales"),
    )
    if {"market", "channel"} & set(dims):
        buyer = read_table(spark, folder, "customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_mktsegment").alias("channel"),
            "c_nationkey",
        )
        if "market" in dims:
            nation = read_table(spark, folder, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey")
            )
            region = read_table(spark, folder, "region").select(
                "r_regionkey", F.col("r_name").alias("market")
            )
            buyer = buyer.join(nation, "c_nationkey").join(region, "r_regionkey")
        orders = read_table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey"
        )
        lines = lines.join(orders.join(buyer, "o_custkey").drop("o_custkey"), "l_orderkey")
    if {"category", "brand"} & set(dims):
        part = read_table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
        )
        lines = lines.join(part, "l_partkey")
    return lines.select("date", *[d for d in DIMS if d in dims], "value_sales", "unit_sales")


def to_fact(lines: DataFrame) -> DataFrame:
    """Monthly fact from lines with all four dimensions; share is % of month, market,
    channel and category."""
    cells = lines.groupBy("date", *DIMS).agg(
        exact_sum(lines, "value_sales").alias("value_sales"),
        exact_sum(lines, "unit_sales").alias("unit_sales"),
    )
    whole = Window.partitionBy("date", "market", "channel", "category")
    total = F.sum(F.col("value_sales").cast("decimal(28,4)")).over(whole).cast("double")
    return cells.withColumn(
        "share", F.when(total != 0, F.round(100 * F.col("value_sales") / total, 6))
    )


def fact(spark: SparkSession, folder: str, window: MonthWindow | None = None) -> DataFrame:
    return to_fact(sales_lines(spark, folder, DIMS, window))


def load_fact(
    spark: SparkSession, path: str, mapper: dict[str, str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read a table and rename its columns; `mapper` is canonical name -> source name."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return apply_mapper(reader.format(fmt).load(path), mapper)


def apply_mapper(df: DataFrame, mapper: dict[str, str] | None) -> DataFrame:
    return df.withColumnsRenamed({src: canon for canon, src in (mapper or {}).items()})


def save_fact(df: DataFrame, path: str, view: str = "fact") -> DataFrame:
    """Write the fact partitioned by its month and register what was written under `view`.

    Windows filter `date`, so they read only their months' folders. Spark evens the
    write tasks out by size (a month is as many files as it needs).
    """
    df.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
    stored.createOrReplaceTempView(view)
    return stored

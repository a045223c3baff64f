"""JSON-lines and CSV in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, `spark.checkpoint.dir`.

    Only a local session gets a temporary folder when that is not set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="salesgrid-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows written to the shared folder and read back, for a small result that several blocks read.

    What leads to it runs once; a lost executor costs only its own tasks.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, and its broken lines as they are written (column `line`).

    A line is broken if it is no JSON object, is cut off, or holds a value that its column cannot take;
    then none of its values count. Blank lines are neither. An empty file gives two empty results.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    broken = "__broken"
    full = T.StructType([*fields.fields, T.StructField(broken, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    read = lines.select("value", F.from_json("value", full, how).alias("__row"))
    bad = F.col("__row").isNull() | F.col("__row")[broken].isNotNull()
    rows = read.filter(~bad).select(*[F.col("__row")[f.name].alias(f.name) for f in fields.fields])
    return rows, read.filter(bad).select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)

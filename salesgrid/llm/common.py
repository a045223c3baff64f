"""Tables cut from their lineage, and connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate data (`spark.checkpoint.dir`).

    Only a local session, as in tests, gets a temporary folder when the setting is missing.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = spark.conf.get("salesgrid.llm.folder", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("salesgrid.llm.folder", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: no lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b: long) as rows (id, root), root the smallest id.

    Alternating large-star and small-star rounds on the edge table; roots are not listed.
    Every round is two grouped minima joined back to the edges, so a hub of any degree is
    pre-aggregated and its join can be split; the rounds grow with the logarithm of the
    longest path. Null ends and loops are left out.
    """
    e = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _fingerprint(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        e = settle(small.distinct())
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(
        e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )

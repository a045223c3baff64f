"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesgrid.llm import language, mixing, near_dedup, packing, quality
from salesgrid.llm.common import settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    scored = quality.score(docs, model, tuple(docs.columns))
    return scored.where(F.col("score") >= quality.GOOD).select(docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language: not undetermined, and, unless very short, mostly known n-grams."""
    filters = language.fit(docs, F.lit(True))
    named = language.identify(docs, filters, tuple(docs.columns))
    unknown = (F.col("lang_pred") == language.UNKNOWN) | (
        (F.col("score") < language.SURE) & (F.length("text") >= language.SHORT)
    )
    return named.where(~unknown).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates and of repeated rows: the smallest doc_id, nulls last."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    # ids may repeat or be null: rows are told apart by a number that is settled before the stage
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_dedup.near_duplicates(numbered, row, "text")
    # rows without words are linked with nothing, only whole repeated rows are one
    wordless = ~F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns])).cast("binary"))
    slim = numbered.select(row, "doc_id", F.when(wordless, whole).alias("_whole"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    kept = (
        groups.select(row, "n_shingles", "component_id").join(slim, row)
        .groupBy(F.coalesce(F.when(F.col("n_shingles") == 0, F.col("_whole")), F.col("component_id").cast("string")).alias("_of"))
        .agg(F.min(first)[row].alias(row))
    )
    return numbered.join(kept.select(row), row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_known_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # trained scores, n-gram filters and tokens: compared with brute force in tests/llm

"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a hash of its id, its size and its number among the rows alike in these. A source whose target is t times its size takes each
document floor(t) times, and once more those whose hash lies below the source's threshold. The
threshold is found without sorting: sizes are summed by source and hash bucket, the bucket in
which the budget runs out is the only one refined, down to a single hash. The document at the
threshold may leave a remainder; further levels spend it in the same way on the documents above
the threshold that fit into it, until it is below NEAR of the target or no document fits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document, and a source, may be taken
BITS, STEP = 60, 12  # bits of a hash; bits told apart in one histogram
NEAR = 0.0005
WORD = r"[^\x20\x09-\x0D]+"


def id_hash(column: str) -> Column:
    """60 bits of the MD5 of the id as text; 0 for a null id."""
    text = F.col(column).cast("string").cast("binary")
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(0))


def _hashed(rows: DataFrame, id_col: str, size: str) -> DataFrame:
    """rows (with src and a row number _row, settled) with h: 60 bits that tell rows apart, whatever their ids.

    Rows alike in source, id and size are numbered from 0, by partition: a partition's rows start
    from the number of those in the partitions before it, so a group of any size is numbered where
    its rows lie. Rows of one number are alike in all that counts, so reruns agree.
    """
    like = ["src", "_id", "_size"]
    rows = rows.withColumns({"_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_size": F.col(size), "_part": F.shiftright("_row", 33)})
    again = settle(rows.groupBy(*like, "_part").agg(F.count("*").alias("_n")))
    many = again.groupBy(*like).agg(F.sum("_n").alias("_all")).where("_all > 1").select(*like)
    before = Window.partitionBy(*like).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = again.join(many, like, "left_semi").select(*like, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    out = rows.join(settle(starts), [*like, "_part"], "left")
    inside = Window.partitionBy(*like, "_part").orderBy("_row")
    twice = out.where("_from IS NOT NULL").withColumn("_nth", F.col("_from") + F.row_number().over(inside) - 1)
    once = out.where("_from IS NULL").withColumn("_nth", F.lit(0).cast("long"))
    text = F.concat_ws(":", "_id", F.col("_size").cast("string"), F.col("_nth").cast("string")).cast("binary")
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return once.unionByName(twice).withColumn("h", h).drop("_id", "_size", "_part", "_from", "_nth")


def source_key(column: str) -> Column:
    """The source as a text that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column).cast("string")), F.lit("1"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (src, source_size) with target: shares by weight, at most MOST times the size.

    Sources in the order of src take the weights in turn. The sources whose limit is small for
    their weight come first; they are full as long as the common level of the sources after
    them is above their own. The table has one row for each source.
    """
    place = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    s = sources.select(
        "src", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * MOST).alias("cap"),
    ).select("*", F.sum("source_size").over(whole).alias("total"), F.sum("w").over(whole).alias("all_w"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_size"),
        (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    s = s.withColumn("full", F.col("left_size") * F.col("w") > F.col("cap") * F.col("left_w"))
    first_open = F.first(F.when(~F.col("full"), F.struct("left_size", "left_w")), ignorenulls=True)
    s = s.withColumn("level", first_open.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = (F.col("level.left_size") * F.col("w")).cast("double") / F.col("level.left_w").cast("double")
    return s.select(
        "src", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def _threshold(pool: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source (src, budget) the first hash at which its pool (src, h, size) exceeds its budget
    as `low`, 2**BITS if all of it fits, and the size below it as `used`.
    """
    state = budgets.select(
        "src", "budget", F.lit(1 << BITS).alias("low"), F.lit(0).cast("long").alias("used"),
        F.lit(True).alias("mixed"), F.lit(None).cast("long").alias("bucket"),
    )
    for shift in range(BITS - STEP, -1, -STEP):
        here = F.expr(f"shiftright(h, {shift})").alias("b")
        sums = pool.groupBy("src", here).agg(
            F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        # at most 2**STEP buckets of a source
        upto = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hit = (
            sums.join(state.select("src", "used", "budget"), "src")
            .select("*", (F.col("used") + F.sum("size").over(upto)).alias("upto"))
            .where("upto > budget").groupBy("src")
            .agg(F.min(F.struct("b", "upto", "size", "first", "last")).alias("hit"))
        )
        # a bucket with one hash only is settled; one with several is refined in the next round
        state = settle(
            state.withColumnRenamed("used", "was").join(hit, "src", "left").select(
                "src", "budget",
                F.coalesce("hit.first", "low").alias("low"),
                F.coalesce(F.col("hit.upto") - F.col("hit.size"),
                           F.when(F.col("bucket").isNotNull(), F.col("was"))).alias("used"),
                F.coalesce(F.col("hit.first") < F.col("hit.last"), F.lit(False)).alias("mixed"),
                F.coalesce("hit.b", "bucket").alias("bucket"),
            )
        )
        going = state.where("mixed").select("src", F.col("bucket").alias("b"))
        if shift == 0 or not going.head(1):
            break
        pool = pool.join(going, (pool.src == going.src) & (F.expr(f"shiftright(h, {shift})") == F.col("b")), "left_semi")
    return state


def mix(
    rows: DataFrame, source: str = "source", size: str = "size", hash_by: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """rows with source_size, target (its source's) and copies (0 to MOST: how often it is taken).

    size is a long column, null counting as 0. Repeated ids, and rows without id, are told apart
    by their size and number; a null source is a source. An empty table gives no rows. The input's
    own columns of the three new names are replaced.
    """
    names = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    held = settle(rows.select(
        F.struct(*[F.col(c) for c in names]).alias("_in"), source_key(source).alias("src"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(hash_by).cast("string").alias("id"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    slim = settle(_hashed(held.drop("_in"), "id", "size").select("src", "size", "h", "_row"))
    plan = settle(
        source_targets(slim.groupBy("src").agg(F.sum("size").alias("source_size")), weights)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(0).cast("long"))
    )
    left = plan.select(
        "src", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long").alias("budget"), "target"
    )
    # what a level takes: the rows of its pool below the threshold; the next pool is what lies above and fits
    pool, taken = slim.where("size > 0"), []
    while left.head(1):
        found = settle(_threshold(pool, left.select("src", "budget")))
        marks = pool.join(found.select("src", "low"), "src")
        taken.append(marks.where("h < low").select("_row"))
        left = settle(
            left.join(found.where(F.col("low") < (1 << BITS)).drop("budget"), "src")
            .select("src", (F.col("budget") - F.col("used")).alias("budget"), "target")
            .where(F.col("budget") > F.col("target") * NEAR)
        )
        pool = settle(
            marks.where("h >= low").select("src", "size", "h", "_row")
            .join(left.select("src", "budget"), "src").where("size <= budget").select("src", "size", "h", "_row")
        )
        left = left.join(pool.select("src").distinct(), "src", "left_semi")
    once = reduce(DataFrame.unionByName, taken) if taken else slim.where("false").select("_row")
    known = slim.select("_row").join(once.withColumn("_once", F.lit(1)), "_row", "left").where("_once = 1")
    packed = held.join(known, "_row", "left").join(plan, "src")
    copies = F.col("base") + F.coalesce("_once", F.lit(0))
    return packed.select(
        *[F.col("_in")[c].alias(c) for c in names], "source_size", "target", copies.cast("int").alias("copies")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size (words), source_size, target and taken (words, repeats counted) per document."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return mix(slim).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    sized = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(source_col).alias("source"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    repeated = mix(sized).where("copies > 0").withColumn(
        "_n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    )
    return repeated.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
docs AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' ||
           (row_number() OVER (PARTITION BY source, doc_id, size) - 1)), 1, 15))::BIGINT AS h
  FROM sized),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s1),
s3 AS (SELECT *,
         total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         all_w - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM s2),
s4 AS (SELECT *, left_size * w > cap * left_w AS is_full FROM s3),
lv AS (SELECT left_size AS ls, left_w AS lw FROM s4 WHERE NOT is_full ORDER BY cap / w, source NULLS LAST LIMIT 1),
s5 AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
         ELSE CAST(ls * w AS DOUBLE) / CAST(lw AS DOUBLE) END AS target FROM s4 LEFT JOIN lv ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM s5),
d0 AS (SELECT d.doc_id, d.source, d.size, d.h, p.source_size, p.target, p.base,
         CAST(floor(p.target - p.base * p.source_size) AS BIGINT) AS budget, 0 AS took, d.size > 0 AS pool, 0 AS step
       FROM docs d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (
  SELECT * FROM d0
  UNION ALL
  SELECT doc_id, source, size, h, source_size, target, base, rest AS budget, took,
         pool AND took = 0 AND size <= rest AND rest > target * 0.0005 AS pool, step
  FROM (SELECT *, budget - coalesce(max(CASE WHEN pool AND cum <= budget THEN cum END) OVER (PARTITION BY source), 0) AS rest
        FROM (SELECT doc_id, source, size, h, source_size, target, base, budget, pool, step + 1 AS step, cum,
                     took + CASE WHEN pool AND cum <= budget THEN 1 ELSE 0 END AS took
              FROM (SELECT *, CASE WHEN pool THEN sum(CASE WHEN pool THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS cum,
                           bool_or(pool) OVER () AS going FROM r) WHERE going)))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (base + took) AS BIGINT) AS taken
FROM (SELECT *, max(step) OVER () AS last FROM r) WHERE step = last"""

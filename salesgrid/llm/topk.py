"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash of their id, queries likewise; a task holds one block
of each. In it every dimension has its candidates in sorted order. A query reads all its lists
from the good end (the largest values for a positive weight, the smallest for a negative one),
scores each candidate it meets exactly, and stops when the value of the threshold, the score
of a candidate that stood at the current place in every list, is below its kth score. Blocks'
winners are merged by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

K = 5
SCALE = 256
CANDIDATES, QUERIES = 16_384, 1_024  # rows of a block, about
FIRST_DEPTH = 32
WHOLE = float(1 << 52)  # doubles from here on are whole numbers
LONG = (1 << 63) - 1
DIGITS = 650  # of the inner product of any two vectors of doubles, scaled


class Lists:
    """A block's vectors and, for every dimension, its rows in rising order of their value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.rising, axis=1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best others, ties to the smaller id, and the depth read."""
        n = len(self.ids)
        weights = np.flatnonzero(query)
        down = query[weights] > 0
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, n)
            ahead = np.where(down[:, None], n - 1 - np.arange(begin, depth), np.arange(begin, depth))
            here = np.zeros(n, dtype=bool)
            here[self.rising[weights[:, None], ahead] if len(weights) else slice(None)] = True
            met = np.flatnonzero(here & ~seen)
            seen |= here
            fresh = met[self.ids[met] != own]
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ query])
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            last = np.where(down, n - depth, depth - 1)
            bound = int((self.values[weights, last] * query[weights]).sum()) if len(weights) else 0
            # a candidate not met yet scores at most the bound; at the bound its id may be smaller
            if depth == n or not len(weights) or (len(rows) == k and scores[-1] > bound):
                return rows, scores, depth
            begin, depth = depth, depth * 2


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """SCALE * vectors, whole by `scaled`, of a kind that holds sums of their products exactly.

    Doubles as long as these stay below 2**53, then 64-bit integers, else Python integers.
    """
    size = np.abs(vectors).max(initial=0.0) * SCALE
    if size * size * max(1, vectors.shape[1]) < WHOLE:
        return vectors * SCALE
    if size * size * max(1, vectors.shape[1]) < 2.0**62:
        return (vectors * SCALE).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) > WHOLE else int(x * SCALE) for x in vectors.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def as_long(score: int) -> tuple[int, str]:
    """The score as a long, and, if it is too large for one, a text that sorts like it."""
    if abs(score) <= LONG:
        return score, ""
    return (LONG, f"{score:0{DIGITS}d}") if score > 0 else (-LONG - 1, f"{score + 10**DIGITS:0{DIGITS}d}")


def _search(k: int):
    def search(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            for size, of_size in rows.groupby(rows.vector.map(len)):
                mine = queries[queries.vector.map(len) == size]
                if not len(mine):
                    continue
                # queries and candidates together, so that both are of one kind
                numbers = whole_numbers(np.stack([*of_size.vector, *mine.vector]))
                lists = Lists(of_size.vec_id.to_numpy(), numbers[: len(of_size)])
                for query_id, vector in zip(mine.vec_id, numbers[len(of_size) :], strict=True):
                    found, scores, _ = lists.top(vector, query_id, k)
                    out += [(query_id, int(lists.ids[r]), *as_long(int(s))) for r, s in zip(found, scores, strict=True)]
        table = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond"])
        return table.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return search


def scaled(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector: components cut to multiples of 1 / SCALE, so that SCALE times each is the
    whole number floor(SCALE * component), however large. Unusable vectors and null ids are left out.
    """

    def cut(v):
        x = v.cast("double")
        return F.when(F.abs(x) * SCALE < WHOLE, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)

    sound = F.forall(
        F.col(vector_col),
        lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")),
    )
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), cut).alias("vector")
    )


def top_k(
    rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k best rows with another id.

    is_query is a condition on vec_id. Vectors that are null or hold null or non-finite
    components take no part, as query or candidate; vectors of different lengths are not
    compared. Repeated ids with equal vectors count once. Products are exact at any size; a score
    beyond a long is ranked by its true value and shown as the nearest long.
    """
    table = settle(scaled(rows, id_col, vector_col).distinct())
    n, asked = table.agg(F.count("*"), F.count_if(is_query)).first()
    sides = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = table.select(block(sides[0]).alias("c"), each(sides[1]).alias("q"), "vec_id", "vector")
    queries = table.where(is_query).select(each(sides[0]).alias("c"), block(sides[1]).alias("q"), "vec_id", "vector")
    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long, beyond string"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_embeddings(rows: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50."""
    return top_k(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

"""A quality classifier: random Fourier features of document statistics, ridge, isotonic scores.

Statistics of whole texts are scaled and mapped to DIMS cosines of random directions, which
approximate a Gaussian kernel. Every partition sums its part of the normal equations, by fold;
the driver adds the sums (DIMS x DIMS numbers) and solves them. Scores of each fold under the
other folds' weights fit an isotonic curve, which turns the ridge score into a share of good
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.llm import textbytes as tb
from salesgrid.llm.common import settle
from salesgrid.llm.language import fold
from salesgrid.llm.mixing import BITS, id_hash

DIMS = 256
SAMPLE = 20_000  # labelled rows to learn from, about, chosen by a hash of the id
PARTS = 8  # partitions of that sample, each of which sums DIMS x DIMS numbers
FOLDS = 4
RIDGES = (1e-3, 1e-2, 1e-1, 1.0)  # per row; the one with the smallest error across folds is taken
GOOD = 0.7

_KINDS = {
    "upper": [range(65, 91)], "lower": [range(97, 123)], "wide": [range(128, 256)],
    "digit": [range(48, 58)], "bang": [b"!?"], "stop": [b".,;:"], "bar": [b"|"],
    "sign": [b"#$%&*@^~+=<>/\\_"], "line": [b"\n"], "quote": [b"\"'()[]{}`-"],
}
_TABLE = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _groups in enumerate(_KINDS.values()):
    for _g in _groups:
        _TABLE[list(_g)] = _i


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x statistics. A text without words has zeros."""
    count, kinds = len(offsets) - 1, len(_KINDS) + 1
    of_byte = np.repeat(np.arange(count), np.diff(offsets))
    by_kind = np.bincount(of_byte * kinds + _TABLE[data], minlength=count * kinds).reshape(count, kinds)
    doc, start, end = tb.words(data, offsets)
    n_words = np.bincount(doc, minlength=count)
    w, size = np.maximum(1, n_words), np.maximum(1, np.diff(offsets))
    rolling = tb.Rolling(data)
    word = rolling.of(start, end)

    def per_word(which: np.ndarray) -> np.ndarray:
        return np.bincount(doc[which], minlength=count) / w

    def fresh(d: np.ndarray, h: np.ndarray) -> np.ndarray:
        total = np.bincount(d, minlength=count)
        return np.bincount(tb.distinct(d, h)[0], minlength=count) / np.maximum(1, total)

    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    length = end - start
    solid = np.concatenate([[0], np.cumsum(_TABLE[data] <= 2)])
    lettered = solid[end] > solid[start]
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    line = rolling.of(cut, np.append(cut[1:], len(data))) if len(cut) else np.zeros(0, np.uint64)
    line_doc = np.searchsorted(offsets, cut, "right") - 1
    letters = np.maximum(1, by_kind[:, :3].sum(axis=1))
    columns = [
        np.log1p(n_words), np.log1p(by_kind[:, 8]), np.bincount(doc, length, minlength=count) / w / 10,
        by_kind[:, 0] / letters, by_kind[:, 2] / size, by_kind[:, 3] / size,
        *[np.minimum(4, by_kind[:, k] / w) for k in (4, 5, 6, 7, 9)],
        letters / size, per_word(length <= 3), per_word(length > 20), per_word(~lettered), per_word(same),
        fresh(doc, word), fresh(*tb.word_grams(word, doc, 2)), fresh(*tb.word_grams(word, doc, 3)),
        fresh(line_doc, line),
    ]
    out = np.column_stack(columns)
    out[n_words == 0] = 0
    return out


class Model:
    """Scaling, random directions, ridge weights and the isotonic curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(7)
        width = np.sqrt(len(mean)) * 1.2
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(0, 1 / width, (len(mean), DIMS))
        self.shift = rng.uniform(0, 2 * np.pi, DIMS)
        self.weight = np.zeros(DIMS)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def waves(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.sqrt(2 / DIMS) * np.cos(x @ self.turn + self.shift)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values of the least-squares isotonic fit (pooled neighbours)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([1.0, float(y), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    knots = np.array([b[2] / b[0] for b in blocks])
    values = np.array([(b[1] + 0.5) / (b[0] + 1) for b in blocks])  # shrunk: a block may be one row
    return knots, np.maximum.accumulate(np.clip(values, 0, 1))


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in tb.chunks(batch.column(1)):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(x)), batch.column(2).slice(row, len(x)),
                 pa.array(list(x), pa.list_(pa.float64()))],
                names=["y", "fold", "x"],
            )


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality",
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """A model from about SAMPLE of the labelled rows where `learn` (over id_col) is true.

    Labels other than 0 and 1 are left out; ids labelled twice count once, with the larger
    label. Without any label all scores are 0.5.
    """
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("mark_id")).agg(F.max(label_col).alias("y"))
        .withColumn("h", id_hash("mark_id"))
    )
    n = marks.count()
    below = min(1 << BITS, int((1 << BITS) * SAMPLE / max(1, n)))
    # about SAMPLE ids are sent to the documents, not the documents to them
    known = docs.where(learn).select(F.col(id_col).alias("mark_id"), F.col(text_col).alias("text"))
    sample = known.join(F.broadcast(marks.where(F.col("h") <= below)), "mark_id").select(
        F.col("y").cast("double").alias("y"), "text", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")
    )
    rows = settle(sample.mapInArrow(_statistics_of, "y double, fold int, x array<double>")).coalesce(PARTS)
    size = len(statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])
    means = rows.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(size) for k, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    value = lambda k, i: means[f"{k}{i}"] or 0.0
    mean = np.array([value("m", i) for i in range(size)])
    model = Model(mean, np.array([max(1e-3, value("s", i)) for i in range(size)]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, DIMS + 2, DIMS))
        for batch in batches:
            if not len(batch):
                continue
            y, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = model.waves(np.array(batch.column(2).to_pylist()))
            for k in range(FOLDS):
                here = part == k
                total[k, :DIMS] += z[here].T @ z[here]
                total[k, DIMS] += z[here].T @ y[here]
                total[k, DIMS + 1, 0] += here.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    total = np.zeros((FOLDS, DIMS + 2, DIMS))
    for r in rows.mapInArrow(sums, "sums binary").toLocalIterator():  # PARTS rows at most
        total += np.frombuffer(r["sums"]).reshape(total.shape)
    if not total[:, DIMS + 1, 0].sum():
        return model

    def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
        rows_in = max(1, sums[DIMS + 1, 0])
        return np.linalg.solve(sums[:DIMS] + ridge * rows_in / DIMS * np.eye(DIMS), sums[DIMS])

    seen = rows.toPandas()  # the bounded sample's statistics
    y, part, z = seen.y.to_numpy(), seen.fold.to_numpy(), model.waves(np.array(seen.x.tolist()))
    best = None
    for ridge in RIDGES:
        out = np.zeros(len(y))
        for k in range(FOLDS):
            out[part == k] = z[part == k] @ solve(total.sum(axis=0) - total[k], ridge)
        error = np.mean((out - y) ** 2)
        if best is None or error < best[0]:
            best = (error, ridge, out)
    model.weight = solve(total.sum(axis=0), best[1])
    model.knots, model.values = isotonic(best[2], y)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of keep and score; null and empty texts are scored as texts without words."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(statistics(data, offsets)) for _, data, offsets in tb.chunks(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*names, "score"]
            )

    slim = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    types = dict(slim.dtypes)
    schema = ", ".join([*[f"{n} {types[n]}" for n in names], "score double"])
    return slim.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score"
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; rows of fold 2 of 4 teach nothing."""
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )

"""Near-duplicate vectors by p-stable hashing.

Vectors are normalised. A table hashes a vector by PROJECTIONS Gaussian projections, each cut
into steps of WIDTH; equal codes share a bucket. The number of projections follows the number
of vectors, so that unlike vectors seldom meet, and the number of tables follows from it, so
that a pair at the threshold meets with probability REACH. In a bucket all pairs are checked by
their cosine, in blocks of rows, so a bucket of any size is split over tasks; pairs are not
written out. A pair counts in the first table in which its codes are equal, so each counts once.
What leaves a task is a count per vector and a star per group of linked vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesgrid.llm import textbytes as tb
from salesgrid.llm.common import components, settle

COSINE = 0.9
WIDTH = 1.8
REACH = 0.93
BLOCK = 512  # rows of a block of a large bucket
TASK_ROWS = 20_000


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that one projection puts two points at this distance into one step."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def design(rows: int) -> tuple[int, int]:
    """Projections and tables: about one chance meeting in ten tables for each vector."""
    near, far = collision(math.sqrt(2 - 2 * COSINE)), collision(math.sqrt(2))
    projections = max(4, math.ceil(math.log(10 * max(2, rows)) / -math.log(far)))
    tables = math.ceil(math.log(1 - REACH) / math.log(1 - near**projections))
    return projections, tables


def _codes(projections: int, tables: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, tuple] = {}
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(1)
            length = np.array(lists.value_lengths())
            parts = []
            for size in np.unique(length):
                pick = np.flatnonzero(length == size)
                own = lists.take(pa.array(pick))
                x = own.flatten().to_numpy().reshape(len(pick), size)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if size not in turns:
                    rng = np.random.default_rng(int(size))
                    turns[size] = rng.normal(size=(size, projections * tables)), rng.uniform(0, WIDTH, projections * tables)
                turn, shift = turns[size]
                for low in range(0, len(pick), 1024):
                    part = x[low : low + 1024]
                    step = np.floor((part @ turn + shift) / WIDTH).astype(np.int64).view(np.uint64)
                    step = step.reshape(len(part), tables, projections)
                    code = np.full((len(part), tables), np.uint64(size))
                    for k in range(projections):
                        code = code * tb.BASE + step[:, :, k]
                    code = (tb.mix(code) >> np.uint64(33)).astype(np.int32)
                    ends = np.arange(len(part) + 1, dtype=np.int32)
                    parts.append(pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(pick[low : low + 1024])),
                         pa.ListArray.from_arrays(pa.array(ends * np.int32(size)), pa.array(part.reshape(-1))),
                         pa.ListArray.from_arrays(pa.array(ends * np.int32(tables)), pa.array(code.reshape(-1)))],
                        names=["rep", "unit", "codes"],
                    ))
            yield from parts

    return hashed


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (number, code, i, j): all linked pairs of each cell, as counts and stars."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in range(4)])
        cut = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
        if kept and len(batch) and any(kept[-1].column(k)[-1] != batch.column(k)[0] for k in range(4)):
            yield from _cells(kept)
            kept = []
        if len(cut):
            yield from _cells([*kept, batch.slice(0, int(cut[-1]))])
            kept = [batch.slice(int(cut[-1]))]
        elif len(batch):
            kept.append(batch)
    if kept:
        yield from _cells(kept)


def _cells(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    number, code, i, j, side, rep, weight = (table.column(k).to_numpy() for k in range(7))
    unit, codes = table.column(7).combine_chunks(), table.column(8).combine_chunks()
    width = np.array(unit.value_lengths())
    starts = np.concatenate([[0], np.cumsum(width)])
    flat = unit.flatten().to_numpy()
    all_codes = codes.flatten().to_numpy().reshape(len(table), -1)
    key = np.stack([number, code, i, j])
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, [len(table)]])
    ids, counts, edges = [], [], []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows = np.arange(low, high)
        one = i[low] == j[low]
        a, b = (rows, rows) if one else (rows[side[low:high] == 0], rows[side[low:high] == 1])
        if not len(a) or not len(b) or (one and len(a) < 2):
            continue
        va, vb = (np.stack([flat[starts[r] : starts[r + 1]] for r in x]) for x in (a, b))
        link = va @ vb.T >= COSINE
        if one:
            link &= np.tri(len(a), len(a), -1, dtype=bool).T
        x, y = np.nonzero(link)
        # only pairs that met in no earlier table
        fresh = np.ones(len(x), dtype=bool)
        for s in range(0, len(x), 4096):
            p, q = a[x[s : s + 4096]], b[y[s : s + 4096]]
            fresh[s : s + 4096] = ~(all_codes[p, : number[low]] == all_codes[q, : number[low]]).any(axis=1)
        x, y = x[fresh], y[fresh]
        if not len(x):
            continue
        ends = np.concatenate([a[x], b[y]])
        others = np.concatenate([b[y], a[x]])
        local = np.unique(ends)
        ids.append(rep[local])
        counts.append(np.bincount(np.searchsorted(local, ends), weight[others], minlength=len(local)).astype(np.int64))
        edges.append(_roots(local, np.searchsorted(local, a[x]), np.searchsorted(local, b[y]), rep))
    if ids:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in (ids, counts, edges)], names=["rep", "links", "root"]
        )


def _roots(local: np.ndarray, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a cell reaches by the cell's links."""
    root = rep[local].copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id_col, n_links, component_id and kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor
    does a row without id (component null, kept). Equal vectors are one vector with a count, and
    link with each other; repeated rows do so too. Vectors of different lengths never link.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = (
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    slim = slim.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))  # -0 is 0
    classes = settle(
        slim.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    )
    projections, tables = design(classes.count())
    coded = settle(
        classes.select("rep", "v").mapInArrow(_codes(projections, tables), "rep long, unit array<double>, codes array<int>")
    )
    # vectors of different lengths share no bucket, whatever their codes (of 31 bits)
    entries = settle(
        coded.select("rep", F.size("unit").cast("long").alias("width"), F.posexplode("codes").alias("number", "code"))
        .select("rep", "number", (F.col("width") * F.lit(1 << 31) + F.col("code")).alias("code"))
    )
    shared = entries.groupBy("number", "code").agg(F.count("*").alias("n")).where("n > 1")
    spots = entries.join(shared, ["number", "code"]).select(
        "number", "code", "rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    # block pairs (i, j) of a bucket: a row of block b is on the left of (b, j) and the right of (i, b)
    block = F.pmod(F.xxhash64("rep", "number"), F.col("blocks")).cast("int")
    cells = spots.withColumn("own", block).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "number", "code", F.least("own", "at").alias("i"), F.greatest("own", "at").alias("j"),
        (F.col("own") > F.col("at")).cast("int").alias("side"), "rep",
    )
    cells = settle(cells)
    full = (
        cells.join(coded.join(classes.select("rep", "weight"), "rep"), "rep")
        .select("number", "code", "i", "j", "side", "rep", "weight", "unit", "codes")
    )
    parts = max(1, -(-cells.count() // TASK_ROWS))
    compared = settle(
        full.repartition(parts, "number", "code", "i", "j").sortWithinPartitions("number", "code", "i", "j")
        .mapInArrow(_compared, "rep long, links long, root long")
    )
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = (
        classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("id"), "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("root", "rep").alias("component"))
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return slim.join(known, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )

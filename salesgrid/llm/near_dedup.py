"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its distinct runs of five words (lower-case A-Z, words between white
space). One permutation fills `BANDS * ROWS` bins with the smallest hash of each; an empty bin
borrows from a filled one found by its own probe sequence (optimal densification). `ROWS` bins
make a band, equal bands share a bucket. In a bucket all members are paired with its smallest
id only (a star); the links are confirmed on full sets. Buckets whose members are still in different
components get HUBS more stars, around the member that shares the most buckets with others and
around some chosen by hash. What is left apart is then compared exactly, by prefix filtering:
similar sets share one of their rarest quarter of shingles. So no component depends on the star, and what
many documents share, a passage or the body of a much copied text, pairs nobody.
At a similarity of 0.75 a pair shares no bucket with probability (1 - 0.75**5)**40 = 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesgrid.llm import textbytes as tb
from salesgrid.llm.common import components, settle

SHINGLE = 5
BANDS, ROWS = 40, 5
PERCENT = 75
HUBS = 5  # further stars of a bucket


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingles of every text as (text, hash), and one hash of each text's words."""
    doc, start, end = tb.words(data, offsets)
    word = tb.Rolling(data).of(start, end)
    count = len(offsets) - 1
    first = tb.starts_of(doc, count)
    number = np.diff(first)
    place = np.arange(len(doc)) - first[doc]
    weight = np.cumprod(np.full(int(number.max(initial=0)) + 1, tb.BASE, dtype=np.uint64))
    sums = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word * weight[place], out=sums[1:])
    whole = tb.mix(sums[first[1:]] - sums[first[:-1]] + number.astype(np.uint64))
    long_doc, long_hash = tb.word_grams(word, doc, SHINGLE)
    short = np.flatnonzero((number > 0) & (number < SHINGLE))
    got_doc, got_hash = tb.distinct(
        np.concatenate([long_doc, short]), np.concatenate([long_hash, whole[short]])
    )
    return got_doc, got_hash, whole


def probe_order(bins: int) -> np.ndarray:
    """For every bin an order of all bins in which it looks for a filled one."""
    key = tb.mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77)).reshape(bins, bins)
    return np.argsort(key, axis=1).astype(np.int32)


def band_keys(
    doc: np.ndarray, hashes: np.ndarray, count: int, bands: int, rows: int, probes: np.ndarray
) -> np.ndarray:
    """The bucket of every band of every text, count x bands. Texts without shingles hold junk."""
    top, size = np.uint64(0xFFFFFFFFFFFFFFFF), bands * rows
    value = tb.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = doc * size + (value % np.uint64(size)).astype(np.int64)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.ones(len(cell), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    bins = np.full(count * size, top, dtype=np.uint64)
    bins[cell[first]] = value[first]
    bins = bins.reshape(count, size)
    filled = bins != top
    row, at = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = bins.copy()
    for step in range(size):
        if not len(row):
            break
        source = probes[at, step]
        hit = filled[row, source]
        out[row[hit], at[hit]] = bins[row[hit], source[hit]]
        row, at = row[~hit], at[~hit]
    total = np.zeros((count, bands), dtype=np.uint64)
    for k in range(rows):
        total = total * tb.BASE + out[:, k::rows]
    return tb.mix(total + np.arange(bands, dtype=np.uint64) * tb.BASE)


_DIGEST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SETS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    probes = probe_order(BANDS * ROWS)
    for batch in batches:
        for row, data, offsets in tb.chunks(batch.column(1)):
            count = len(offsets) - 1
            doc, hashes, whole = shingles(data, offsets)
            number = np.diff(tb.starts_of(doc, count))
            keys = band_keys(doc, hashes, count, BANDS, ROWS, probes)
            has = number > 0
            ends = np.concatenate([[0], np.cumsum(has * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, count),
                    pa.array(number.astype(np.int64)),
                    pa.array(whole.view(np.int64)),
                    tb.long_lists(keys[has].reshape(-1), ends),
                ],
                names=_DIGEST.names,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in tb.chunks(batch.column(1)):
            count = len(offsets) - 1
            doc, hashes, _ = shingles(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, count), tb.long_lists(hashes, tb.starts_of(doc, count))],
                names=_SETS.names,
            )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = np.zeros(len(batch), dtype=bool)
        for i in range(len(batch)):
            a, b = (x[i].values.to_numpy(zero_copy_only=False) for x in (left, right))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        .mapInArrow(_confirmed, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id and kept.

    Rows without words or text (n_shingles 0) are linked with nothing, repeated rows and equal
    texts share a component, a row without id is alone (component null) and kept. Other columns
    are not read. Equal word sequences are grouped first, and only one of each goes on, so
    thousands of copies cost one set.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digest = settle(slim.mapInArrow(_digests, _DIGEST))
    usable = digest.where("id is not null and n_shingles > 0")
    reps = settle(
        usable.groupBy("words", "n_shingles")
        .agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    )
    rows = settle(reps.select("rep", "n_shingles", F.explode("bands").alias("bucket")))
    stars = (
        rows.groupBy("bucket")
        .agg(F.min(F.struct("rep", "n_shingles")).alias("hub"), F.count("*").alias("members"))
        .where("members > 1")
    )
    members = settle(
        rows.join(stars, "bucket")
        .select("bucket", "rep", "n_shingles", F.col("hub.rep").alias("hub"),
                F.col("hub.n_shingles").alias("hub_n"))
    )
    pairs = settle(
        members.where("rep <> hub").where(_sizes_fit("n_shingles", "hub_n"))
        .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    )
    paired = members.select("rep").distinct()
    texts = slim.join(paired, slim.id == paired.rep, "left_semi")
    sets = settle(texts.mapInArrow(_sets, _SETS).dropDuplicates(["id"]))
    links = settle(_linked(pairs, sets))
    roots = settle(components(links))

    # a hub at the rim of its group leaves much apart that other hubs bring together
    open_ = _open(members, roots)
    if open_.head(1):
        hubs = settle(_hubs(open_))
        again = settle(
            open_.join(hubs, "bucket").select("rep", "n_shingles", "root", F.explode("hubs").alias("hub"))
            .where("root <> hub.root").where(_sizes_fit("n_shingles", "hub.n_shingles"))
            .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
            .join(pairs, ["a", "b"], "left_anti")
        )
        links = settle(links.unionByName(_linked(again, sets)))
        pairs = pairs.unionByName(again)
        roots = settle(components(links))
        open_ = _open(members, roots)

    # what the stars left apart: pairs of one bucket in different components
    apart = open_.select("rep", "n_shingles", "root").distinct()
    rest = settle(apart.join(sets, apart.rep == sets.id).select("rep", "n_shingles", "root", F.explode("grams").alias("gram")))
    rare = rest.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # a set's shingles from the rarest on, at most as many as a similar set may lack, and one
    spare = F.expr(f"n_shingles - ceil({PERCENT} * n_shingles / 100)").cast("int")
    prefixes = settle(
        rest.join(rare, "gram", "left").groupBy("rep", "n_shingles", "root")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "gram"))).alias("order"))
        .select("rep", "n_shingles", "root", F.posexplode(F.slice("order", F.lit(1), spare + 1)).alias("at", "key"))
        .where("key.n > 1").select("rep", "n_shingles", "root", "at", F.col("key.gram").alias("gram"))
    )
    one, two = prefixes.alias("p"), prefixes.alias("q")
    # what can still be shared from the first common shingle on
    reach = F.expr(
        f"(100 + {PERCENT}) * least(p.n_shingles - p.at, q.n_shingles - q.at)"
        f" >= {PERCENT} * (p.n_shingles + q.n_shingles)"
    )
    cross = (
        one.join(two, "gram").where("p.rep < q.rep and p.root <> q.root")
        .where(_sizes_fit("p.n_shingles", "q.n_shingles")).where(reach)
        .select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    more = settle(_linked(settle(cross), sets))
    if more.head(1):
        roots = components(links.unionByName(more))
    classes = reps.join(roots, reps.rep == roots.id, "left").select(
        "words", "n_shingles", F.coalesce("root", "rep").alias("component")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return digest.join(classes, ["words", "n_shingles"], "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (bucket, rep, n_shingles, root) of buckets whose members are in different components."""
    placed = settle(
        members.join(roots, members.rep == roots.id, "left")
        .select("bucket", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    )
    apart = (
        placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high").select("bucket")
    )
    return settle(placed.join(apart, "bucket"))


def _hubs(open_: DataFrame) -> DataFrame:
    """bucket and hubs: the member with the most fellows in all its buckets, and some by hash."""
    size = open_.groupBy("bucket").agg(F.count("*").alias("n"))
    fellows = open_.join(size, "bucket").groupBy("rep").agg(F.sum("n").alias("fellows"))
    who = F.struct("rep", "n_shingles", "root")
    chosen = [F.max(F.struct("fellows", -F.col("rep"), who.alias("who")))["who"]]
    chosen += [F.min(F.struct(F.xxhash64("rep", F.lit(k)), who.alias("who")))["who"] for k in range(1, HUBS)]
    return (
        open_.join(settle(fellows), "rep").groupBy("bucket")
        .agg(F.array_distinct(F.array(*chosen)).alias("hubs"))
    )


def _sizes_fit(a: str, b: str):
    """Sets so different in size cannot be similar enough."""
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")

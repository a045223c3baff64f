"""Null ids, clashing columns, mixed lengths and long texts through the operators."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesgrid.llm import language, licenses, quality, toxicity, vector_dedup
from salesgrid.llm import textbytes as tb

FOLDER = "/root/testdata/sf0.01"


def test_license_scan_keeps_rows_without_id(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(None, None, None, "x"), (None, notice, "s", "y"), (-5, "", "s", "z"), (70, notice, None, "z"), (70, notice, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    got = licenses.scan_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["-5", "70", "70", "None", "None"]
    assert licenses.scan_documents(docs.where("false")).collect() == []


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_scores_do_not_care_for_other_columns(spark, operator):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    more = docs.withColumns({c: F.lit(f"other {c}") for c in ("y", "h", "mark_id", "fold", "score", "x", "k0")})
    want = {r["doc_id"]: r["score"] for r in operator.score_documents(docs, labels).collect()}
    got = {r["doc_id"]: r["score"] for r in operator.score_documents(more, labels.withColumn("h", F.lit(1))).collect()}
    assert got == pytest.approx(want)
    assert operator.score_documents(more.where("false"), labels).collect() == []


def test_near_vectors_of_mixed_lengths_by_row(spark):
    rng = np.random.default_rng(3)
    rows, centres = [], {n: rng.normal(size=(6, n)) for n in (3, 8, 16)}
    for i in range(240):
        n = (3, 8, 16)[i % 3]
        rows.append((i, (centres[n][i % 6] + rng.normal(0, 0.02, n)).tolist()))
    rows += [(900, None), (901, [0.0, 0.0]), (902, [float("nan")] * 3), (None, [1.0, 2.0, 3.0]), (7, rows[7][1])]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:240]}
    near = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    root = {}
    for i in sorted(unit):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += near[j]
    twice = {7}
    for r in got:
        i = r["vec_id"]
        if i in unit:
            others = len(near[i]) + len(near[i] & twice) + (i in twice)
            assert (r["n_links"], r["component_id"], r["kept"]) == (others, root[i], root[i] == i)
        else:
            assert r["n_links"] == 0 and r["component_id"] == i and r["kept"]
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_hashes_of_ranges_equal_plain_sums():
    data = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    rolling = tb.Rolling(data, lower=False)
    for a, b in ((0, 1), (0, 20_000), (4095, 4097), (8191, 16_385), (19_999, 20_000)):
        total = sum(int(tb.VALUE[x]) * pow(int(tb.BASE), k, 1 << 64) for k, x in enumerate(data[a:b])) + b - a
        want = tb.mix(np.array([total % (1 << 64)], dtype=np.uint64))[0]
        assert rolling.of(np.array([a]), np.array([b]))[0] == want


def test_long_text_in_pieces_counts_like_the_whole(monkeypatch):
    text = "".join(itertools.chain.from_iterable(("das Wörtchen ", "the word ", "été 123  ") for _ in range(3000))).encode()
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    hashes = [np.unique(language.grams(*(np.frombuffer(x, np.uint8), np.array([0, len(x)])))[1]) for x in (b"das Wort", b"the word")]
    filters = language.Filters(dict(zip(("de", "en"), hashes, strict=True)))
    whole = filters.rates(data, offsets)
    for size in (5, 64, 1000, 10_007):
        monkeypatch.setattr(tb, "CHUNK_BYTES", size)
        assert np.allclose(filters.rates(data, offsets), whole, atol=0, rtol=0)


def test_held_out_toxic_texts_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and fold(r["doc_id"]) == 0 and r["doc_id"] in got}
    hits = sum(got[i] for i, y in marked.items() if y)
    print("held out:", hits, sum(marked.values()), sum(got[i] for i in marked))
    assert hits >= 0.85 * sum(marked.values()) and hits >= 0.9 * sum(got[i] for i in marked)


def test_windows_overlap_by_half_at_least():
    for n in range(1, 200):
        data = np.frombuffer(b"w " * n, dtype=np.uint8)
        words = toxicity.Words(data, np.array([0, len(data)]))
        _, start, length = words.windows()
        assert start[0] == 0 and start[-1] + length[-1] == n
        for at in range(n - toxicity.WINDOW // 2 + 1):  # each run of half a window lies whole in one
            end = at + min(n, toxicity.WINDOW // 2)
            assert any(s <= at and end <= s + k for s, k in zip(start, length, strict=True))


def test_empty_arrow_column_has_no_chunks():
    assert list(tb.chunks(pa.array([], pa.string()))) == []

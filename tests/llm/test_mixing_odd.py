"""The mix with repeated and missing ids meets its targets and its SQL."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pytest

import check
from salesgrid.llm import mixing

SCHEMA = "doc_id long, text string, source string, src string, size string, h string, target double, copies int, id string"


def rows_of(kind):
    text = lambda i: " ".join(["w"] * (1 + i * 7 % 5))
    ids = {"null": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 3, "own": lambda i: i}[kind]
    rows = [(ids(i), text(i), "a") for i in range(200)] + [(1000 + i, text(i), "b") for i in range(400)]
    rows += [(2000 + i, None if i % 2 else "", "c") for i in range(4)] + [(3000, "x y", None), (None, None, None)]
    return [(*r, "s", "z", "h", 1.0, 2, "i") for r in rows]


@pytest.mark.parametrize("kind", ["null", "one", "few", "own"])
def test_targets_are_met_whatever_the_ids(spark, kind):
    rows = rows_of(kind)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    for source in {r["target"] for r in got}:
        mine = [r for r in got if r["target"] == source]
        assert sum(r["taken"] for r in mine) == pytest.approx(source, abs=5)
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in mine)
    con = duckdb.connect()
    con.register("t", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM t")
    problem, _ = check.compare(mixing.mix_documents(docs), con, mixing.ORACLE)
    assert problem is None
    assert sorted(map(str, mixing.mix_documents(docs.repartition(2)).collect())) == sorted(map(str, got))
    taken = {}
    for r in mixing.mixed(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    want = {}
    for r, (_, _, source, *_) in zip(sorted(got, key=str), sorted(rows, key=str), strict=True):
        want[r["target"]] = want.get(r["target"], 0) + r["taken"]
    assert sorted(v for v in taken.values() if v) == sorted(v for v in want.values() if v)


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []

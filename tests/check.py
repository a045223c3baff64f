"""Run the registered queries against their SQL in DuckDB.

    python tests/check.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def cell(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql):
    """None if both results hold the same rows, else a description of the difference."""
    cols = spark_df.columns
    got = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = rows_of(names, res.fetchall())
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} / {sorted(names)}", len(got)
    kinds = dict(spark_df.dtypes)
    loose = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",)}
    for c in cols:
        if kinds[c] in loose and types[c] not in loose[kinds[c]] + ("NUMBER",):
            return f"type of {c}: {kinds[c]} / {types[c]}", len(got)
    if got == want:
        return None, len(got)
    a, b = set(got), set(want)
    some = [sorted(a - b)[:2], sorted(b - a)[:2]]
    return f"rows {len(got)} / {len(want)}; only in one: {len(a - b)}, {len(b - a)}: {some}", len(got)


def main(argv=None):
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    import __spark_entry__ as entry
    from salesgrid.session import build_session

    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "local[8]", **{"spark_ui_enabled": "false", "spark_sql_shuffle_partitions": 8,
                       "spark_driver_memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} {n} rows {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

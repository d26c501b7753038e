"""Run queries and their SQL side by side on one folder of tables.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    names = [columns[i].lower() for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both sides agree, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got_names else "no columns"
    rel = con.execute(sql)
    names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if names != got_names:
        return f"columns {got_names} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"\n   got {str(a)[:600]}\n  want {str(b)[:600]}"
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    from conftest import session

    from pairloom.oracles import ORACLES
    from pairloom.queries import QUERIES

    spark = session()
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception:
            problem = traceback.format_exc()[:1500]
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print("missing SQL:", sorted(set(QUERIES) - set(ORACLES)), "unused SQL:", sorted(set(ORACLES) - set(QUERIES)))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

"""Compares every registered query with its SQL at one scale.

    python tests/check_oracles.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = _normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want = _normal(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return len(got), f"{len(got)} rows, expected {len(want)}; extra {extra} missing {lost}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return len(got), f"\n  got  {a!r}\n  want {b!r}"
    return len(got), None


def main() -> int:
    from docloom.plans.oracles import ORACLES
    from docloom.plans.queries import QUERIES
    from docloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        begun = time.time()
        if name not in ORACLES:
            print(f"---  {name}: rows only, {QUERIES[name](spark, folder).count()}", flush=True)
            continue
        try:
            rows, problem = compare(spark, con, folder, QUERIES[name], ORACLES[name])
        except Exception as error:
            rows, problem = -1, str(error)[:1500]
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name}: {rows} rows, {time.time() - begun:.2f}s {(problem or '')[:1500]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())

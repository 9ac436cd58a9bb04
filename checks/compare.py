"""Compare registered queries with their DuckDB statements, value by value.

    python -m checks.compare [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def expected(con, statement: str):
    cur = con.execute(statement)
    return [d[0] for d in cur.description], cur.fetchall()


def ordered(names: list[str], rows) -> list[tuple]:
    """Rows with columns by name, sorted; typed text so that 1 and 1.0 differ."""
    place = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(f"{type(r[i]).__name__}:{r[i]!r}" for i in place) for r in rows]
    return sorted(out)


def compare(spark, con, sf: str, query, statement: str | None) -> tuple[bool, str]:
    got = query(spark, sf)
    names = got.columns
    rows = [tuple(r) for r in got.collect()]
    if statement is None:
        return True, f"rows={len(rows)} (rows only)"
    want_names, want = expected(con, statement)
    if sorted(names) != sorted(want_names):
        return False, f"columns {sorted(names)} != {sorted(want_names)}"
    a, b = ordered(names, rows), ordered(want_names, want)
    if a == b:
        return True, f"rows={len(rows)}"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return False, f"rows {len(a)} / {len(b)}\n    got  {only_a}\n    want {only_b}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from checks import registry
    from trajlake.session import local_session

    spark = local_session("compare")
    con = connect(args.sf)
    bad = 0
    for name, query in registry.QUERIES.items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, con, args.sf, query, registry.ORACLE.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:22s} {time.time() - begin:6.2f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())

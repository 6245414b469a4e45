"""Run queries next to their SQL and compare: columns, row count, values in any order.

    python tests/compare.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    return str(v)


def difference(left, right) -> str | None:
    """None when equal; both are (columns, rows)."""
    (lc, lr), (rc, rr) = left, right
    if sorted(lc) != sorted(rc):
        return f"columns {sorted(lc)} != {sorted(rc)}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} != {len(rr)}"

    def normal(columns, rows):
        order = [columns.index(c) for c in sorted(columns)]
        out = [tuple(plain(r[i]) for i in order) for r in rows]
        key = lambda r: tuple(
            (v is not None, f"{v:.9e}" if isinstance(v, float) else str(v)) for v in r)
        return sorted(out, key=key)

    for a, b in zip(normal(lc, lr), normal(rc, rr)):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"first difference {a} != {b}"
    return None


def check(spark, con, sf: str, function, sql: str, may_be_empty: bool = False) -> str | None:
    df = function(spark, sf)
    left = (df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = ([d[0] for d in cur.description], cur.fetchall())
    if not right[1] and not may_be_empty:
        return "the SQL returns no rows"
    return difference(left, right)


def main() -> int:
    from lexiloom.plans import catalog
    from lexiloom.session import local_session

    sf, parts = sys.argv[1].rstrip("/"), sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    sql, bad = catalog.oracle_sql(), 0
    for name, f in catalog.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = check(spark, con, sf, f, sql[name])
            else:
                n = len(f(spark, sf).collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.1f}s {name}"
              + (f"\n       {problem}" if problem else ""), flush=True)
        bad += problem is not None
    return bad


if __name__ == "__main__":
    sys.exit(main())

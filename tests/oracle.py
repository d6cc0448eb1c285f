"""Run registered queries next to their check queries and compare whole results.

Usage: python tests/oracle.py SF_DIR [name part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tallyworks.sources.views import TABLES  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(rows, i):
    return {type(r[i]).__name__ for r in rows if r[i] is not None}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(df, con, sql: str, took: list | None = None) -> str:
    """'' when equal, else what differs."""
    cols = sorted(df.columns)
    left = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    began = time.time()
    rel = con.sql(sql)
    names = list(rel.columns)
    found = rel.fetchall()
    if took is not None:
        took.append(time.time() - began)
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = [tuple(plain(r[i]) for i in order) for r in found]
    key = lambda r: tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "", str(x) if not isinstance(x, (int, float)) else x) for x in r)  # noqa: E731, E501
    left.sort(key=key)
    right.sort(key=key)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for i, c in enumerate(cols):
        a, b = kind(left, i), kind(right, i)
        if a != b:
            return f"types of {c}: {a} != {b}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(cols, *bad[0]) if x != y]
        return f"{len(bad)} of {len(left)} rows differ, first: {diff[:4]}"
    return "" if left else "both empty"


def main() -> None:
    from tallyworks.plans import ORACLES, QUERIES
    from tallyworks.session import local_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), connect(folder)
    names = [n for n in QUERIES if not parts or any(p in n for p in parts)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, folder)
            if n in ORACLES:
                msg = compare(df, con, ORACLES[n], took := [])
                t0 += took[0]  # show Spark's time only
            else:
                msg = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok = msg == "" or msg.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()

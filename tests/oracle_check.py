"""Compare catalogue queries with their SQL on the given tables.

    python tests/oracle_check.py <folder of tables> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from parcelscope.plans.catalog import QUERIES  # noqa: E402
from parcelscope.plans.oracle import ORACLE  # noqa: E402


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(value):
    if isinstance(value, bool):
        return ("b", value)
    if value is None:
        return ("", "")
    if isinstance(value, float):
        return ("f", repr(value + 0.0) if not math.isnan(value) else "nan")
    if isinstance(value, int):
        return ("i", str(value))
    return ("s", str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine == theirs:
        return None if mine else "no rows"
    a, b = set(mine), set(theirs)
    left, right = sorted(a - b)[:2], sorted(b - a)[:2]
    return f"rows {len(mine)} vs {len(theirs)}; differ {len(a - b)}\n   spark {left}\n   sql   {right}\n   {sorted(names)}"


if __name__ == "__main__":
    from parcelscope.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    session, duck = local_session("8"), connection(folder)
    bad = []
    for query in only or list(QUERIES):
        began = time.time()
        if query not in ORACLE:
            print(f"{query:24s} no SQL", flush=True)
            continue
        try:
            problem = compare(session, duck, folder, query)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{query:24s} {'ok' if problem is None else 'DIFF ' + problem} {time.time() - began:.1f}s", flush=True)
        if problem:
            bad.append(query)
    print("failed:", bad)

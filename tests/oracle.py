"""Compare registered queries with their SQL oracle, strictly: names, types, values.

Command line: python tests/oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_result(df):
    order = sorted(df.columns)
    kinds = dict(df.dtypes)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    return order, [TYPES.get(kinds[c], kinds[c]) for c in order], rows


def duck_result(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = [str(d[1]) for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in con.fetchall()]
    return [names[i] for i in order], [kinds[i] for i in order], rows


def compare(spark, con, sf_dir, key, queries, oracles, empty_ok=False) -> str | None:
    """None when equal, else what differs."""
    names, kinds, rows = spark_result(queries[key](spark, sf_dir))
    if key not in oracles:
        return None if rows or empty_ok else "no rows"
    names2, kinds2, rows2 = duck_result(con, oracles[key])
    if names != names2:
        return f"columns {names} vs {names2}"
    if kinds != kinds2:
        return f"types {list(zip(names, kinds, kinds2))}"
    a, b = Counter(map(repr, rows)), Counter(map(repr, rows2))
    if a != b:
        only_a, only_b = a - b, b - a
        return (f"rows {len(rows)} vs {len(rows2)}; columns {names}\n  spark only "
                f"({sum(only_a.values())}): {sorted(only_a)[:3]}\n  sql only "
                f"({sum(only_b.values())}): {sorted(only_b)[:3]}")
    if not rows and not empty_ok:
        return "no rows"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_spark

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = make_spark()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not args or any(k.startswith(a) for a in args)]
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, key, queries, oracles)
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        if problem:
            bad += 1
        print(f"{'BAD' if problem else 'ok '} {key} {took:.2f}s"
              f"{'' if key in oracles else ' (rows only)'}{'  ' + problem if problem else ''}",
              flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())

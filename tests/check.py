"""Compare queries with their SQL twins: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
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


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows), sorted(names)


def compare(spark, con, sf_dir: str, fn, sql: str):
    """None when both sides agree, else a text that says how they differ."""
    df = fn(spark, sf_dir)
    got, got_names = normal([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    want, want_names = normal(result.fetchall(), want_names)
    kinds = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    numbers = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    for name, kind in df.dtypes:
        if kinds[name] not in numbers.get(kind, ()):
            return f"type of {name}: {kind} / {kinds[name]} ({len(got)} rows agree)"
    if not got:
        return "both sides are empty"
    return None


def main() -> int:
    from tidemark.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracles[name]) if name in oracles else "no SQL twin"
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

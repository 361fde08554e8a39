"""Compare named queries with their DuckDB statements.

usage: python tools/check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dotloom.plans import catalog  # noqa: E402
from dotloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        files = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}{'/*.parquet' if Path(files).is_dir() else ''}'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v):
        return repr(float(v))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(norm(r[i])) for i in order) for r in rows)


def compare(spark, con, name, sf_dir) -> str:
    return compare_sql(spark, con, name, catalog.queries[name], catalog.oracles.get(name), sf_dir)


def compare_sql(spark, con, name, query, sql, sf_dir) -> str:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name} rows={len(got)} {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    head = f"{name} rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return f"FAIL  {head} columns {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return f"OK    {head}"
    a, b = set(got), set(want)
    only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
    return f"FAIL  {head} duck_rows={len(want)} diff={len(a - b)}/{len(b - a)}\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in catalog.queries if not args or any(a in n for a in args)]
    spark, con = local_session("check"), duck(sf_dir)
    failed = 0
    for n in names:
        try:
            line = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            line = f"FAIL  {n} {type(e).__name__}: {str(e)[:900]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries on Spark and DuckDB and compare them row by row."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return int(r) if r == int(r) else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


TIMES = {}


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    TIMES["build"] = time.time() - start
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if not mine[1]:
        return "no rows"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ, {mine[0]}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from docweir.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        sf_dir = f"/root/testdata/{args.pop(0)}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed, n = [], 0
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        n += 1
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, query, sqls[name])
            else:
                df = query(spark, sf_dir)
                got = df.collect()
                problem = None if got else "no rows"
        except Exception as exc:  # noqa: BLE001 - report and continue
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - start
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s (spark {TIMES.get('spark', 0):.1f}, of it build {TIMES.get('build', 0):.1f})"
              f"{'' if name in sqls else ' (rows only)'}{' ' + problem if problem else ''}", flush=True)
    print(f"{n - len(failed)}/{n} ok; failed: {failed}")


if __name__ == "__main__":
    main()

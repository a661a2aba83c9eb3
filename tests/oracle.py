"""Compare registered queries with their SQL on the given tables: ``python -m tests.oracle [--task-rows=n] [sf] [names...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("n",) if math.isnan(v) else ("f", repr(v + 0.0))
    if v is None:
        return ("z",)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dict):
        return ("d", tuple(sorted((str(k), norm(x)) for k, x in v.items())))
    return (type(v).__name__, str(v))


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    idx = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in idx], sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tessera.session import local_session

    task_rows = None
    if argv and argv[0].startswith("--task-rows="):
        task_rows = argv[0].split("=")[1]
        argv = argv[1:]
    sf = argv[0] if argv else "0.01"
    q, o = queries(), oracle_sql()
    names = [n for n in q if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if task_rows:
        spark.conf.set("tessera.task.rows", task_rows)
    d = f"/root/testdata/sf{sf}"
    con = connect(d)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            a = spark_rows(q[n](spark, d))
            t1 = time.time() - t0
            if n not in o:
                print(f"ROWS {n} {len(a[1])} {t1:.1f}s", flush=True)
                if not a[1]:
                    print("   EMPTY")
                continue
            b = sql_rows(con, o[n])
            if a == b and a[1]:
                print(f"ok   {n} {len(a[1])} {t1:.1f}s", flush=True)
                continue
            bad += 1
            print(f"DIFF {n} cols {a[0] == b[0]} rows {len(a[1])} vs {len(b[1])} {t1:.1f}s")
            if a[0] != b[0]:
                print("   ", a[0], b[0])
            sa, sb = set(a[1]), set(b[1])
            for r in sorted(sa - sb)[:3]:
                print("   spark", r)
            for r in sorted(sb - sa)[:3]:
                print("   sql  ", r)
        except Exception as e:
            bad += 1
            print(f"FAIL {n} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])

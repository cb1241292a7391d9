"""Compare registered queries with their SQL text: python check_oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from covermetrics.plans.registry import Book, all_plans
from covermetrics.session import build_session
from covermetrics.sources.book import BASE_TABLES


def canonical(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, folder, names=()):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, p in all_plans().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = p.build(Book(spark, folder))
            got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR   {name}: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if p.sql is None:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.2f}s", flush=True)
            continue
        try:
            rel = con.execute(p.sql)
            ecols = [d[0] for d in rel.description]
            want, ecols = rows_of(ecols, rel.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQLERR {name}: {str(e)[:1500]}", flush=True)
            continue
        if gcols != ecols or got != want:
            bad.append(name)
            gs, ws = set(got), set(want)
            print(f"DIFF  {name}: cols {gcols if gcols != ecols else 'same'} vs {ecols}; rows {len(got)} vs {len(want)}\n"
                  f"   spark only {sorted(gs - ws)[:3]}\n   sql only   {sorted(ws - gs)[:3]}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows {t1 - t0:.2f}s sql {time.time() - t1:.2f}s", flush=True)
    print(f"{len(bad)} bad: {bad}")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(1 if compare(session, folder, args) else 0)

"""Compare suite queries with their SQL twins in DuckDB: ``python -m tests.oracle [folder] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, run, sql: str, folder: str) -> str | None:
    df = run(spark, folder)
    got = rows(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {str(a)[:300]} against {str(b)[:300]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from semtab.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8, int(os.environ.get("PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, run, sqls[name], folder)
            else:
                problem = None if run(spark, folder).count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name:28s} {time.time() - began:6.2f}s {'' if name in sqls else '(rows only) '}{problem or ''}",
              flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()

"""Run named queries on Spark and their SQL counterparts on DuckDB and compare all rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
)


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(df, con, statement):
    """None when equal, else a short description of the difference."""
    got_columns, got = table(df.columns, df.collect())
    cur = con.execute(statement)
    want_columns, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} <> {want_columns}"
    if got != want:
        extra, lacking = got - want, want - got
        return f"rows {sum(got.values())} <> {sum(want.values())}; only Spark {list(extra)[:3]}; only SQL {list(lacking)[:3]}"
    return None


def main(folder="/root/testdata/sf0.01", *names):
    import __spark_entry__ as entry

    from wonted.session import local_session

    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                message = compare(df, con, oracles[name])
            else:
                message = f"no SQL, {df.count()} rows"
        except Exception as e:  # report and go on
            message = f"{type(e).__name__}: {str(e)[:600]}"
        bad += message is not None
        print(f"{name:26} {time.time() - t:6.1f}s  {message or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))

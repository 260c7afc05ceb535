"""Run registered queries next to their DuckDB statements and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    rows = [tuple(r) for r in spark_df.collect()]
    left = canonical(spark_df.columns, rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = canonical(names, cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(rows)
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}", len(rows)
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first:\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", len(rows)
    return None, len(rows)


def main(argv):
    import __spark_entry__ as entry
    from orderloom.session import local_session

    folder = argv[0]
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracle:
                note, n = compare(df, con, oracle[name])
            else:
                note, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001
            note, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        failed += note is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if note is None else 'FAIL'} {kind} {name:<34} n={n:<7} {time.time() - t:6.2f}s {note or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1:])

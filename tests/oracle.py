"""Compare registered queries with their oracle SQL: python tests/oracle.py [pattern] [sf]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return ("decimal", value.normalize())
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, root, fn, sql):
    df = fn(spark, root)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(mine)} rows, no oracle"
    cur = con.execute(sql)
    theirs_names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != theirs_names:
        return False, f"columns {names} != {theirs_names}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    kinds = [(n, type(a).__name__, type(b).__name__) for r, s in zip(mine[:200], theirs[:200])
             for n, a, b in zip(names, r, s) if type(a) is not type(b) and a is not None and b is not None]
    if kinds:
        return False, f"types {sorted(set(kinds))[:5]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g.\n   {names}\n   mine   {str(bad[0][0])[:600]}\n   oracle {str(bad[0][1])[:600]}"
    return True, f"{len(mine)} rows"


def main():
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "0.01"
    root = f"/root/testdata/sf{sf}"
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(root), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, root, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

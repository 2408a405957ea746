"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.10g}"))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(f"{float(v):.10g}"))
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return Counter(tuple(canon(r[i]) for i in order) for r in rows), sorted(n.lower() for n in names)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got, got_names = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return sum(got.values()) > 0, took, f"{sum(got.values())} rows, no sql"
    cur = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    ok = got == want and got_names == want_names
    note = f"{sum(got.values())} rows"
    if not ok:
        note += f" vs {sum(want.values())}; names {got_names} {want_names if got_names != want_names else ''}"
        note += f"\n   only spark: {list((got - want).items())[:3]}\n   only sql:   {list((want - got).items())[:3]}"
    return ok, took, note


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, took, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, took, note = False, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    print("failures:", bad)

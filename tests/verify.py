"""Compares every query with its SQL at one scale: ``python tests/verify.py [folder] [name ...]``."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as e  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def main(args):
    d = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    q, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in args[1:] or q:
        t = time.time()
        try:
            df = q[name](spark, d)
            cols = sorted(df.columns)
            rows = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
            took = time.time() - t
            if name not in sql:
                print(f"{name}: rows only, {len(rows)} rows, {took:.1f} s")
                continue
            r = con.sql(sql[name])
            names = sorted(r.columns)
            want = sorted((tuple(plain(v) for v in x) for x in con.sql(f"select {','.join(chr(34) + c + chr(34) for c in names)} from ({sql[name]})").fetchall()), key=repr)
            ok = cols == names and rows == want
            bad += not ok
            print(f"{name}: {'ok' if ok else 'DIFFERS'}, {len(rows)} rows, {took:.1f} s")
            if not ok:
                print("   ", cols, names, len(rows), len(want), [x for x in rows if x not in set(want)][:2], [x for x in want if x not in set(rows)][:2])
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(x).__name__} {str(x)[:600]}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Compare catalogue queries with their SQL checks: python tests/check_catalog.py [sf] [name ...]"""
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def norm(rows):
    out = []
    for r in rows:
        out.append(tuple(v + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


def compare(spark, con, sf, name):
    t0 = time.time()
    df = e.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    dt = time.time() - t0
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"{name}: rows={len(got)} (no sql) {dt:.1f}s"
    rel = con.sql(sql)
    ocols = sorted(rel.columns)
    if ocols != cols:
        return f"FAIL {name}: columns {cols} vs {ocols}"
    idx = [rel.columns.index(c) for c in ocols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    types = dict(zip(rel.columns, map(str, rel.types)))
    a, b = norm(got), norm(want)
    if a == b:
        return f"ok {name}: rows={len(a)} {dt:.1f}s {'EMPTY' if not a else ''}"
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"FAIL {name}: {len(a)} vs {len(b)} {bad} {df.dtypes} {types}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark = session()
    con = duckdb.connect()
    for tb in TABLES:
        con.sql(f"create view {tb} as select * from '{path}/{tb}.parquet'")
    for name in sys.argv[2:] or list(e.queries()):
        try:
            print(compare(spark, con, path, name), flush=True)
        except Exception as ex:
            print("ERROR", name, str(ex)[:600].replace("\n", " | "), flush=True)

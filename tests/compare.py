"""Run queries side by side with their SQL: python tests/compare.py <sf_dir> [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got, want):
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            ok = (x.astype(float) == y.astype(float)) | (x.isna() & y.isna())
        else:
            ok = (x.astype(str) == y.astype(str)) | (x.isna() & y.isna())
        if not ok.all():
            i = ok.idxmin()
            bad.append(f"{c}: {(~ok).sum()} differ, first {x[i]!r} != {y[i]!r}")
    return "; ".join(bad)


def type_differences(sdf, rel):
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    duck = dict(zip(rel.columns, map(str, rel.types)))
    return "; ".join(f"{c}: {t} vs {duck.get(c)}" for c, t in sdf.dtypes if same.get(t, t) != duck.get(c))


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    fails = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            got = sdf.toPandas()
            spent = time.time() - t0
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"  --  {name:26s} {len(got):8d} rows {spent:6.2f}s (no SQL)", flush=True)
                continue
            t1 = time.time()
            rel = con.sql(sql)
            diff = differences(got, rel.df())
            types = type_differences(sdf, rel)
            fails += bool(diff)
            print(f"{'FAIL' if diff else '  ok'}  {name:26s} {len(got):8d} rows {spent:6.2f}s sql {time.time() - t1:6.2f}s {diff} {'types: ' + types if types else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            fails += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{fails} failures")


if __name__ == "__main__":
    main()

"""Runs queries beside their SQL: python tests/compare.py SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings chrom_sizes pairs bed contact_map pairs_raw eval_items".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(pdf: pd.DataFrame):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if isinstance(x, list):
            return tuple(one(y) for y in x)
        if isinstance(x, bool):
            return x
        if isinstance(x, (int, float)):
            return float(f"{float(x):.10g}") + 0.0
        return str(x)

    cols = sorted(pdf.columns)
    rows = [tuple(one(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def main():
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, f in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            cols, got = canon(f(spark, sf_dir).toPandas())
        except Exception as e:
            print(name, "ERROR", str(e)[:1500], flush=True)
            bad.append(name)
            continue
        took = time.time() - t
        if name not in sql:
            print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL", flush=True)
            continue
        try:
            cols2, want = canon(con.sql(sql[name]).df())
        except Exception as e:
            print(name, "SQL ERROR", str(e)[:1500], flush=True)
            bad.append(name)
            continue
        ok = cols == cols2 and got == want
        print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)} rows, {took:.1f} s", flush=True)
        if not ok:
            bad.append(name)
            a, b = set(got), set(want)
            print("  columns", cols, cols2, "\n  only Spark", sorted(a - b, key=repr)[:4], "\n  only SQL", sorted(b - a, key=repr)[:4], len(a - b), len(b - a), len(want))
    print("BAD", bad)


if __name__ == "__main__":
    main()

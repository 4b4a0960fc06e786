"""Runs every query beside its SQL: python tests/oracle.py FOLDER [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal as sets of rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    cols = sorted(got.columns)
    norm = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr)
    a, b = norm(got), norm(want)
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            got = f(spark, folder).toPandas()
            took = time.time() - t
            said = (same(got, con.execute(sql[name]).df()) or "same") if name in sql else "no SQL"
            print(f"{name}: {len(got)} rows, {took:.1f} s, {said}", flush=True)
        except Exception as e:  # a report of all queries goes on
            print(f"{name}: FAILED {str(e)[:300]}", flush=True)

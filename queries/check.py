"""Run queries against their SQL: python -m queries.check [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

import queries.catalogue  # noqa: F401
from queries.registry import QUERIES, SQL
from queries.views import TABLES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, db, sf_dir: str, name: str) -> str:
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        return f"rows={len(got)} (no SQL)"
    want = db.execute(SQL[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}"
    a, b = normal(got), normal(want)
    if a == b:
        return f"ok rows={len(a)}"
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"DIFF spark={len(a)} sql={len(b)}\n  {sorted(got.columns)}\n  spark {sorted(only_a)[:3]}\n  sql   {sorted(only_b)[:3]}"


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, db = session(), database(sf_dir)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, db, sf_dir, name)
        except Exception as e:  # keep going, report all
            result = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

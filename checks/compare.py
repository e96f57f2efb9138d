"""Side-by-side check of the registered queries against their SQL, as the driver does it."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in rec) for rec in frame[cols].astype(object).itertuples(index=False)), key=repr)


def main(sf_dir: str, only: list[str]) -> int:
    from . import registry
    registry.load()
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failures = 0
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        begin = time.time()
        oracle = registry.ORACLES.get(name)
        try:
            got = fn(spark, sf_dir).toPandas()
            spent = time.time() - begin
            if oracle is None:
                print(f"rows  {name}: {len(got)} rows {spent:.1f}s")
                continue
            want = con.execute(oracle).df()
        except Exception as error:  # report and go on with the next query
            failures += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}")
            continue
        a, b = rows(got), rows(want)
        ok = sorted(got.columns) == sorted(want.columns) and a == b
        failures += not ok
        print(f"{'ok   ' if ok else 'FAIL '} {name}: {len(a)}/{len(b)} rows {spent:.1f}s")
        if not ok:
            print("   columns", sorted(got.columns), sorted(want.columns))
            sa, sb = set(map(repr, a)), set(map(repr, b))
            for r in [x for x in a if repr(x) not in sb][:4]:
                print("   spark ", r)
            for r in [x for x in b if repr(x) not in sa][:4]:
                print("   oracle", r)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))

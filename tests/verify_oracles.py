"""Compare queries with their DuckDB SQL: python tests/verify_oracles.py [sf_dir] [prefix ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def table_of(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    import __spark_entry__ as e

    got = e.queries()[name](spark, sf_dir).toPandas()
    sql = e.oracle_sql().get(name)
    if sql is None:
        return "" if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = table_of(got), table_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(os.environ.get("VERIFY_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in e.queries():
        if sys.argv[2:] and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, sf_dir)
        except Exception as x:  # noqa: BLE001  reported below
            why = f"{type(x).__name__}: {str(x)[:300]}"
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok'} {name} {time.time() - t:.1f}s {'' if name in e.oracle_sql() else '(rows only)'} {why}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())

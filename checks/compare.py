"""Run every query against its SQL twin: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import QUERIES

TABLES = ("lineitem", "orders", "customer", "part")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> list[str]:
    """What differs between the Spark query and its SQL; empty when they agree."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name not in ORACLES:
        return []
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if got != want:
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
        )
    return problems


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            problems = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        rows = "ok" if not problems else "DIFFERS " + "; ".join(problems)
        bad += bool(problems)
        print(f"{name:32s} {time.time() - start:6.2f}s {'' if name in ORACLES else '(no SQL) '}{rows}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

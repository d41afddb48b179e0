"""Runs queries and their SQL side by side: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = Path("/root/testdata")


def session():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def engine(sf: str):
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, sf: str, run, sql: str) -> str:
    """Empty if both give the same rows."""
    df = run(spark, str(DATA / sf))
    ours = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = ours[1] - theirs[1], theirs[1] - ours[1]
        return f"{sum(ours[1].values())} and {sum(theirs[1].values())} rows; only Spark {a.total()}: {sorted(a)[:2]}; only SQL {b.total()}: {sorted(b)[:2]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.001"), sys.argv[2:]
    spark, con, queries, oracle = session(), engine(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            if name in oracle:
                said = difference(spark, con, sf, queries[name], oracle[name]) or "same"
            else:
                said = f"rows only: {queries[name](spark, str(DATA / sf)).count()}"
        except Exception as e:
            said = "FAILED " + str(e)[:600].replace("\n", " ")
        bad += not said.startswith(("same", "rows"))
        if not said.startswith("same"):
            print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} of {len(names or queries)} differ")

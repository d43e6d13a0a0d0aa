"""python -m tests.compare FOLDER [NAME...]: runs queries, by default all, and their SQL twins over a folder of tables and prints where rows differ."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 8)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(columns, data):
    """Rows as sorted texts, columns by name, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


def views(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def main(folder, names):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", at).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = views(folder), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.perf_counter()
        df = f(spark, folder)
        got = [tuple(r) for r in df.collect()]
        seconds = round(time.perf_counter() - begin, 1)
        if name not in twins:
            print(f"rows {name} {len(got)} {seconds}")
            continue
        twin = con.sql(twins[name])
        a, b = rows(df.columns, got), rows(list(twin.columns), twin.fetchall())
        bad += a != b or sorted(df.columns) != sorted(twin.columns)
        print(f"{'ok' if a == b else 'DIFFERS'} {name} {len(a)} {len(b)} {seconds}", *sorted(set(a) ^ set(b))[:2])
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)

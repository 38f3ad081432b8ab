"""Run registered queries beside their SQL twins and compare names and values.

``python tests/compare.py [sf] [query ...]`` prints one line per query.
"""

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("lectern")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def difference(df, con, sql):
    """None when equal, else a short description of the first difference."""
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    ints = {"tinyint": "TINYINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
            "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    types = [
        f"{name} {kind}/{kinds[name]}" for name, kind in df.dtypes if ints.get(kind) != kinds[name]
    ]
    ours, theirs = _rows(df.columns, df.collect()), _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            first = [(x, y) for x, y in zip(a, b) if x != y][0]
            return f"value {first[0]!r} / {first[1]!r}"
    if not ours:
        return "no rows"
    return f"types {types}" if types else None


def main(arguments):
    from __spark_entry__ import oracle_sql, queries

    sf = arguments[0] if arguments else "0.01"
    folder = f"{DATA}/sf{sf}"
    spark, con = session(), duck(folder)
    sql = oracle_sql()
    for name, function in queries().items():
        if len(arguments) > 1 and name not in arguments[1:]:
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in sql:
                result = difference(df, con, sql[name]) or "equal"
            else:
                result = f"{df.count()} rows, no twin"
        except Exception as problem:
            result = f"FAILED {type(problem).__name__}: {str(problem)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.2f}s  {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

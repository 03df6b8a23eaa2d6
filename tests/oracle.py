"""Compare registered queries with their DuckDB SQL: columns by name, rows in any order."""

import glob
import math
import os
import sys


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def compare(spark, sf, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, sf)
    mine, a = canonical([tuple(r) for r in df.collect()], df.columns)
    got = con.sql(sql)
    theirs, b = canonical(got.fetchall(), got.columns)
    if a != b:
        return f"columns {a} {b}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, {len(theirs)} expected"
    gone, more = set(mine) - set(theirs), set(theirs) - set(mine)
    bad = [(x, y) for x, y in zip(sorted(gone, key=repr), sorted(more, key=repr), strict=False)]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:1]}" if bad else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        start = time.time()
        try:
            sql = e.oracle_sql().get(name)
            said = compare(spark, sys.argv[1], name, f, sql) if sql else f"(no SQL) {f(spark, sys.argv[1]).count()} rows"
        except Exception as x:
            said = "ERROR " + str(x)[:600]
        print(name, said or "same", round(time.time() - start, 1), flush=True)

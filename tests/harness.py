"""Runs a query in Spark and its check SQL in DuckDB, and compares the rows."""

import argparse
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spark_session(app="civicgraph-tests", cpus="*", partitions="8"):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", partitions)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


TIMES = {}


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    t0 = time.time()
    sc, sr = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    TIMES["spark"], t0 = time.time() - t0, time.time()
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    TIMES["duck"] = time.time() - t0
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        extra = [r for r in sr if r not in set(dr)][:3] if len(sr) < 50000 else ""
        return f"row counts differ: {len(sr)} vs {len(dr)}; only in spark: {extra}"
    types = lambda r: tuple(type(x).__name__ for x in r)
    for a, b in zip(sr, dr):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"rows differ:\n  spark {sc}\n  {a}\n  duck  {b}\n  {types(a)} {types(b)}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = compare(df, con, oracles[name])
                status = "OK" if diff is None else f"DIFF {diff}"
            else:
                status = f"rows-only {df.count()}"
        except Exception as e:  # report every query, not just the first failure
            diff, status = str(e), f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        if status.startswith(("DIFF", "ERROR")):
            bad.append(name)
        print(f"{name:28s} {time.time() - t0:6.2f}s (duck {TIMES.pop('duck', 0):.1f})  {status}", flush=True)
    print("FAILED:", bad if bad else "none")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()

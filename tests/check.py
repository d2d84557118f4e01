"""Run registered queries against their check SQL: python tests/check.py [sf] [name part...]"""
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


SPENT = [0.0]


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return tuple(cell(y) for y in x)
        if isinstance(x, bool):
            return x
        if isinstance(x, (int, float)):
            return round(float(x), 6) + 0.0
        return str(x)
    cols = sorted(df.columns)
    return sorted((tuple(cell(x) for x in row) for row in df[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark_df, con, sql):
    t0 = time.time()
    got = spark_df.toPandas()
    SPENT[0] = time.time() - t0
    want = con.execute(sql).df()
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if c in want.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and set(k) <= set("ifb")}
    if odd:
        print("     types differ:", odd)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got)
    a, b = normal(got), normal(want)
    if a == b:
        return None, len(a)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only got {sorted(set(a) - set(b), key=repr)[:3]} only want {sorted(set(b) - set(a), key=repr)[:3]}", len(a)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    # values that differ by rounding of the last shown digit only
    real = [(x, y) for x, y in diff if any(
        (p != q) and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1.5e-6) for p, q in zip(x, y))]
    return f"{len(diff)} rows differ ({len(real)} beyond rounding), columns {sorted(got.columns)}: {(real or diff)[:2]}", len(a)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                err, n = compare(fn(spark, folder), con, oracle[name])
            else:
                err, n = None, fn(spark, folder).count()
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {name:28s} {n:8d} rows {time.time() - t0:6.1f}s (Spark action {SPENT[0]:.1f}s)"
              f" {'' if name in oracle else '(no SQL)'} {err or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

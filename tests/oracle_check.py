"""Compare registered queries with their SQL on one data folder: python -m tests.oracle_check."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(
            lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v)
            else repr(v + 0.0) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    kinds = [(c, spark_frame[c].dtype, sql_frame[c].dtype) for c in sorted(spark_frame.columns)
             if spark_frame[c].dtype != sql_frame[c].dtype]
    a, b = normal(spark_frame), normal(sql_frame)
    if a.equals(b):
        return f"types {kinds}" if kinds else ""
    bad = (a != b).any(axis=1)
    first = bad.idxmax()
    cols = [c for c in a.columns if a.at[first, c] != b.at[first, c]]
    return (f"{int(bad.sum())} rows differ, e.g. {cols}: {a.loc[first].to_dict()} != "
            f"{b.loc[first, cols].to_dict()}")


def main() -> None:
    from basketlake.session import build_session
    from basketlake.plans.catalogue import ORACLES, QUERIES
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", extra={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = []
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            got = run(spark, folder).toPandas()
            spent = time.time() - started
            if name in ORACLES:
                started = time.time()
                problem = differences(got, con.execute(ORACLES[name]).df())
                verdict = problem or "equal"
            else:
                problem, verdict = "", "rows only"
                spent = time.time() - started
        except Exception as error:  # noqa: BLE001
            problem = verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            spent, got = time.time() - started, []
        if problem:
            failed.append(name)
        print(f"{name:36s} {spent:6.2f}s {len(got):7d} rows  {verdict}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()

"""Writers: Parquet stage tables, CSV evidence, content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(frame: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> str:
    writer = frame.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """Every table of a run under ``root``; per-customer tables are split by partition label."""
    paths = {}
    for name, frame in tables.items():
        keys = ["partition"] if "partition" in frame.columns else []
        paths[name] = write_table(frame, f"{root}/{name}", keys)
    return paths


def ten_digits(frame: DataFrame) -> DataFrame:
    """Floating columns as text with ten significant digits, the form of evidence files."""
    floating = (T.DoubleType, T.FloatType, T.DecimalType)
    return frame.select(*[
        F.format_string("%.10g", F.col(f"`{f.name}`").cast("double")).alias(f.name)
        if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")
        for f in frame.schema.fields])


def write_csv(frame: DataFrame, path: str) -> str:
    ten_digits(frame).write.mode("overwrite").option("header", True).csv(path)
    return path


def fingerprint(frame: DataFrame) -> DataFrame:
    """Order-free content hash of a table: equal for equal multisets of rows.

    Two 64-bit hashes with different seeds are each summed and xor-ed, so a pair of equal rows does
    not cancel out and a single change shows in both.
    """
    columns = [F.col(f"`{c}`") for c in frame.columns]
    first = F.xxhash64(*columns)
    second = F.xxhash64(F.lit("second"), *columns)
    return frame.select(first.alias("a"), second.alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor("a").alias("xor_hash"),
        F.sum(F.col("b").cast("decimal(38,0)")).cast("string").alias("sum_hash"))

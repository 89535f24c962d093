"""Source contract, canonical schema, and the checks that report how far a table departs from them.

Checks return rows (rule, subject, failures) computed in one pass; ``require_clean`` turns any
failure into an error, so every failed rule is reported at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake.functions.columns import trimmed_or_null

# Source column names in contract order, and their canonical names.
CANONICAL_NAMES = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}
RAW_COLUMNS = tuple(CANONICAL_NAMES)

CANONICAL_SCHEMA = T.StructType([
    T.StructField("invoice", T.StringType(), False),
    T.StructField("stock_code", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("quantity", T.LongType(), False),
    T.StructField("invoice_date", T.TimestampNTZType(), False),
    T.StructField("price", T.DecimalType(18, 4), False),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("country", T.StringType(), False),
])
CANONICAL_COLUMNS = tuple(CANONICAL_SCHEMA.fieldNames())

# Largest share of nulls accepted per column.
MAX_NULL_RATES = {
    "invoice": 0.0, "stock_code": 0.0, "description": 0.01, "quantity": 0.0,
    "invoice_date": 0.0, "price": 0.0, "customer_id": 0.30, "country": 0.0,
}


class ContractError(ValueError):
    """A table broke one or more contract rules."""


def read_part(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One source part. CSV is read as text under the contract's names; its header must match."""
    if fmt == "csv":
        text = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])
        return (spark.read.schema(text).option("header", True).option("enforceSchema", False)
                .option("escape", '"').csv(path))
    return spark.read.format(fmt).load(path)


def _whole(value: Column) -> Column:
    number = value.cast("decimal(28,6)")
    return F.when(number != F.floor(number),
                  F.raise_error(F.concat(F.lit("quantity is not a whole number: "),
                                         number.cast("string"))).cast("bigint")
                  ).otherwise(number.cast("bigint"))


def canonicalize(raw: DataFrame) -> DataFrame:
    """Contract names to canonical names, trimmed text with empty as null, typed columns."""
    def text(name: str) -> Column:
        return trimmed_or_null(F.col(f"`{name}`").cast("string")).alias(CANONICAL_NAMES[name])

    return raw.select(
        text("Invoice"), text("StockCode"), text("Description"),
        _whole(F.col("Quantity")).alias("quantity"),
        F.col("InvoiceDate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("Price").cast("decimal(18,4)").alias("price"),
        text("Customer ID"), text("Country"))


def source_violations(parts: Mapping[str, DataFrame],
                      expected_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Per part: are names and order exact, and does the row count equal the expected one?"""
    reports = []
    for name, frame in parts.items():
        wrong_columns = int(tuple(frame.columns) != RAW_COLUMNS)
        counted = frame.agg(F.count(F.lit(1)).alias("n_rows"))
        expected = (expected_rows or {}).get(name)
        wanted = F.lit(expected).cast("bigint") if expected is not None else F.col("n_rows")
        reports.append(counted.select(
            F.lit(name).alias("part"), F.lit(wrong_columns).cast("bigint").alias("wrong_columns"),
            "n_rows", F.abs(F.col("n_rows") - wanted).alias("row_count_gap")))
    total = reports[0]
    for report in reports[1:]:
        total = total.unionByName(report)
    return total


def load_parts(spark: SparkSession, paths: Mapping[str, tuple[str, str]],
               expected_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Canonical lines of all parts. Raises when a part breaks the source contract."""
    parts = {name: read_part(spark, path, fmt) for name, (path, fmt) in paths.items()}
    for name, frame in parts.items():
        if tuple(frame.columns) != RAW_COLUMNS:
            raise ContractError(f"part {name}: columns must be {RAW_COLUMNS}, got {frame.columns}")
    if expected_rows:
        require_clean(source_violations(parts, expected_rows).select(
            F.lit("row_count").alias("rule"), F.col("part").alias("subject"),
            F.col("row_count_gap").alias("failures")))
    frames = [canonicalize(frame) for frame in parts.values()]
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines


def schema_violations(lines: DataFrame) -> DataFrame:
    """Strict canonical schema: names, order, types (from metadata) and nulls (one pass)."""
    spark = lines.sparkSession
    static: list[tuple[str, str, int]] = [
        ("columns", "table", int(tuple(lines.columns) != CANONICAL_COLUMNS))]
    types = {f.name: f.dataType for f in lines.schema.fields}
    static += [("type", f.name, int(types.get(f.name) != f.dataType))
               for f in CANONICAL_SCHEMA.fields]
    report = spark.createDataFrame(static, "rule string, subject string, failures bigint")
    required = [f.name for f in CANONICAL_SCHEMA.fields if not f.nullable and f.name in types]
    nulls = lines.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = ", ".join(f"'{c}', `{c}`" for c in required)
    return report.unionByName(nulls.selectExpr(
        "'not_null' as rule", f"stack({len(required)}, {pairs}) as (subject, failures)"))


def null_rates(lines: DataFrame, maxima: Mapping[str, float] = MAX_NULL_RATES) -> DataFrame:
    shares = lines.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in maxima])
    triples = ", ".join(f"'{c}', `{c}`, {limit}D" for c, limit in maxima.items())
    return shares.selectExpr(
        f"stack({len(maxima)}, {triples}) as (column_name, null_rate, max_rate)"
    ).withColumn("within_limit", F.col("null_rate") <= F.col("max_rate"))


def date_range(lines: DataFrame, expected_min: str | None = None,
               expected_max: str | None = None) -> DataFrame:
    """First and last timestamp and whether they are the expected ones."""
    seen = lines.agg(F.min("invoice_date").alias("first_seen"),
                     F.max("invoice_date").alias("last_seen"),
                     F.count(F.lit(1)).alias("n_rows"))

    def same(column: str, wanted: str | None) -> Column:
        return F.lit(True) if wanted is None else F.col(column) == F.lit(wanted).cast("timestamp_ntz")

    return seen.withColumn("range_ok", same("first_seen", expected_min)
                           & same("last_seen", expected_max))


def require_clean(report: DataFrame) -> None:
    """Raise with every failed rule; ``report`` is a rule table, never data."""
    failed = report.where(F.col("failures") > 0).collect()
    if failed:
        raise ContractError("; ".join(f"{r.rule}({r.subject})={r.failures}" for r in failed))


def coerce_batch(upload: DataFrame) -> DataFrame:
    """Lenient casts of an uploaded batch: what cannot be read becomes null."""
    def text(name: str) -> Column:
        return F.trim(F.col(name).cast("string")).alias(name)

    return upload.select(
        text("invoice"), text("stock_code"), text("description"),
        F.col("quantity").cast("string").try_cast("double").try_cast("bigint").alias("quantity"),
        F.col("invoice_date").cast("string").try_cast("timestamp_ntz").alias("invoice_date"),
        F.col("price").cast("string").try_cast("double").alias("price"),
        text("customer_id"), text("country"))


def batch_violations(upload: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rules of a batch upload as rows (rule, subject, failures), counted in one pass.

    ``max_rows`` is the caller's own limit; without one a batch may have any size.
    """
    wrong_columns = int(tuple(upload.columns) != CANONICAL_COLUMNS)
    if wrong_columns:
        return upload.sparkSession.createDataFrame(
            [("columns", "batch", 1)], "rule string, subject string, failures bigint")
    rows = coerce_batch(upload)
    missing = F.lit(False)
    for name in ("invoice", "stock_code", "quantity", "invoice_date", "price", "customer_id"):
        missing = missing | F.col(name).isNull()
    price = F.col("price")
    infinite = F.isnan(price) | (F.abs(price) == F.lit(float("inf")))
    counted = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"),
        F.count_if(infinite).alias("not_finite"))
    return counted.selectExpr(
        "stack(5, 'columns', 0L, 'empty', cast(n = 0 as bigint), "
        f"'row_limit', {'0L' if max_rows is None else f'greatest(n - {int(max_rows)}L, 0L)'}, "
        "'required_values', missing, "
        "'finite_price', not_finite) as (rule, failures)"
    ).select("rule", F.lit("batch").alias("subject"), "failures")


def validate_batch(upload: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Typed batch lines, or an error that names every broken rule."""
    require_clean(batch_violations(upload, max_rows))
    return coerce_batch(upload).withColumn("price", F.col("price").cast("decimal(18,4)"))


def missing_columns(frame: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(frame.columns))

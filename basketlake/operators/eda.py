"""Exploratory summaries as small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.functions.distributed import exact_quantiles
from basketlake.operators.cleaning import AUDIT_FLAGS

RFM_COLUMNS = ("recency_days", "frequency_orders", "gross_spend", "net_spend", "avg_order_value")
DESCRIBE_POINTS = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90,
                   "p99": 0.99}


def long_form(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, value): one row per row and column."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return table.selectExpr(*[f"`{k}`" for k in keys],
                            f"stack({len(columns)}, {pairs}) as (feature, value)")


def describe(table: DataFrame, columns: Sequence[str] = RFM_COLUMNS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles of several columns at once."""
    values = long_form(table, columns)
    moments = values.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return moments.join(exact_quantiles(values, "value", DESCRIBE_POINTS, ["feature"]), "feature")


def by_label(table: DataFrame, label: str = "churn", columns: Sequence[str] = RFM_COLUMNS
             ) -> DataFrame:
    """Median and mean of every column per label, one row per (label, feature)."""
    values = long_form(table, columns, [label])
    means = values.groupBy(label, "feature").agg(F.avg("value").alias("mean"))
    medians = exact_quantiles(values, "value", {"median": 0.5}, [label, "feature"])
    return means.join(medians, [label, "feature"])


def class_balance(table: DataFrame, label: str = "churn") -> DataFrame:
    total = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (table.groupBy(label).agg(F.count(F.lit(1)).alias("customers"))
            .withColumn("proportion", F.col("customers") / total))


def country_summary(cleaned: DataFrame, top: int = 15) -> DataFrame:
    """Orders, customers, revenue and units of the leading countries.

    Lines shrink to (country, invoice, customer) first; two distinct counts over the raw lines would
    double every row.
    """
    slim = (cleaned.where("is_positive_purchase").groupBy("country", "invoice", "customer_id")
            .agg(F.sum("gross_positive_value").alias("v"), F.sum("quantity").alias("q")))
    invoices = slim.groupBy("country", "invoice").agg(F.sum("v").alias("v"), F.sum("q").alias("q"))
    money = invoices.groupBy("country").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("v").alias("gross_revenue"),
        F.sum("q").alias("units"))
    people = (slim.where(F.col("customer_id").isNotNull()).select("country", "customer_id")
              .distinct().groupBy("country").agg(F.count(F.lit(1)).alias("identified_customers")))
    return (money.join(people, "country", "left").fillna(0, ["identified_customers"])
            .orderBy(F.desc("gross_revenue"), "country").limit(top))


def seasonality(cleaned: DataFrame) -> DataFrame:
    """Orders, revenue and units per calendar month."""
    invoices = (cleaned.where("is_positive_purchase")
                .groupBy(F.date_format("invoice_date", "yyyy-MM").alias("year_month"),
                         F.quarter("invoice_date").alias("quarter"), "invoice")
                .agg(F.sum("gross_positive_value").alias("v"), F.sum("quantity").alias("q")))
    return invoices.groupBy("year_month", "quarter").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("v").alias("gross_revenue"),
        F.sum("q").alias("units"))


def flag_summary(cleaned: DataFrame, flags: Sequence[str] = AUDIT_FLAGS) -> DataFrame:
    counted = cleaned.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(f).alias(f) for f in flags])
    pairs = ", ".join(f"'{f}', `{f}`" for f in flags)
    return counted.selectExpr("__n", f"stack({len(flags)}, {pairs}) as (quality_flag, rows)").select(
        "quality_flag", "rows", (F.col("rows") / F.col("__n")).alias("proportion"))


def hypothesis_facts(cleaned: DataFrame, labelled: DataFrame, top: int = 15) -> DataFrame:
    """The figures behind the written hypotheses, as (fact, value) text rows."""
    medians = by_label(labelled, "churn", ("recency_days", "frequency_orders")).select(
        F.concat_ws("_", F.lit("median"), "feature", F.col("churn").cast("string")).alias("fact"),
        F.format_string("%.1f", "median").alias("value"))
    leaders = country_summary(cleaned, top)
    leading = leaders.agg(
        F.max(F.struct("gross_revenue", "country")).alias("best"),
        F.sum("gross_revenue").alias("all")).selectExpr(
        "stack(2, 'leading_country', best.country, 'leading_country_share', "
        "format_string('%.4f', cast(best.gross_revenue as double) / cast(all as double))) "
        "as (fact, value)")
    peak = seasonality(cleaned).agg(
        F.max_by("year_month", "gross_revenue").alias("value")).select(
        F.lit("peak_month").alias("fact"), "value")
    return medians.unionByName(leading).unionByName(peak)


def histogram(table: DataFrame, columns: dict[str, str], bins: int = 40) -> DataFrame:
    """Counts per equal-width bin; ``columns`` maps a name to an SQL expression."""
    values = long_form(table.select(*[F.expr(e).alias(n) for n, e in columns.items()]),
                       list(columns))
    ends = values.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"),
                                                               F.lit(0.0)) * bins)
    return (values.join(F.broadcast(ends), "feature")
            .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
            .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"),
                                           F.max("high").alias("high")))


def correlations(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, from one aggregate over the rows.

    Centred on the column means first, so large offsets do not cancel digits.
    """
    columns = list(columns)
    means = table.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
                      .alias("m")).scalar()
    centred = table.withColumn("__m", means).select(
        F.array(*[F.col(c).cast("double") - F.col(f"__m.{c}") for c in columns]).alias("x"))
    p = len(columns)
    # One sum per unordered pair: p is the number of features, so the row stays small.
    sums = centred.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s_{i}_{j}")
                         for i in range(p) for j in range(i, p)])
    pairs = []
    for i in range(p):
        for j in range(p):
            a, b = min(i, j), max(i, j)
            pairs.append(f"'{columns[i]}', '{columns[j]}', try_divide(s_{a}_{b}, "
                         f"sqrt(s_{i}_{i}) * sqrt(s_{j}_{j}))")
    return sums.selectExpr(
        f"stack({p * p}, {', '.join(pairs)}) as (feature_a, feature_b, correlation)")


def correlated_pairs(matrix: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Unordered pairs with at least ``threshold`` absolute correlation."""
    return (matrix.where((F.col("feature_a") < F.col("feature_b"))
                         & (F.abs("correlation") >= threshold))
            .withColumn("absolute_correlation", F.abs("correlation"))
            .orderBy(F.desc("absolute_correlation"), "feature_a", "feature_b"))



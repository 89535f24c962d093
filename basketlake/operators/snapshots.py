"""Cutoffs, point-in-time history and target windows, labels, and the customer split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.functions.distributed import hashed_rank
from basketlake.functions.timing import days, moment
from basketlake.settings import SnapshotSettings, SplitSettings

PARTITIONS = ("train", "validation", "test")


def canonical_cutoffs(cleaned: DataFrame, cfg: SnapshotSettings = SnapshotSettings()) -> DataFrame:
    """One row: last timestamp of all lines, and the two prediction cutoffs before it."""
    if cfg.clv_days <= cfg.churn_days:
        raise ValueError("the value cutoff must come before the churn cutoff")
    return cleaned.agg(F.max("invoice_date").alias("observation_end")).select(
        "observation_end", (F.col("observation_end") - days(cfg.churn_days)).alias("churn_cutoff"),
        (F.col("observation_end") - days(cfg.clv_days)).alias("clv_cutoff"))


def history(lines: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Lines strictly before each (customer_id, cutoff_timestamp)."""
    return lines.join(snapshots, "customer_id").where(
        F.col("invoice_date") < F.col("cutoff_timestamp"))


def target_window(lines: DataFrame, snapshots: DataFrame, horizon_days: int,
                  closed: bool = True) -> DataFrame:
    """Lines from each cutoff to cutoff + horizon; the upper end counts only when ``closed``."""
    end = F.col("cutoff_timestamp") + days(horizon_days)
    upper = F.col("invoice_date") <= end if closed else F.col("invoice_date") < end
    return lines.join(snapshots, "customer_id").where(
        (F.col("invoice_date") >= F.col("cutoff_timestamp")) & upper)


def eligible_customers(cleaned: DataFrame, cutoff: Column | str) -> DataFrame:
    """Identified customers with a positive purchase before the cutoff."""
    return cleaned.where(
        F.col("customer_id").isNotNull() & F.col("is_positive_purchase")
        & (F.col("invoice_date") < moment(cutoff))).select("customer_id").distinct()


def _window(cleaned: DataFrame, cutoff: Column, horizon_days: int) -> DataFrame:
    return cleaned.where(F.col("customer_id").isNotNull()
                         & (F.col("invoice_date") >= cutoff)
                         & (F.col("invoice_date") <= cutoff + days(horizon_days)))


def churn_labels(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str,
                 horizon_days: int = 90) -> DataFrame:
    """1 for customers without a positive purchase in the closed window after the cutoff."""
    buyers = (_window(cleaned, moment(cutoff), horizon_days).where("is_positive_purchase")
              .select("customer_id").distinct().withColumn("bought", F.lit(0)))
    return customers.select("customer_id").join(buyers, "customer_id", "left").select(
        "customer_id", F.coalesce("bought", F.lit(1)).alias("churn"))


def clv_targets(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str,
                horizon_days: int = 180) -> DataFrame:
    """Net merchandise value in the closed window after the cutoff, never below zero."""
    spent = (_window(cleaned, moment(cutoff), horizon_days).where("is_valid_merchandise")
             .groupBy("customer_id").agg(F.sum("signed_merchandise_value").alias("net")))
    value = F.greatest(F.coalesce(F.col("net").cast("double"), F.lit(0.0)), F.lit(0.0))
    return customers.select("customer_id").join(spent, "customer_id", "left").select(
        "customer_id", value.alias("clv_180d_target"))


def split_customers(customers: DataFrame, cfg: SplitSettings = SplitSettings()) -> DataFrame:
    """Seeded shuffle of customers cut at floor(train*n) and floor(validation*n); the rest is test.

    The shuffle order is an md5 of seed and customer, ranked exactly over hash ranges, so the sizes
    are exact at any scale and no task sees the whole population.
    """
    if abs(cfg.train + cfg.validation + cfg.test - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to one")
    ranked = hashed_rank(customers.select("customer_id"), "customer_id", str(cfg.seed),
                         rank="place", size="total")
    first = F.floor(F.col("total") * F.lit(cfg.train))
    second = first + F.floor(F.col("total") * F.lit(cfg.validation))
    return ranked.select(
        "customer_id",
        F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation")
        .otherwise("test").alias("partition"),
        F.lit(cfg.seed).alias("split_seed"), F.lit(cfg.version).alias("split_version"))


def split_violations(split: DataFrame) -> DataFrame:
    """Null, repeated or mislabelled customers and absent partitions, as (rule, failures)."""
    per_customer = split.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("partition").isin(*PARTITIONS)).alias("odd"),
        *[F.max((F.col("partition") == p).cast("int")).alias(p) for p in PARTITIONS])
    counted = per_customer.agg(
        F.count_if(F.col("customer_id").isNull()).alias("nulls"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"),
        *[F.coalesce(F.max(p), F.lit(0)).alias(p) for p in PARTITIONS])
    return counted.selectExpr(
        "stack(4, 'null_customer', nulls, 'repeated_customer', repeated, 'unknown_partition', odd,"
        " 'absent_partition', cast(3 - train - validation - test as bigint)) as (rule, failures)")


def customers_in(split: DataFrame, partition: str) -> DataFrame:
    if partition not in PARTITIONS:
        raise ValueError(f"unknown partition {partition!r}")
    return split.where(F.col("partition") == partition).select("customer_id")


def development_rows(labelled: DataFrame) -> DataFrame:
    """Train and validation rows only: what a model may see before the final evaluation."""
    return labelled.where(F.col("partition").isin("train", "validation"))


def require_supervised(labelled: DataFrame) -> None:
    """Both development sides present and no unknown label (one small aggregate)."""
    seen = {r.partition for r in labelled.select("partition").distinct().limit(10).collect()}
    if not {"train", "validation"} <= seen or not seen <= set(PARTITIONS):
        raise ValueError(f"training needs train and validation rows only, found {sorted(seen)}")


def labelled_table(features: DataFrame, labels: DataFrame, split: DataFrame) -> DataFrame:
    return (features.join(labels, "customer_id")
            .join(split.select("customer_id", "partition", "split_version"), "customer_id"))


def one_to_one_violations(features: DataFrame, labels: DataFrame, split: DataFrame) -> DataFrame:
    """Customers that do not occur exactly once on each side of the labelled join."""
    sides = None
    for number, side in enumerate((features, labels, split)):
        marked = side.select("customer_id", *[
            F.lit(int(number == k)).alias(f"s{k}") for k in range(3)])
        sides = marked if sides is None else sides.unionByName(marked)
    counts = sides.groupBy("customer_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)])
    bad = (F.col("s0") != 1) | (F.col("s1") != 1) | (F.col("s2") != 1)
    return counts.agg(F.count(F.lit(1)).alias("customers"), F.count_if(bad).alias("failures"))

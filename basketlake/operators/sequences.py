"""Invoice sequences: events, rolling snapshots of the last events, padding, next category.

Only the last ``length`` events before a cutoff are ever collected, so arrays stay bounded however
long a customer's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.timing import days, elapsed_days, moment, month_start
from basketlake.operators.features import with_previous_order
from basketlake.settings import SequenceSettings

UNKNOWN = -1


def _with_category(lines: DataFrame, taxonomy: DataFrame) -> DataFrame:
    known = taxonomy.select("stock_code", F.col("category_id").cast("int").alias("category_id"))
    return lines.join(known, "stock_code", "left").withColumn(
        "category_id", F.coalesce("category_id", F.lit(UNKNOWN)))


def invoice_events(cleaned: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per invoice: date, amount, leading category index (0 = unknown), days since the last one.

    The leading category has the largest value, then quantity, then the smallest number; one
    aggregate picks it with ``max`` over a struct, so invoices need no window.
    """
    lines = cleaned.where(F.col("customer_id").isNotNull() & F.col("is_positive_purchase")
                          & F.col("is_valid_merchandise"))
    # Lines shrink to (customer, invoice, product) before they meet the taxonomy.
    slim = lines.groupBy("customer_id", "invoice", "stock_code").agg(
        F.min("invoice_date").alias("invoice_date"), F.sum("gross_positive_value").alias("value"),
        F.sum("quantity").alias("units"))
    per_category = (_with_category(slim, taxonomy)
                    .groupBy("customer_id", "invoice", "category_id")
                    .agg(F.min("invoice_date").alias("invoice_date"), F.sum("value").alias("value"),
                         F.sum("units").alias("units")))
    leading = F.max(F.struct("value", "units", (-F.col("category_id")).alias("order")))
    invoices = per_category.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("invoice_date"), F.sum("value").alias("order_amount"),
        (1 - leading.getField("order")).cast("int").alias("category_index"))
    gap = elapsed_days(F.col("invoice_date"), F.col("previous_date"))
    return (with_previous_order(invoices)
            .withColumn("gap_days", F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)))
            .withColumn("amount", F.log1p(F.greatest(F.col("order_amount").cast("double"),
                                                     F.lit(0.0))))
            .drop("previous_date"))


def sequence_snapshots(events: DataFrame, observation_end: Column | str,
                       cfg: SequenceSettings = SequenceSettings()) -> DataFrame:
    """(customer, cutoff, history_end, label): the last monthly cutoffs with enough prior events.

    Cutoffs run from the month after the first event to the last complete horizon; the last
    ``max_snapshots`` are kept before short histories are dropped.
    """
    latest = moment(observation_end) - days(cfg.horizon_days)
    firsts = events.groupBy("customer_id").agg(F.min("invoice_date").alias("first"))
    month = F.expr("interval 1 month")
    start = month_start(F.col("first")) + month
    # Only the last ``max_snapshots`` month starts can be kept, so later ones alone are listed.
    stop = month_start(latest)
    earliest = F.add_months(stop.cast("date"), -(cfg.max_snapshots - 1)).cast("timestamp_ntz")
    begin = F.greatest(start, earliest) if cfg.max_snapshots > 0 else start
    cutoffs = (firsts.select("customer_id", begin.alias("b"), stop.alias("e")).where("b <= e")
               .select("customer_id", F.explode(F.sequence("b", "e", month))
                       .alias("cutoff_timestamp")))
    # Events are reduced to counts per slot between month starts, then summed up per cutoff.
    at = month_start(F.col("invoice_date"))
    months = events.groupBy("customer_id", at.alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.min("invoice_date").alias("first_in_month"))
    running = (Window.partitionBy("customer_id").orderBy("m")
               .rowsBetween(Window.unboundedPreceding, 0))
    following = Window.partitionBy("customer_id").orderBy("m")
    state = months.select(
        "customer_id", "m", F.sum("n").over(running).alias("history_end"),
        F.lead("first_in_month").over(following).alias("next_event"),
        F.lead("m").over(following).alias("next_m"))
    inside = ((F.col("m") < F.col("cutoff_timestamp"))
              & (F.col("next_m").isNull() | (F.col("next_m") >= F.col("cutoff_timestamp"))))
    horizon = F.col("cutoff_timestamp") + days(cfg.horizon_days)
    return (cutoffs.join(state, "customer_id").where(inside)
            .where(F.col("history_end") >= cfg.min_events)
            .select("customer_id", "cutoff_timestamp", "history_end",
                    F.coalesce(F.col("next_event") < horizon, F.lit(False)).cast("int")
                    .alias("label")))


def _collect(events: DataFrame, snapshots: DataFrame, length: int) -> DataFrame:
    """Last ``length`` events of every snapshot as a sorted array of structs."""
    keys = [c for c in snapshots.columns if c not in ("history_end",)]
    first_needed = (snapshots.groupBy("customer_id")
                    .agg(F.min(F.col("history_end") - length).alias("__from"),
                         F.max("history_end").alias("__to")))
    useful = events.join(first_needed, "customer_id").where(
        (F.col("event_rank") > F.col("__from")) & (F.col("event_rank") <= F.col("__to")))
    joined = useful.join(snapshots, "customer_id").where(
        (F.col("event_rank") <= F.col("history_end"))
        & (F.col("event_rank") > F.col("history_end") - length))
    return joined.groupBy(*keys, "history_end").agg(
        F.array_sort(F.collect_list(F.struct("event_rank", "amount", "gap_days", "category_index")))
        .alias("events")).withColumn("length", F.size("events"))


def rolling_sequences(events: DataFrame, split: DataFrame, observation_end: Column | str,
                      cfg: SequenceSettings = SequenceSettings(),
                      partitions: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Snapshots of the allowed partitions with their last events and the 30-day label."""
    allowed = split.where(F.col("partition").isin(*partitions)).select("customer_id", "partition")
    own = events.join(allowed.select("customer_id"), "customer_id", "left_semi")
    snapshots = sequence_snapshots(own, observation_end, cfg)
    return _collect(own, snapshots, cfg.length).join(allowed, "customer_id")


def latest_sequences(events: DataFrame, cutoff: Column | str,
                     cfg: SequenceSettings = SequenceSettings()) -> DataFrame:
    """Last events of every customer before one cutoff, given at least ``min_events`` of them.

    ``events`` must come from lines before the cutoff.
    """
    counts = events.groupBy("customer_id").agg(F.max("event_rank").alias("history_end")).where(
        F.col("history_end") >= cfg.min_events)
    snapshots = counts.withColumn("cutoff_timestamp", moment(cutoff))
    return _collect(events, snapshots, cfg.length)


def scaler(sequences: DataFrame) -> DataFrame:
    """Mean and population deviation of the real (unpadded) steps; tiny deviations become 1."""
    steps = sequences.select(F.explode("events").alias("e")).select("e.amount", "e.gap_days")

    def deviation(name: str) -> Column:
        spread = F.stddev_pop(name)
        return F.when(spread > 1e-12, spread).otherwise(1.0)

    return steps.agg(F.avg("amount").alias("amount_mean"), deviation("amount").alias("amount_scale"),
                     F.avg("gap_days").alias("gap_mean"), deviation("gap_days").alias("gap_scale"))


def padded(sequences: DataFrame, fitted: DataFrame, length: int = 20) -> DataFrame:
    """Scaled amounts and gaps and category indexes, right-padded with zeros to ``length``."""
    fit = fitted.select(F.struct(*fitted.columns).alias("s")).scalar()

    def pad(values: Column, zero: Column) -> Column:
        return F.concat(values, F.array_repeat(zero, F.lit(length) - F.size("events")))

    scaled = sequences.withColumn("__s", fit)
    return scaled.withColumns({
        "amounts": pad(F.transform("events", lambda e: (e["amount"] - F.col("__s.amount_mean"))
                                   / F.col("__s.amount_scale")), F.lit(0.0)),
        "gaps": pad(F.transform("events", lambda e: (e["gap_days"] - F.col("__s.gap_mean"))
                                / F.col("__s.gap_scale")), F.lit(0.0)),
        "categories": pad(F.transform("events", lambda e: e["category_index"]), F.lit(0)),
    }).drop("__s")


def next_category(cleaned: DataFrame, taxonomy: DataFrame, cutoff: Column | str) -> DataFrame:
    """Leading category of each customer's first positive invoice at or after the cutoff."""
    future = cleaned.where(
        F.col("customer_id").isNotNull() & (F.col("invoice_date") >= moment(cutoff))
        & F.col("is_positive_purchase") & F.col("is_product"))
    slim = future.groupBy("customer_id", "invoice", "stock_code").agg(
        F.min("invoice_date").alias("invoice_date"), F.sum("gross_positive_value").alias("value"),
        F.sum("quantity").alias("units"))
    first = slim.groupBy("customer_id").agg(
        F.min(F.struct("invoice_date", "invoice")).getField("invoice").alias("invoice"))
    per_category = (_with_category(slim.join(first, ["customer_id", "invoice"]), taxonomy)
                    .groupBy("customer_id", "category_id")
                    .agg(F.sum("value").alias("value"), F.sum("units").alias("units")))
    best = F.max(F.struct("value", "units", (-F.col("category_id")).alias("order")))
    return per_category.groupBy("customer_id").agg(best.alias("b")).select(
        "customer_id", (-F.col("b.order")).cast("int").alias("next_category_id"),
        F.col("b.value").cast("double").alias("merchandise_value"),
        F.col("b.units").alias("merchandise_quantity"))

"""Forward-value snapshots at many cutoffs at once.

Lines are reduced to order-grain rows, which are shuffled once, by customer. A row matters to the 180-day
windows of only a few cutoffs, so it is exploded to those cutoffs and reduced by (customer, cutoff);
lifetime measures are running sums over at most one row per cutoff. No customer's history is joined with
all its cutoffs, and no group is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import ratio
from basketlake.functions.distributed import exact_quantiles
from basketlake.functions.timing import day_start, days, elapsed_days, moment, month_start
from basketlake.session import materialize
from basketlake.settings import RollingSettings

WINDOWS = (30, 60, 90, 180)

# The model inputs, in order.
CLV_FEATURES = (
    "spend_30d", "spend_60d", "spend_90d", "spend_180d",
    "orders_30d", "orders_60d", "orders_90d", "orders_180d",
    "recent_spend_velocity", "recent_order_frequency_velocity",
    "avg_order_value_30d", "avg_order_value_60d", "avg_order_value_90d", "avg_order_value_180d",
    "maximum_recent_order_value", "recent_order_value_std", "active_month_count",
    "customer_tenure_days", "recency_days", "purchase_gap_mean_days", "purchase_gap_std_days",
    "return_value_ratio", "bulk_order_share", "high_value_order_share",
    "lifetime_orders", "lifetime_positive_spend", "lifetime_net_revenue",
)


def order_table(cleaned: DataFrame) -> DataFrame:
    """Positive lines of identified customers as (customer, invoice) date, value, units."""
    return (cleaned.where(F.col("customer_id").isNotNull() & F.col("is_positive_purchase"))
            .groupBy("customer_id", "invoice")
            .agg(F.min("invoice_date").alias("invoice_date"),
                 F.sum("gross_positive_value").alias("order_value"),
                 F.sum("quantity").alias("order_units")))


def rolling_cutoffs(cleaned: DataFrame, cfg: RollingSettings = RollingSettings()) -> DataFrame:
    """Month starts with enough history before and a whole horizon after: (cutoff_timestamp)."""
    span = cleaned.agg(F.min("invoice_date").alias("a"), F.max("invoice_date").alias("b"))
    start = day_start(F.col("a")) + days(cfg.initial_history_days)
    month = month_start(start)
    first = F.when(month == start, month).otherwise(month + F.expr("interval 1 month"))
    last = month_start(F.col("b") - days(cfg.horizon_days))
    return span.select(first.alias("f"), last.alias("l")).where("f <= l").select(F.explode(F.sequence(
                           "f", "l", F.expr("interval 1 month"))).alias("cutoff_timestamp"))


def cutoff_array(cutoffs: DataFrame) -> Column:
    """The few cutoffs of a run (one per month) as one sorted array value."""
    return cutoffs.agg(F.array_sort(F.collect_set("cutoff_timestamp")).alias("c")).scalar()


def activity(cleaned: DataFrame) -> DataFrame:
    """Lines of identified customers reduced to (customer, invoice, timestamp) sums.

    Money is counted in whole ten-thousandths, the unit of the lines: sums of long integers are exact.
    """
    value, gross = ((F.col(c) * 10_000).cast("bigint") for c in ("signed_merchandise_value", "gross_positive_value"))
    valid, bought = F.col("is_valid_merchandise"), F.col("is_positive_purchase")
    return (cleaned.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "invoice", "invoice_date").agg(
        F.sum(F.when(valid, value)).alias("net"),
        F.sum(F.when(valid & (value > 0), value)).alias("plus"),
        F.sum(F.when(valid & (value < 0), -value)).alias("minus"),
        F.sum(F.when(bought, gross)).alias("order_value"),
        F.sum(F.when(bought, F.col("quantity"))).alias("order_units")))


def _money(units: Column) -> Column:
    return units.cast("double") / 10_000.0


def _with_orders(rows: DataFrame) -> DataFrame:
    """Activity of whole customers, each order on the row of its first timestamp, with the gap before it.

    Needs rows that are partitioned by customer: it shuffles nothing then.
    """
    invoice = Window.partitionBy("customer_id", "invoice")
    bought = F.col("order_units").isNotNull()
    dated = rows.withColumn("__date", F.min(F.when(bought, F.col("invoice_date"))).over(invoice)).withColumns(
        {c: F.sum(c).over(invoice) for c in ("order_value", "order_units")})
    here = F.col("invoice_date") == F.col("__date")
    dated = dated.withColumns({c: F.when(here, F.col(c)) for c in ("order_value", "order_units")}).withColumn(
        "order_date", F.when(here, F.col("__date"))).where(F.col("invoice_date").isNotNull())
    before = (Window.partitionBy("customer_id").orderBy("invoice_date", "invoice")
              .rowsBetween(Window.unboundedPreceding, -1))
    return dated.withColumn("gap", elapsed_days(
        F.col("order_date"), F.last("order_date", ignorenulls=True).over(before))).drop("__date", "invoice")


def _snapshots(rows: DataFrame, cutoffs: Column, cfg: RollingSettings, min_orders: int = 1,
               min_days: float = 0.0, horizon_days: int | None = None) -> DataFrame:
    """All measures of every (customer, cutoff) with enough orders before the cutoff, from activity rows.

    A row counts for the cutoffs whose 180 days it lies in, for the first cutoff after it (the start of what
    it adds to lifetime sums) and, with ``horizon_days``, for the cutoffs it lies in the horizon of. These
    are neighbours in the sorted cutoffs, so a row is exploded to one run of places. Everything after the
    one shuffle by customer stays in its partition: a customer's orders meet in a task, its lines do not.
    """
    reach = max(WINDOWS)

    def place(x: Column) -> Column:
        """Number of cutoffs up to ``x``: where it would stand among them, without a lambda for each row."""
        after = x + F.expr("interval 1 microsecond")
        return (F.array_position(F.sort_array(F.array_append("__all", after)), after) - 1).cast("int")

    when = F.col("invoice_date")
    placed = (_with_orders(rows.repartition("customer_id")).withColumn("__all", cutoffs)
              .withColumn("__next", place(when))
              .withColumn("__from", F.col("__next") if horizon_days is None else place(when - days(horizon_days)))
              .withColumn("__to", F.greatest(place(when + days(reach)),
                                             F.least(F.col("__next") + 1, F.size("__all"))))
              .withColumn("place", F.explode(F.when(F.col("__to") > F.col("__from"), F.sequence(
                  F.col("__from"), F.col("__to") - 1))))
              .withColumn("__ago", F.get("__all", F.col("place")) - when).drop("__all", "__from", "__to"))
    ago, value, starts = F.col("__ago"), F.col("order_value"), F.col("place") == F.col("__next")
    past = F.col("place") >= F.col("__next")
    near, is_order = past & (ago <= days(reach)), F.col("order_date").isNotNull()
    near_value = F.when(near, value)
    recent = []
    for d in WINDOWS:
        inside = past & (ago <= days(d))
        recent += [F.sum(F.when(inside, value)).alias(f"spend_{d}d"),
                   F.count_if(inside & is_order).alias(f"orders_{d}d")]
    previous = past & (ago > days(30)) & (ago <= days(60))
    recent += [
        F.sum(F.when(previous, value)).alias("spend_before"),
        F.count_if(previous & is_order).alias("orders_before"),
        F.max(near_value).alias("maximum_recent_order_value"),
        F.stddev_pop(_money(near_value)).alias("recent_order_value_std"),
        # Distinct months by bit: a 180-day window touches at most 7 consecutive months.
        F.bit_or(F.when(near & is_order, F.call_function("shiftleft", F.lit(1), (
            (F.year("invoice_date") * 12 + F.month("invoice_date")) % 31)))).alias("months"),
        F.avg(F.when(near, (F.col("order_units") >= cfg.bulk_units).cast("double"))).alias("bulk_order_share"),
        F.avg(F.when(near, (value >= (F.lit(cfg.high_value).cast("decimal(18,4)") * 10_000).cast("bigint"))
                     .cast("double"))).alias("high_value_order_share"),
        F.sum(F.when(near, F.col("minus"))).alias("minus"), F.sum(F.when(near, F.col("plus"))).alias("plus"),
        F.sum(F.when(~past, F.col("net"))).alias("future")]
    gap = F.when(starts, F.col("gap"))
    lifetime = [
        F.count_if(starts & is_order).alias("n"), F.sum(F.when(starts, value)).alias("value"),
        F.count(gap).alias("gaps"), F.sum(gap).alias("gap_sum"), F.sum(gap * gap).alias("gap_squares"),
        F.sum(F.when(starts, F.col("net"))).alias("net")]
    ends = [F.min(F.when(starts, F.col("order_date"))).alias("first"),
            F.max(F.when(starts, F.col("order_date"))).alias("last"),
            F.max(F.when(starts, when)).alias("feature_max_timestamp")]
    touched = placed.groupBy("customer_id", "place").agg(*recent, *lifetime, *ends)
    by_place = Window.partitionBy("customer_id").orderBy("place")
    run = by_place.rowsBetween(Window.unboundedPreceding, 0)
    sums = ("n", "value", "gaps", "gap_sum", "gap_squares", "net")
    state = touched.withColumns({
        **{c: F.sum(c).over(run) for c in sums}, "first": F.min("first").over(run),
        "last": F.max("last").over(run), "feature_max_timestamp": F.max("feature_max_timestamp").over(run),
        "__until": F.coalesce(F.lead("place").over(by_place), F.size(cutoffs))})
    # up to the next touched cutoff the lifetime state stays, and the windows are empty
    carried = state.where(F.col("n") >= max(min_orders, 1)).withColumn(
        "__at", F.explode(F.sequence(F.col("place"), F.col("__until") - 1)))
    own = F.col("__at") == F.col("place")
    names = [c for c in touched.columns if c not in (
        "customer_id", "place", *sums, "first", "last", "feature_max_timestamp")]
    rows = carried.select(
        "customer_id", F.get(cutoffs, F.col("__at")).alias("cutoff_timestamp"), *sums, "first", "last",
        "feature_max_timestamp", *[F.when(own, F.col(c)).alias(c) for c in names])
    at = F.col("cutoff_timestamp")
    return rows.withColumns({
        "customer_tenure_days": elapsed_days(at, F.col("first")),
        "recency_days": elapsed_days(at, F.col("last"))}).where(F.col("customer_tenure_days") >= min_days)


def _with_inputs(rows: DataFrame, *others: str | Column) -> DataFrame:
    """Keys, the 27 inputs from the measures of ``_snapshots``, and other columns.

    What is missing or not finite is 0: one lambda over an array, as 27 conditions side by side make a
    generated method too long to be compiled.
    """
    spend = {d: _money(F.col(f"spend_{d}d")) for d in WINDOWS}
    zero, gaps = F.lit(0.0), F.col("gaps")
    squares = F.col("gap_squares") - F.col("gap_sum") * F.col("gap_sum") / F.nullif(gaps, F.lit(0))
    found = {
        **{f"spend_{d}d": spend[d] for d in WINDOWS},
        **{f"avg_order_value_{d}d": ratio(spend[d], F.col(f"orders_{d}d")) for d in WINDOWS},
        "recent_spend_velocity": (F.coalesce(spend[30], zero) - F.coalesce(
            _money(F.col("spend_before")), zero)) / 30.0,
        "recent_order_frequency_velocity": (F.col("orders_30d") - F.col("orders_before")).cast("double") / 30.0,
        "maximum_recent_order_value": _money(F.col("maximum_recent_order_value")),
        "active_month_count": F.bit_count("months"),
        "purchase_gap_mean_days": ratio(F.col("gap_sum"), gaps),
        "purchase_gap_std_days": F.sqrt(F.greatest(squares, zero) / F.when(gaps > 1, gaps - 1)),
        "return_value_ratio": ratio(F.coalesce(F.col("minus"), F.lit(0)), F.col("plus")),
        "lifetime_orders": F.col("n"), "lifetime_positive_spend": _money(F.col("value")),
        "lifetime_net_revenue": _money(F.col("net"))}
    values = F.array(*[found.get(name, F.col(name)).cast("double") for name in CLV_FEATURES])
    finite = F.transform(values, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(0.0))
    return rows.select("customer_id", "cutoff_timestamp", finite.alias("__x"), *others).select(
        "customer_id", "cutoff_timestamp",
        *[F.get("__x", F.lit(i)).alias(name) for i, name in enumerate(CLV_FEATURES)],
        *[F.col(c) for c in rows.select(*others).columns])


def clv_features(cleaned: DataFrame, cutoffs: Column, cfg: RollingSettings = RollingSettings(),
                 min_orders: int = 0, min_days: float = 0.0) -> DataFrame:
    """The 27 inputs for every (customer, cutoff) with enough orders before the cutoff."""
    return _with_inputs(_snapshots(activity(cleaned), cutoffs, cfg, min_orders, min_days), "feature_max_timestamp")


def clv_features_at(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str,
                    cfg: RollingSettings = RollingSettings()) -> DataFrame:
    """The 27 inputs of the given customers at one cutoff; customers without orders are all 0."""
    wanted = customers.select("customer_id")
    known = cleaned.join(wanted, "customer_id", "left_semi")
    table = clv_features(known, F.array(moment(cutoff)), cfg)
    return (wanted.join(table, "customer_id", "left")
            .fillna(0.0, subset=list(CLV_FEATURES))
            .select("customer_id", *CLV_FEATURES))


def snapshot_eligibility(cleaned: DataFrame, cutoffs: Column,
                         cfg: RollingSettings = RollingSettings()) -> DataFrame:
    """(customer, cutoff) pairs with enough orders and enough days since the first order."""
    return _snapshots(activity(cleaned), cutoffs, cfg, cfg.min_history_orders, cfg.min_history_days).select(
        "customer_id", "cutoff_timestamp", F.col("n").alias("history_orders"),
        F.col("customer_tenure_days").alias("history_days"))


def rolling_dataset(cleaned: DataFrame, split: DataFrame, cfg: RollingSettings = RollingSettings()
                    ) -> DataFrame:
    """Features and forward value of train and validation customers at every rolling cutoff."""
    development = split.where(F.col("partition").isin("train", "validation")).select(
        "customer_id", "partition")
    # order-grain rows, written once: the cutoffs and the end are read from them first
    rows = materialize(activity(cleaned).repartition("customer_id").join(
        development.select("customer_id"), "customer_id", "left_semi"))
    cutoffs = cutoff_array(rolling_cutoffs(rows, cfg))
    found = _snapshots(rows, cutoffs, cfg, cfg.min_history_orders, cfg.min_history_days, cfg.horizon_days)
    end = rows.agg(F.max("invoice_date").alias("e")).scalar()
    target = F.greatest(F.coalesce(_money(F.col("future")), F.lit(0.0)), F.lit(0.0)).alias("clv_180d_target")
    return (_with_inputs(found, "feature_max_timestamp", target)
            .join(development, "customer_id")
            .withColumn("target_window_end", F.col("cutoff_timestamp") + days(cfg.horizon_days))
            .withColumn("observation_end", end))


def leakage_audit(dataset: DataFrame, split: DataFrame) -> DataFrame:
    """Rules no rolling dataset may break, as (rule, failures)."""
    held_out = split.where(F.col("partition") == "test").select("customer_id")
    leaked = (dataset.select("customer_id").join(held_out, "customer_id", "left_semi")
              .agg(F.count(F.lit(1)).alias("n")))
    counted = dataset.agg(
        F.count_if(~(F.col("feature_max_timestamp") < F.col("cutoff_timestamp"))).alias("a"),
        F.count_if(~(F.col("target_window_end") <= F.col("observation_end"))).alias("b"))
    return counted.withColumn("c", leaked.scalar()).selectExpr(
        "stack(3, 'feature_after_cutoff', a, 'incomplete_horizon', b, 'test_customer', c) "
        "as (rule, failures)")


def dataset_summary(dataset: DataFrame) -> DataFrame:
    """One row of counts and the distribution of the target."""
    target = F.col("clv_180d_target")

    counts = dataset.agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        F.avg((target == 0).cast("double")).alias("target_zero_rate"),
        F.avg(target).alias("target_mean"), F.max(target).alias("target_max"),
        F.min("cutoff_timestamp").alias("snapshot_date_min"),
        F.max("cutoff_timestamp").alias("snapshot_date_max"))
    people = (dataset.select("customer_id", "partition").distinct().agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("partition") == "train").alias("tr"),
        F.count_if(F.col("partition") == "validation").alias("va")))
    shape = exact_quantiles(dataset, "clv_180d_target", {
        "target_median": 0.5, "target_p75": 0.75, "target_p90": 0.90, "target_p95": 0.95,
        "target_p99": 0.99})
    who = people.select(F.struct("all", "tr", "va").alias("s")).scalar()
    points = shape.select(F.struct(*shape.columns).alias("s")).scalar()
    return (counts.withColumn("__w", who).withColumn("__p", points)
            .withColumn("development_customer_count", F.col("__w.all"))
            .withColumn("train_customer_count", F.col("__w.tr"))
            .withColumn("validation_customer_count", F.col("__w.va"))
            .select("*", "__p.*").drop("__w", "__p"))

"""Serving tables and the analytic questions asked of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.functions import smoothing
from basketlake.functions.distributed import exact_quantiles

# Columns of an exported batch result, in order, with their types.
BATCH_RESULT_COLUMNS = {
    "prediction_id": "bigint", "customer_id": "string", "as_of_timestamp": "timestamp_ntz",
    "churn_probability": "double", "churn_label": "boolean", "churn_threshold": "double",
    "predicted_clv_180d": "double", "next_purchase_probability": "double",
    "next_category_id": "string", "next_category_probability": "double", "anomaly_score": "double",
    "anomaly_flag": "boolean", "segment_id": "int", "segment_name": "string",
    "model_version": "string", "persisted": "boolean",
}


def latest_predictions(scores: DataFrame) -> DataFrame:
    """Per customer the newest score; equal times are settled by the larger id.

    ``max_by`` combines map-side, so a customer with very many scores is not sorted in one task.
    """
    row = F.struct(*scores.columns)
    return (scores.groupBy("customer_id")
            .agg(F.max_by(row, F.struct("scored_at", "id")).alias("r")).select("r.*"))


def value_tiers(table: DataFrame, value: str = "net_spend") -> DataFrame:
    """low / medium / high by the thirds of the value."""
    cuts = exact_quantiles(table, value, {"lower": 1 / 3, "upper": 2 / 3})
    bounds = cuts.select(F.struct("lower", "upper").alias("c")).scalar()
    return (table.withColumn("__c", bounds).withColumn(
        "value_tier", F.when(F.col(value) <= F.col("__c.lower"), "low")
        .when(F.col(value) <= F.col("__c.upper"), "medium").otherwise("high")).drop("__c"))


def latest_country(lines: DataFrame) -> DataFrame:
    """Country of each customer's last line; ties by invoice, product, quantity, country."""
    order = F.struct("invoice_date", "invoice", "stock_code", "quantity", "country")
    return (lines.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.max_by("country", order).alias("country")))


def serving_customers(features: DataFrame, countries: DataFrame, payload: Sequence[str],
                      sequences: DataFrame, schema_version: str = "features-v1") -> DataFrame:
    """One row per customer: country, tier, money as DECIMAL, features as a map, last events."""
    entries = [x for name in payload for x in (F.lit(name), F.col(name).cast("double"))]
    tiered = value_tiers(features)
    return (tiered.join(countries, "customer_id", "left")
            .join(sequences.select("customer_id", F.struct("events", "length")
                                   .alias("sequence_payload")), "customer_id", "left")
            .select("customer_id", "country", F.col("cutoff_timestamp").alias("feature_as_of"),
                    F.lit(schema_version).alias("feature_schema_version"),
                    F.create_map(*entries).alias("feature_payload"), "sequence_payload",
                    F.col("net_spend").cast("decimal(18,4)").cast("decimal(18,2)")
                    .alias("net_spend"), "value_tier"))


def serving_transactions(cleaned: DataFrame, customers: DataFrame) -> DataFrame:
    """Lines for serving; customers that are not served become null.

    Lines without a customer skip the join, so the null key never gathers in one task.
    """
    columns = ["invoice", "stock_code", "description", "quantity", "price",
               F.col("invoice_date").alias("invoice_timestamp"), "country", "is_product",
               "is_return", "is_valid_merchandise"]
    known = customers.select("customer_id", F.lit(True).alias("__known"))
    identified = (cleaned.where(F.col("customer_id").isNotNull())
                  .join(known, "customer_id", "left")
                  .select(F.when(F.col("__known"), F.col("customer_id")).alias("customer_id"),
                          *columns))
    anonymous = cleaned.where(F.col("customer_id").isNull()).select("customer_id", *columns)
    return identified.unionByName(anonymous)


def scores_to_append(scores: DataFrame) -> DataFrame:
    """Scores in the precision the score table keeps; a probability outside [0, 1] is an error."""
    p = F.col("churn_probability")
    checked = F.when(p.between(0, 1), p).otherwise(F.raise_error(
        F.lit("churn_probability outside [0, 1]")).cast("double"))
    return scores.withColumns({
        "churn_probability": checked.cast("decimal(12,10)"),
        "predicted_clv_180d": F.col("predicted_clv_180d").cast("decimal(18,4)")})


def current_segments(existing: DataFrame, assigned: DataFrame) -> DataFrame:
    """Upsert by customer: the newest assignment of old and new rows."""
    both = existing.unionByName(assigned)
    return (both.groupBy("customer_id")
            .agg(F.max_by(F.struct(*both.columns), F.struct("assigned_at", "segment_id")).alias("r"))
            .select("r.*"))


def batch_results(scores: DataFrame) -> DataFrame:
    """The fixed export columns; those a scoring run did not produce are null."""
    return scores.select(*[
        (F.col(name) if name in scores.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in BATCH_RESULT_COLUMNS.items()])


def customer_summary(customers: DataFrame, segments: DataFrame, customer_id: str | None = None
                     ) -> DataFrame:
    rows = customers if customer_id is None else customers.where(
        F.col("customer_id") == customer_id)
    return rows.join(segments.select("customer_id", "segment_id", "segment_name"), "customer_id",
                     "left")


def customer_recommendations(recommendations: DataFrame, customer_id: str | None = None,
                             limit: int = 5) -> DataFrame:
    """The first ``limit`` ranks, of one customer or of each; the rank itself cuts, nothing sorts."""
    rows = recommendations.where(F.col("rank") <= limit)
    return rows if customer_id is None else rows.where(F.col("customer_id") == customer_id)


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_id", "segment_name").agg(
        F.count("customer_id").alias("customer_count"))


def _filtered(rows: DataFrame, segment_id: int | None, country: str | None,
              value_tier: str | None) -> DataFrame:
    for name, wanted in (("segment_id", segment_id), ("country", country),
                         ("value_tier", value_tier)):
        if wanted is not None:
            rows = rows.where(F.col(name) == F.lit(wanted))
    return rows


def segment_customers(customers: DataFrame, segments: DataFrame, segment_id: int,
                      country: str | None = None, value_tier: str | None = None,
                      limit: int | None = None) -> DataFrame:
    joined = customers.join(segments.select("customer_id", "segment_id"), "customer_id")
    rows = (_filtered(joined, segment_id, country, value_tier)
            .select("customer_id", "country", "net_spend", "value_tier")
            .orderBy(F.desc("net_spend"), "customer_id"))
    return rows if limit is None else rows.limit(limit)


def monthly_revenue(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signed merchandise revenue per month (and optional further keys)."""
    value = F.col("quantity").cast("decimal(12,0)") * F.col("price")
    return (lines.where("is_valid_merchandise")
            .groupBy(*by, F.date_format("invoice_date", "yyyy-MM").alias("period"))
            .agg(F.sum(value).cast("double").alias("revenue")))


def overview(customers: DataFrame, segments: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of business figures."""
    latest = latest_predictions(scores).agg(
        F.count(F.lit(1)).alias("a"), F.count_if("churn_label").alias("b"))
    kinds = segments.agg(F.count_distinct("segment_id").alias("n")).scalar()
    people = customers.agg(
        F.count(F.lit(1)).alias("total_customers"), F.count_distinct("country").alias("country_count"),
        F.coalesce(F.sum("net_spend"), F.lit(0)).cast("double").alias("total_historical_net_spend"))
    row = latest.select(F.struct("a", "b").alias("s")).scalar()
    return people.withColumn("__s", row).select(
        "total_customers", F.col("__s.a").alias("scored_customers"), kinds.alias("segment_count"),
        "country_count", "total_historical_net_spend",
        F.coalesce(F.try_divide("total_historical_net_spend", "total_customers"), F.lit(0.0))
        .alias("average_historical_net_spend"), F.col("__s.b").alias("high_risk_customers"))


def retention_priority(customers: DataFrame, segments: DataFrame, scores: DataFrame,
                       segment_id: int | None = None, country: str | None = None,
                       value_tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Scaled risk times scaled value, both scaled inside the filtered population."""
    latest = latest_predictions(scores).select(
        "customer_id", "scored_at", "churn_probability", "predicted_clv_180d")
    rows = _filtered(
        customers.select("customer_id", "country", "value_tier")
        .join(segments.select("customer_id", "segment_id", "segment_name"), "customer_id")
        .join(latest, "customer_id"), segment_id, country, value_tier)
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("churn_probability", "predicted_clv_180d")
                      for n, f in (("low", F.min), ("high", F.max))])
    bounds = ends.select(F.struct(*ends.columns).alias("e")).scalar()

    def scaled(name: str) -> Column:
        low, high = F.col(f"__e.low_{name}"), F.col(f"__e.high_{name}")
        return F.when(high == low, 1.0).otherwise(
            F.try_divide((F.col(name) - low).cast("double"), (high - low).cast("double")))

    ranked = (rows.withColumn("__e", bounds)
              .withColumn("normalized_churn_probability", scaled("churn_probability"))
              .withColumn("normalized_predicted_clv_180d", scaled("predicted_clv_180d"))
              .withColumn("retention_priority", F.col("normalized_churn_probability")
                          * F.col("normalized_predicted_clv_180d")).drop("__e")
              .orderBy(F.desc("retention_priority"), F.desc("churn_probability"),
                       F.desc("predicted_clv_180d"), "customer_id"))
    return ranked if limit is None else ranked.limit(limit)


def view_kpis(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Figures of a filtered customer view and of one scored batch."""
    batch = scores.agg(F.avg("churn_probability").alias("r"), F.sum("predicted_clv_180d").alias("v"))
    row = batch.select(F.struct("r", "v").alias("s")).scalar()
    return customers.agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.col("net_spend").cast("double"))
        .alias("mean_spend"), F.count_distinct("country").alias("countries"),
    ).withColumn("__s", row).select("customers", "mean_spend", "countries",
                                    F.col("__s.r").alias("mean_batch_risk"),
                                    F.col("__s.v").alias("total_batch_value"))


def filled_months(revenue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every month between a series' first and last one; absent months have revenue 0."""
    month = F.to_date(F.concat("period", F.lit("-01")))
    dated = revenue.select(*keys, month.alias("month"), "revenue")
    spans = dated.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month")))
                        .alias("month"))
    return grid.join(dated, [*keys, "month"], "left").fillna(0.0, ["revenue"])


def revenue_forecast(revenue: DataFrame, key: str, periods: int = 6, season: int = 12) -> DataFrame:
    """History and forecast of every series: (key, period, revenue, series, method).

    At least two seasons: damped trend with additive season; at least three months: damped trend;
    otherwise the last value repeats. Forecasts never fall below zero. Every series is tried with
    every row of the weight grid, each in a row of its own, and keeps the one with the least squared
    error. A series is one value per month, so its array stays small however large the sales are.
    """
    listed = filled_months(revenue, [key]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("month", "revenue"))).alias("points"))
    series = listed.select(key, "points", F.col("points.revenue").alias("values"), F.size("points").alias("n"))
    long, short = F.col("n") >= 2 * season, F.col("n") >= 3

    def fitted(rows: DataFrame, length: int, method: str) -> DataFrame:
        tried = rows.withColumn("w", F.explode(smoothing.grid_column(bool(length)))).withColumn(
            "state", smoothing.smoothed(F.col("values"), F.col("w"), length))
        best = tried.groupBy(key).agg(
            F.min_by(F.struct("points", "state", "w"), F.struct("state.squares", "w.place")).alias("b"))
        return best.select(key, "b.points", smoothing.ahead(
            F.col("b.state"), F.col("b.w.damp"), periods, length).alias("future"), F.lit(method).alias("method"))

    every = (fitted(series.where(long), season, f"additive trend and {season}-month season")
             .unionByName(fitted(series.where(~long & short), 0, "damped trend"))
             .unionByName(series.where(~short).select(
                 key, "points", F.array_repeat(F.element_at("values", -1), periods).alias("future"),
                 F.lit("last value").alias("method"))))
    last = F.element_at("points", -1)["month"]
    known = F.transform("points", lambda p: F.struct(
        p["month"].alias("month"), p["revenue"].alias("revenue"), F.lit("history").alias("series")))
    coming = F.transform("future", lambda v, i: F.struct(
        F.add_months(last, (i + 1).cast("int")).alias("month"), F.greatest(v, F.lit(0.0)).alias("revenue"),
        F.lit("forecast").alias("series")))
    return every.select(key, "method", F.explode(F.concat(known, coming)).alias("p")).select(
        key, F.date_format("p.month", "yyyy-MM").alias("period"), "p.revenue", "p.series", "method")

"""Serving tables and their questions as queries; score logs stand in from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions import smoothing
from basketlake.functions.columns import r6
from basketlake.functions.timing import stamp
from basketlake.operators import serving, sequences
from basketlake.plans.catalogue.evaluation import shown
from basketlake.plans.catalogue.recommending import recommendations, segment_map
from basketlake.plans.catalogue.registry import block, query
from basketlake.sources.adapter import table
from basketlake.sources.sinks import write_table

_STAMP = "'%Y-%m-%d %H:%M:%S'"

block("score_log", """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS customer_id, ts AS scored_at,
       (CAST(round(value * 100) AS BIGINT) % 1000) / 1000.0 AS churn_probability,
       (CAST(round(value * 100) AS BIGINT) % 1000) >= 500 AS churn_label,
       CAST(round(value * 100) AS BIGINT) / 10.0 AS predicted_clv_180d FROM events""")


def score_log(ws):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(ws.spark, ws.folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("scored_at"), ((cents % 1000) / 1000.0).alias("churn_probability"),
        (cents % 1000 >= 500).alias("churn_label"), (cents / 10.0).alias("predicted_clv_180d"))


block("tiers", """
SELECT customer_id, CASE WHEN net_spend <= a THEN 'low' WHEN net_spend <= b THEN 'medium'
                         ELSE 'high' END AS value_tier, net_spend
FROM labelled, (SELECT quantile_cont(net_spend, 1.0 / 3) AS a, quantile_cont(net_spend, 2.0 / 3) AS b
                FROM labelled)""")
block("last_country", """
SELECT customer_id, country FROM (
  SELECT customer_id, country, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date DESC,
           invoice DESC, stock_code DESC, quantity DESC, country DESC) AS r
  FROM cleaned WHERE customer_id IS NOT NULL) WHERE r = 1""")
block("served", """
SELECT customer_id, country, value_tier,
       CAST(CAST(net_spend AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS net_spend FROM tiers LEFT JOIN last_country USING (customer_id)""")
block("served_segments", """
SELECT customer_id, segment_id, 'Segment ' || segment_id AS segment_name FROM segment_map""")


def served(ws):
    def build():
        past = ws.events.where(F.col("invoice_date") < ws.churn_cutoff)
        return serving.serving_customers(
            ws.churn_features, serving.latest_country(ws.clean), ws.feature_names,
            sequences.latest_sequences(past, ws.churn_cutoff, ws.settings.sequences))
    return ws.stage("serving_customers", build)


def segments(ws):
    return segment_map(ws).withColumn(
        "segment_name", F.concat(F.lit("Segment "), F.col("segment_id").cast("string")))


@query("a12_serving_customers", """
SELECT s.customer_id, country, value_tier, CAST(s.net_spend AS DOUBLE) AS net_spend,
       CASE WHEN n IS NULL THEN 0 ELSE least(n, 20) END AS n_events, round(recency_days, 6) AS recency_days
FROM served s JOIN labelled USING (customer_id) LEFT JOIN (
  SELECT customer_id, count(*) AS n FROM seq_events, cutoffs WHERE invoice_date < churn_cutoff
  GROUP BY customer_id HAVING count(*) >= 2) e USING (customer_id)""")
def serving_customers(ws):
    return served(ws).select(
        "customer_id", "country", "value_tier", F.col("net_spend").cast("double").alias("net_spend"),
        F.coalesce("sequence_payload.length", F.lit(0)).cast("bigint").alias("n_events"),
        r6(F.col("feature_payload")["recency_days"]).alias("recency_days"))


@query("a12_serving_transactions", """
SELECT CASE WHEN customer_id IN (SELECT customer_id FROM served) THEN customer_id END AS customer_id,
       country, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units FROM cleaned GROUP BY 1, 2""")
def serving_transactions(ws):
    lines = serving.serving_transactions(ws.clean, served(ws))
    return lines.groupBy("customer_id", "country").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"))


@query("a13_score_append", f"""
SELECT id, customer_id, strftime(scored_at, {_STAMP}) AS scored_at,
       CAST(CAST(churn_probability AS DECIMAL(12,10)) AS DOUBLE) AS churn_probability,
       CAST(CAST(predicted_clv_180d AS DECIMAL(18,4)) AS DOUBLE) AS predicted_clv_180d FROM score_log""")
def score_append(ws):
    path = f"{ws.root}/score_log"
    # Two runs append to one table: a first batch of scores, then the later ones.
    edge = F.lit("2024-01-10").cast("timestamp_ntz")
    rows = serving.scores_to_append(score_log(ws))
    write_table(rows.where(F.col("scored_at") < edge), path)
    write_table(rows.where(F.col("scored_at") >= edge), path, mode="append")
    return ws.spark.read.parquet(path).select(
        "id", "customer_id", stamp(F.col("scored_at")).alias("scored_at"),
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.col("predicted_clv_180d").cast("double").alias("predicted_clv_180d"))


@query("a13_current_segments", f"""
SELECT customer_id, segment_id, strftime(assigned_at, {_STAMP}) AS assigned_at FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY assigned_at DESC, segment_id DESC) AS r
  FROM (SELECT customer_id, scored_at AS assigned_at, CAST(id % 5 AS INTEGER) AS segment_id
        FROM score_log)) WHERE r = 1""")
def current_segments(ws):
    rows = score_log(ws).select("customer_id", F.col("scored_at").alias("assigned_at"),
                                (F.col("id") % 5).cast("int").alias("segment_id"))
    edge = F.lit("2024-01-10").cast("timestamp_ntz")
    return serving.current_segments(
        rows.where(F.col("assigned_at") < edge), rows.where(F.col("assigned_at") >= edge)).select(
        "customer_id", "segment_id", stamp(F.col("assigned_at")).alias("assigned_at"))


@query("a14_batch_export", """
SELECT id AS prediction_id, customer_id, round(churn_probability, 6) AS churn_probability, churn_label,
       predicted_clv_180d, CAST(NULL AS VARCHAR) AS segment_name, CAST(NULL AS VARCHAR) AS model_version
FROM score_log""")
def batch_export(ws):
    rows = serving.batch_results(score_log(ws).withColumnRenamed("id", "prediction_id"))
    return rows.select("prediction_id", "customer_id", r6(F.col("churn_probability"))
                       .alias("churn_probability"), "churn_label", "predicted_clv_180d",
                       "segment_name", "model_version")


block("latest", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY scored_at DESC, id DESC)
                 AS r FROM score_log) WHERE r = 1""")


@query("l1_latest_prediction", """
SELECT customer_id, id, churn_probability, churn_label, predicted_clv_180d FROM latest""")
def latest_prediction(ws):
    return serving.latest_predictions(score_log(ws)).select(
        "customer_id", "id", "churn_probability", "churn_label", "predicted_clv_180d")


@query("l2_customer_summary", """
SELECT customer_id, country, value_tier, CAST(net_spend AS DOUBLE) AS net_spend,
       coalesce(segment_id, -1) AS segment_id, segment_name
FROM served LEFT JOIN served_segments USING (customer_id)""")
def customer_summary(ws):
    return serving.customer_summary(served(ws), segments(ws)).select(
        "customer_id", "country", "value_tier", F.col("net_spend").cast("double").alias("net_spend"),
        F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), "segment_name")


@query("l3_customer_recommendations", """
SELECT customer_id, stock_code, rank, round(score, 4) AS score FROM recommended WHERE rank <= 3""")
def customer_recommendations(ws):
    return serving.customer_recommendations(recommendations(ws), limit=3).select(
        "customer_id", "stock_code", "rank", F.round("score", 4).alias("score"))


@query("l4_segment_summary", """
SELECT segment_id, segment_name, count(*) AS customer_count FROM served_segments GROUP BY ALL""")
def segment_summary(ws):
    return serving.segment_summary(segments(ws))


@query("l5_segment_customers", """
SELECT customer_id, country, CAST(net_spend AS DOUBLE) AS net_spend, value_tier
FROM served JOIN served_segments USING (customer_id) WHERE segment_id = 2 AND value_tier = 'high'
ORDER BY served.net_spend DESC, customer_id""")
def segment_customers(ws):
    rows = serving.segment_customers(served(ws), segments(ws), 2, value_tier="high")
    return rows.withColumn("net_spend", F.col("net_spend").cast("double"))


block("monthly", """
SELECT strftime(invoice_date, '%Y-%m') AS period, CAST(sum(quantity * price) AS DOUBLE) AS revenue
FROM cleaned WHERE is_valid_merchandise GROUP BY 1""")


@query("l6_monthly_revenue", "SELECT period, revenue FROM monthly")
def monthly_revenue(ws):
    return serving.monthly_revenue(ws.clean)


@query("l7_overview_kpis", """
SELECT (SELECT count(*) FROM served) AS total_customers,
       (SELECT count(*) FROM latest) AS scored_customers,
       (SELECT count(DISTINCT segment_id) FROM served_segments) AS segment_count,
       (SELECT count(DISTINCT country) FROM served) AS country_count,
       (SELECT CAST(sum(net_spend) AS DOUBLE) FROM served) AS total_historical_net_spend,
       round((SELECT CAST(sum(net_spend) AS DOUBLE) / count(*) FROM served), 6)
         AS average_historical_net_spend,
       (SELECT count(*) FROM latest WHERE churn_label) AS high_risk_customers""")
def overview(ws):
    return shown(serving.overview(served(ws), segments(ws), score_log(ws)))


def _priority_sql(where: str) -> str:
    return f"""
WITH pop AS (SELECT customer_id, value_tier, segment_id, churn_probability AS p, predicted_clv_180d AS v
  FROM served JOIN served_segments USING (customer_id) JOIN latest USING (customer_id) WHERE {where}),
ends AS (SELECT min(p) AS p0, max(p) AS p1, min(v) AS v0, max(v) AS v1 FROM pop),
scaled AS (SELECT *, CASE WHEN p1 = p0 THEN 1.0 ELSE (p - p0) / (p1 - p0) END AS np,
                  CASE WHEN v1 = v0 THEN 1.0 ELSE (v - v0) / (v1 - v0) END AS nv FROM pop, ends)
SELECT customer_id, value_tier, segment_id, round(p, 6) AS churn_probability,
       round(v, 6) AS predicted_clv_180d, round(np, 6) AS normalized_churn_probability,
       round(nv, 6) AS normalized_predicted_clv_180d, round(np * nv, 6) AS retention_priority
FROM scaled ORDER BY np * nv DESC, p DESC, v DESC, customer_id"""


def _priority(ws, **filters):
    return shown(serving.retention_priority(
        served(ws), segments(ws), score_log(ws), **filters).select(
        "customer_id", "value_tier", "segment_id", "churn_probability", "predicted_clv_180d",
        "normalized_churn_probability", "normalized_predicted_clv_180d", "retention_priority"))


@query("l8_retention_priority", _priority_sql("TRUE"))
def retention_priority(ws):
    return _priority(ws)


@query("l8_retention_priority_filtered", _priority_sql("value_tier = 'high'"))
def retention_priority_filtered(ws):
    return _priority(ws, value_tier="high")


@query("l9_value_tiers", "SELECT customer_id, value_tier FROM tiers")
def value_tiers(ws):
    return serving.value_tiers(ws.churn_features).select("customer_id", "value_tier")


@query("l10_latest_country", "SELECT customer_id, country FROM last_country")
def latest_country(ws):
    return serving.latest_country(ws.clean)


# The recurrences of the forecast, one row a series, grid row and month.
block("series_months", """
SELECT key, m + to_months(CAST(i AS INTEGER)) AS month, i AS t, n FROM (
  SELECT key, min(month) AS m, datediff('month', min(month), max(month)) + 1 AS n FROM series_revenue GROUP BY key),
  (SELECT unnest(range(0, 2000)) AS i) WHERE i < n""")
block("series_values", """
SELECT key, n, max(month) AS last, list(coalesce(revenue, 0.0) ORDER BY t) AS v
FROM series_months LEFT JOIN series_revenue USING (key, month) GROUP BY key, n""")
block("weight_grid", f"""
SELECT seasonal, lw, tw, sw, d, row_number() OVER (PARTITION BY seasonal ORDER BY lw, tw, sw, d) AS place
FROM (SELECT unnest({list(smoothing.LEVELS)}::DOUBLE[]) AS lw), (SELECT unnest({list(smoothing.TRENDS)}::DOUBLE[]) AS tw),
     (SELECT TRUE AS seasonal, unnest({list(smoothing.SEASONS)}::DOUBLE[]) AS sw UNION ALL SELECT FALSE, 0.0),
     (SELECT unnest({list(smoothing.DAMPINGS)}::DOUBLE[]) AS d)""")
block("smoothing_run", """
SELECT key, seasonal, place, lw, tw, sw, d, n, v, last, CAST(0 AS BIGINT) AS t,
       CASE WHEN seasonal THEN list_avg(v[1:12]) ELSE v[1] END AS level,
       CASE WHEN seasonal THEN (list_avg(v[13:24]) - list_avg(v[1:12])) / 12 ELSE v[2] - v[1] END AS slope,
       CASE WHEN seasonal THEN list_transform(v[1:12], lambda x: x - list_avg(v[1:12])) ELSE [0.0::DOUBLE] END AS ring,
       0.0::DOUBLE AS squares
FROM series_values JOIN weight_grid ON seasonal = (n >= 24) WHERE n >= 3
UNION ALL
SELECT key, seasonal, place, lw, tw, sw, d, n, v, last, t + 1, now,
       tw * (now - level) + (1 - tw) * d * slope,
       CASE WHEN seasonal THEN list_append(ring[2:12], sw * (x - now) + (1 - sw) * ring[1]) ELSE ring END,
       squares + (x - (level + d * slope + ring[1])) * (x - (level + d * slope + ring[1]))
FROM (SELECT *, v[t + 1] AS x, lw * (v[t + 1] - ring[1]) + (1 - lw) * (level + d * slope) AS now
      FROM smoothing_run WHERE t < n)""", recursive=True)
block("series_forecast", """
SELECT key, last + to_months(CAST(h AS INTEGER)) AS month, method, greatest(CASE WHEN method = 'last value' THEN level
         ELSE level + list_sum(list_transform(range(1, h + 1), lambda i: d ** i)) * slope
              + CASE WHEN seasonal THEN ring[h] ELSE 0 END END, 0.0) AS revenue
FROM (SELECT key, last, seasonal, d, level, slope, ring,
             CASE WHEN seasonal THEN 'additive trend and 12-month season' ELSE 'damped trend' END AS method
      FROM smoothing_run WHERE t = n QUALIFY row_number() OVER (PARTITION BY key ORDER BY squares, place) = 1
      UNION ALL SELECT key, last, FALSE, 0.0, v[-1], 0.0, [0.0], 'last value' FROM series_values WHERE n < 3),
  (SELECT unnest(range(1, 7)) AS h)""")
block("series_rows", """
SELECT key, strftime(month, '%Y-%m') AS period, revenue, 'forecast' AS series, method FROM series_forecast
UNION ALL SELECT key, strftime(month, '%Y-%m'), coalesce(revenue, 0.0), 'history', method
FROM series_months LEFT JOIN series_revenue USING (key, month)
JOIN (SELECT DISTINCT key, method FROM series_forecast) USING (key)""")
block("series_revenue", """
SELECT country AS key, date_trunc('month', invoice_date) AS month, CAST(sum(quantity * price) AS DOUBLE) AS revenue
FROM cleaned WHERE is_valid_merchandise GROUP BY 1, 2""")


@query("l13_revenue_forecast", """
SELECT key AS country, period, CASE WHEN series = 'history' THEN revenue ELSE round(revenue, 2) END AS revenue,
       series, method FROM series_rows""")
def revenue_forecast(ws):
    rows = serving.revenue_forecast(serving.monthly_revenue(ws.clean, ["country"]), "country")
    return rows.withColumn("revenue", F.when(F.col("series") == "history", F.col("revenue")).otherwise(
        F.round("revenue", 2)))


# Customers bought in few months: many have too short a series for any trend.
@query("l13_last_value_forecast", """
SELECT customer_id, strftime(m + to_months(CAST(h AS INTEGER)), '%Y-%m') AS period, revenue FROM (
  SELECT customer_id, date_trunc('month', invoice_date) AS m,
         greatest(CAST(sum(quantity * price) AS DOUBLE), 0.0) AS revenue,
         datediff('month', min(date_trunc('month', invoice_date)) OVER (PARTITION BY customer_id),
                  max(date_trunc('month', invoice_date)) OVER (PARTITION BY customer_id)) + 1 AS n
  FROM cleaned WHERE is_valid_merchandise AND customer_id IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY m DESC) = 1 AND n < 3),
  (SELECT unnest(range(1, 7)) AS h)""")
def last_value_forecast(ws):
    bought = ws.clean.where("customer_id is not null")
    rows = serving.revenue_forecast(serving.monthly_revenue(bought, ["customer_id"]), "customer_id")
    return rows.where("series = 'forecast' and method = 'last value'").select("customer_id", "period", "revenue")


@query("l14_view_kpis", """
SELECT count(*) AS customers, round(avg(CAST(net_spend AS DOUBLE)), 4) AS mean_spend,
       count(DISTINCT country) AS countries,
       (SELECT round(avg(churn_probability), 6) FROM latest) AS mean_batch_risk,
       (SELECT round(sum(predicted_clv_180d), 4) FROM latest) AS total_batch_value
FROM served WHERE value_tier = 'medium'""")
def view_kpis(ws):
    row = serving.view_kpis(served(ws).where("value_tier = 'medium'"),
                            serving.latest_predictions(score_log(ws)))
    return row.select("customers", F.round("mean_spend", 4).alias("mean_spend"), "countries",
                      r6(F.col("mean_batch_risk")).alias("mean_batch_risk"),
                      F.round("total_batch_value", 4).alias("total_batch_value"))

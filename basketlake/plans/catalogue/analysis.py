"""Exploratory summaries as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions.columns import r6
from basketlake.operators import eda, features
from basketlake.plans.catalogue.registry import block, query
from basketlake.plans.workspace import CATEGORIES

block("labelled", """
SELECT feature_base.*, churn, partition_name FROM feature_base JOIN churn_flags USING (customer_id)
JOIN split_table USING (customer_id)""")
block("rfm_long", " UNION ALL ".join(
    f"SELECT churn, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM labelled"
    for c in eda.RFM_COLUMNS))


@query("g1_rfm_describe", """
SELECT feature, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       round(min(value), 4) AS min, round(max(value), 4) AS max,
       round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.10), 4) AS p10,
       round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.50), 4) AS p50,
       round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.90), 4) AS p90,
       round(quantile_cont(value, 0.99), 4) AS p99 FROM rfm_long GROUP BY feature""")
def rfm_describe(ws):
    table = eda.describe(ws.churn_table)
    return table.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c)
                          for c, t in table.dtypes])


@query("g2_churn_comparison", """
SELECT churn, feature, round(median(value), 4) AS median, round(avg(value), 4) AS mean
FROM rfm_long GROUP BY churn, feature""")
def churn_comparison(ws):
    return eda.by_label(ws.churn_table).select(
        "churn", "feature", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"))


@query("g3_class_balance", """
SELECT churn, count(*) AS customers,
       round(count(*) / CAST((SELECT count(*) FROM churn_flags) AS DOUBLE), 6) AS proportion
FROM churn_flags GROUP BY churn""")
def class_balance(ws):
    return eda.class_balance(ws.churn_table).withColumn("proportion", r6(F.col("proportion")))


block("countries", """
SELECT country, count(DISTINCT invoice) AS orders,
       count(DISTINCT customer_id) AS identified_customers,
       CAST(sum(gross_positive_value) AS DOUBLE) AS gross_revenue,
       CAST(sum(quantity) AS BIGINT) AS units
FROM cleaned WHERE is_positive_purchase GROUP BY country ORDER BY gross_revenue DESC, country LIMIT 15""")


@query("g4_country_summary", "SELECT * FROM countries")
def country_summary(ws):
    return eda.country_summary(ws.clean).withColumn(
        "gross_revenue", F.col("gross_revenue").cast("double"))


block("months", """
SELECT strftime(invoice_date, '%Y-%m') AS year_month,
       CAST(quarter(invoice_date) AS INTEGER) AS quarter, count(DISTINCT invoice) AS orders,
       CAST(sum(gross_positive_value) AS DOUBLE) AS gross_revenue,
       CAST(sum(quantity) AS BIGINT) AS units
FROM cleaned WHERE is_positive_purchase GROUP BY 1, 2""")


@query("g5_seasonality", "SELECT * FROM months")
def seasonality(ws):
    return eda.seasonality(ws.clean).withColumn(
        "gross_revenue", F.col("gross_revenue").cast("double"))


@query("g6_quality_flag_summary", " UNION ALL ".join(
    f"SELECT '{f}' AS quality_flag, count(*) FILTER ({f}) AS rows, "
    f"round(count(*) FILTER ({f}) / CAST(count(*) AS DOUBLE), 6) AS proportion FROM cleaned"
    for f in eda.AUDIT_FLAGS))
def flag_summary(ws):
    return eda.flag_summary(ws.clean).withColumn("proportion", r6(F.col("proportion")))


@query("g7_hypothesis_facts", """
SELECT 'median_recency_days_' || churn AS fact, printf('%.1f', median(recency_days)) AS value
FROM labelled GROUP BY churn
UNION ALL SELECT 'median_frequency_orders_' || churn,
  printf('%.1f', median(CAST(frequency_orders AS DOUBLE))) FROM labelled GROUP BY churn
UNION ALL SELECT 'leading_country', arg_max(country, gross_revenue) FROM countries
UNION ALL SELECT 'leading_country_share', printf('%.4f', max(gross_revenue) / sum(gross_revenue))
  FROM countries
UNION ALL SELECT 'peak_month', arg_max(year_month, gross_revenue) FROM months""")
def hypothesis_facts(ws):
    return eda.hypothesis_facts(ws.clean, ws.churn_table)


block("hist_long", """
SELECT 'recency' AS feature, CAST(recency_days AS DOUBLE) AS v FROM labelled
UNION ALL SELECT 'log_frequency', ln(1 + frequency_orders) FROM labelled
UNION ALL SELECT 'log_spend', ln(1 + net_spend) FROM labelled""")


@query("g8_histograms", """
SELECT feature, CAST(least(floor((v - low) / (high - low) * 40), 39) AS INTEGER) AS bin, count(*) AS n
FROM hist_long JOIN (SELECT feature, min(v) AS low, max(v) AS high FROM hist_long GROUP BY feature)
  USING (feature) GROUP BY 1, 2""")
def histograms(ws):
    return eda.histogram(ws.churn_table, {
        "recency": "recency_days", "log_frequency": "ln(1 + frequency_orders)",
        "log_spend": "ln(1 + net_spend)"}).select("feature", "bin", "n")


# Every numeric candidate of the feature table, in the SQL's own spelling.
_AFFINITIES = ("category_affinity_unknown", *(f"category_affinity_{i:02d}" for i in range(CATEGORIES)))
_CORRELATED = (*features.FEATURE_NOTES, *_AFFINITIES)
block("numeric_features", f"""
SELECT labelled.*, net_spend AS historical_customer_value, engagement_score, unique_product_count,
       coalesce(mean_product_popularity, 0) AS mean_product_popularity,
       coalesce(median_product_popularity, 0) AS median_product_popularity,
       coalesce(max_product_popularity, 0) AS max_product_popularity,
       coalesce(rare_product_share, 0) AS rare_product_share,
       {", ".join(f"coalesce({c}, 0) AS {c}" for c in _AFFINITIES)}
FROM labelled JOIN engagement USING (customer_id)
JOIN (SELECT customer_id, count(DISTINCT stock_code) AS unique_product_count FROM positive GROUP BY 1)
  USING (customer_id)
LEFT JOIN pop_mix USING (customer_id) LEFT JOIN affinity USING (customer_id)""")
block("correlation_rows", "SELECT unnest([" + ", ".join(
    f"struct_pack(feature_a := '{a}', feature_b := '{b}', r := CASE WHEN var_pop(CAST({a} AS DOUBLE)) > 0 "
    f"AND var_pop(CAST({b} AS DOUBLE)) > 0 THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END)"
    for a in _CORRELATED for b in _CORRELATED)
    + "], recursive := true) FROM numeric_features WHERE partition_name = 'train'")


def _matrix(ws):
    return eda.correlations(ws.churn_table.where("partition = 'train'"), ws.feature_names)


@query("g9_correlation_matrix", """
SELECT feature_a, feature_b, round(r, 6) AS correlation FROM correlation_rows""")
def correlation_matrix(ws):
    return _matrix(ws).withColumn("correlation", r6(F.col("correlation")))


@query("g10_high_correlation_pairs", """
SELECT feature_a, feature_b, round(r, 6) AS correlation, round(abs(r), 6) AS absolute_correlation
FROM correlation_rows WHERE feature_a < feature_b AND abs(r) >= 0.5""")
def high_correlation_pairs(ws):
    pairs = eda.correlated_pairs(_matrix(ws), 0.5)
    return pairs.select("feature_a", "feature_b", r6(F.col("correlation")).alias("correlation"),
                        r6(F.col("absolute_correlation")).alias("absolute_correlation"))

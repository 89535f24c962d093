"""Snapshots, labels, splits, product artifacts and customer features as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions.columns import r6
from basketlake.functions.timing import stamp
from basketlake.operators import features, products, rolling, snapshots
from basketlake.plans.catalogue.registry import block, query
from basketlake.plans.workspace import CATEGORIES, MARKDOWN_RATIO

_STAMP = "'%Y-%m-%d %H:%M:%S'"


# --- snapshots and labels -----------------------------------------------------------------------
@query("c1_canonical_cutoffs", f"""
SELECT strftime(observation_end, {_STAMP}) AS observation_end,
       strftime(churn_cutoff, {_STAMP}) AS churn_cutoff, strftime(clv_cutoff, {_STAMP}) AS clv_cutoff
FROM cutoffs""")
def cutoffs(ws):
    found = snapshots.canonical_cutoffs(ws.clean)
    return found.select(*[stamp(F.col(c)).alias(c) for c in found.columns])


block("two_snapshots", """
SELECT customer_id, churn_cutoff AS cutoff FROM population, cutoffs
UNION ALL SELECT customer_id, clv_cutoff FROM population, cutoffs""")


def _two_snapshots(ws):
    return ws.customers.withColumn("cutoff_timestamp", ws.churn_cutoff).unionByName(
        ws.customers.withColumn("cutoff_timestamp", ws.clv_cutoff))


@query("c2_snapshot_history", f"""
SELECT customer_id, strftime(cutoff, {_STAMP}) AS cutoff, count(*) AS n_lines,
       CAST(sum(quantity) AS BIGINT) AS units
FROM cleaned JOIN two_snapshots USING (customer_id) WHERE invoice_date < cutoff GROUP BY ALL""")
def snapshot_history(ws):
    return (snapshots.history(ws.clean, _two_snapshots(ws)).groupBy("customer_id", "cutoff_timestamp")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))
            .select("customer_id", stamp(F.col("cutoff_timestamp")).alias("cutoff"),
                    "n_lines", "units"))


@query("c3_target_window", f"""
SELECT customer_id, strftime(cutoff, {_STAMP}) AS cutoff, count(*) AS n_lines,
       CAST(sum(quantity) AS BIGINT) AS units
FROM cleaned JOIN two_snapshots USING (customer_id)
WHERE invoice_date >= cutoff AND invoice_date <= cutoff + INTERVAL 90 DAY GROUP BY ALL""")
def target_window(ws):
    return (snapshots.target_window(ws.clean, _two_snapshots(ws), 90)
            .groupBy("customer_id", "cutoff_timestamp")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))
            .select("customer_id", stamp(F.col("cutoff_timestamp")).alias("cutoff"),
                    "n_lines", "units"))


@query("c4_eligible_customers", "SELECT customer_id FROM population")
def eligible_customers(ws):
    return snapshots.eligible_customers(ws.clean, ws.clv_cutoff)


@query("c5_churn_labels", "SELECT customer_id, churn FROM churn_flags")
def churn_labels(ws):
    return snapshots.churn_labels(ws.clean, ws.customers, ws.churn_cutoff)


block("clv_values", """
SELECT customer_id, greatest(coalesce(CAST(net AS DOUBLE), 0.0), 0.0) AS clv_180d_target
FROM population LEFT JOIN (
  SELECT customer_id, sum(signed_merchandise_value) AS net FROM cleaned, cutoffs
  WHERE is_valid_merchandise AND customer_id IS NOT NULL AND invoice_date >= clv_cutoff
    AND invoice_date <= clv_cutoff + INTERVAL 180 DAY GROUP BY customer_id) USING (customer_id)""")


@query("c6_clv_targets", "SELECT customer_id, clv_180d_target FROM clv_values")
def clv_targets(ws):
    return snapshots.clv_targets(ws.clean, ws.customers, ws.clv_cutoff)


@query("c7_customer_split", """
SELECT customer_id, partition_name AS "partition", 42 AS split_seed,
       'customer-split-v1' AS split_version FROM split_table""")
def customer_split(ws):
    return snapshots.split_customers(snapshots.eligible_customers(ws.clean, ws.clv_cutoff))


@query("c8_split_validation", """
SELECT 'null_customer' AS rule, count(*) FILTER (customer_id IS NULL) AS failures FROM split_table
UNION ALL SELECT 'repeated_customer', count(*) - count(DISTINCT customer_id) FROM split_table
UNION ALL SELECT 'unknown_partition', count(*) FILTER (
  partition_name NOT IN ('train', 'validation', 'test')) FROM split_table
UNION ALL SELECT 'absent_partition', 3 - count(DISTINCT partition_name) FROM split_table""")
def split_validation(ws):
    return snapshots.split_violations(ws.split)


@query("c9_supervised_partitions", """
SELECT customer_id, churn, partition_name AS "partition" FROM churn_flags
JOIN split_table USING (customer_id) WHERE partition_name IN ('train', 'validation')""")
def supervised_partitions(ws):
    return snapshots.development_rows(ws.churn_table).select("customer_id", "churn", "partition")


@query("c10_labelled_table", """
SELECT count(*) AS customers, CAST(0 AS BIGINT) AS failures FROM population""")
def labelled_table(ws):
    return snapshots.one_to_one_violations(ws.churn_features, snapshots.churn_labels(
        ws.clean, ws.customers, ws.churn_cutoff), ws.split)


# --- products -----------------------------------------------------------------------------------
block("descriptions", """
SELECT stock_code, description_normalized, description_count, latest_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY description_count DESC,
      latest_seen DESC, description_normalized) AS r
  FROM (SELECT stock_code, description_normalized, count(*) AS description_count,
               max(invoice_date) AS latest_seen FROM training
        WHERE is_product AND description_normalized IS NOT NULL GROUP BY ALL)) WHERE r = 1""")


@query("d1_canonical_descriptions", f"""
SELECT stock_code, description_normalized, description_count,
       strftime(latest_seen, {_STAMP}) AS latest_seen FROM descriptions""")
def canonical_descriptions(ws):
    return products.modal_descriptions(ws.training_lines).withColumn(
        "latest_seen", stamp(F.col("latest_seen")))


block("words", r"""
SELECT stock_code, regexp_extract_all(description_normalized, '[A-Za-z0-9_]{2,}') AS w
FROM descriptions""")
block("term_counts", """
SELECT stock_code, term, count(*) AS tf FROM (
  SELECT stock_code, unnest(w) AS term FROM words
  UNION ALL
  SELECT stock_code, w[i] || ' ' || w[i + 1] FROM (
    SELECT stock_code, w, unnest(range(1, len(w))) AS i FROM words)) GROUP BY ALL""")
block("vocabulary", """
SELECT term, sum(tf) AS total, count(*) AS df FROM term_counts GROUP BY term
ORDER BY total DESC, term LIMIT 5000""")


@query("d2_tfidf", """
SELECT stock_code, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY stock_code)), 6) AS weight
FROM (SELECT stock_code, term,
             (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM descriptions)) / (1.0 + df)) + 1) AS raw
      FROM term_counts JOIN vocabulary USING (term))""")
def tfidf(ws):
    weights = products.tfidf(products.modal_descriptions(ws.training_lines))
    return weights.select("stock_code", "term", r6(F.col("weight")).alias("weight"))


@query("d7_reference_prices", """
SELECT stock_code, round(reference_price, 6) AS reference_price, reference_observations
FROM prices""")
def reference_prices(ws):
    return products.reference_prices(ws.training_lines).withColumn(
        "reference_price", r6(F.col("reference_price")))


@query("d8_product_popularity", """
SELECT stock_code, training_order_frequency, round(product_popularity, 9) AS product_popularity,
       is_rare_product FROM popular""")
def product_popularity(ws):
    return products.popularity(ws.training_lines).withColumn(
        "product_popularity", F.round("product_popularity", 9))


# --- features at the churn cutoff ---------------------------------------------------------------
def _past(ws):
    return features.customer_history(ws.clean, ws.customers, ws.churn_cutoff)


def _baskets(ws):
    return features.baskets(_past(ws))


def _orders(ws):
    return features.orders(_baskets(ws))


def _rounded(frame, keep=("customer_id",)):
    """Doubles at six digits; keys and counts as they are."""
    return frame.select(*[r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c)
                          for c, t in frame.dtypes])


@query("e1_order_rollup", f"""
SELECT customer_id, invoice, strftime(invoice_date, {_STAMP}) AS invoice_date,
       CAST(order_value AS DOUBLE) AS order_value, basket_units, distinct_products
FROM order_rows""")
def order_rollup(ws):
    return _orders(ws).select(
        "customer_id", "invoice", stamp(F.col("invoice_date")).alias("invoice_date"),
        F.col("order_value").cast("double").alias("order_value"), "basket_units",
        "distinct_products")


@query("e2_rfm_basket", """
SELECT customer_id, frequency_orders, round(gross_spend, 6) AS gross_spend,
       round(avg_order_value, 6) AS avg_order_value, round(avg_basket_units, 6) AS avg_basket_units,
       round(avg_distinct_products_per_order, 6) AS avg_distinct_products_per_order FROM rfm""")
def rfm_basket(ws):
    return _rounded(features.rfm(_orders(ws), ws.churn_cutoff).drop(
        "recency_days", "customer_tenure_days"))


@query("e3_recency_tenure", """
SELECT customer_id, round(recency_days, 6) AS recency_days,
       round(customer_tenure_days, 6) AS customer_tenure_days FROM rfm""")
def recency_tenure(ws):
    return _rounded(features.rfm(_orders(ws), ws.churn_cutoff).select(
        "customer_id", "recency_days", "customer_tenure_days"))


@query("e4_unique_products", """
SELECT customer_id, count(DISTINCT stock_code) AS unique_product_count FROM positive
GROUP BY customer_id""")
def unique_products(ws):
    return features.variety(_baskets(ws))


@query("e5_net_spend", """
SELECT customer_id, round(net_spend, 6) AS net_spend,
       round(net_spend, 6) AS historical_customer_value FROM net""")
def net_spend(ws):
    return _rounded(features.net_spend(_past(ws)).drop("return_rate"))


@query("e6_purchase_gaps", """
SELECT customer_id, round(mean_interpurchase_gap_days, 6) AS mean_interpurchase_gap_days,
       round(variance_interpurchase_gap_days, 6) AS variance_interpurchase_gap_days FROM gap_stats""")
def purchase_gaps(ws):
    return _rounded(features.gaps(_orders(ws)))


@query("e7_frequency_trend", """
SELECT customer_id, round(purchase_frequency_trend, 6) AS purchase_frequency_trend FROM trend""")
def frequency_trend(ws):
    return _rounded(features.weekly_trend(_orders(ws), ws.churn_cutoff))


@query("e8_seasonality", """
SELECT customer_id, round(seasonal_purchase_concentration, 6) AS seasonal_purchase_concentration
FROM season""")
def seasonality(ws):
    return _rounded(features.seasonality(_orders(ws)))


@query("e9_return_rate", "SELECT customer_id, round(return_rate, 6) AS return_rate FROM net")
def return_rate(ws):
    return _rounded(features.net_spend(_past(ws)).select("customer_id", "return_rate"))


@query("e10_markdown_affinity", """
SELECT customer_id, round(markdown_affinity_proxy, 6) AS markdown_affinity_proxy FROM markdown""")
def markdown_affinity(ws):
    return _rounded(features.markdown_affinity(_baskets(ws), ws.prices, MARKDOWN_RATIO))


@query("e11_popularity_mix", """
SELECT customer_id, round(mean_product_popularity, 9) AS mean_product_popularity,
       round(median_product_popularity, 9) AS median_product_popularity,
       round(max_product_popularity, 9) AS max_product_popularity,
       round(CAST(rare_product_share AS DOUBLE), 6) AS rare_product_share FROM pop_mix""")
def popularity_mix(ws):
    mix = features.popularity_mix(_baskets(ws), ws.popular)
    return mix.select("customer_id", *[
        F.round(c, 6 if c.startswith("rare") else 9).alias(c) for c in mix.columns[1:]])


@query("e12_category_affinity", """
SELECT customer_id, round(coalesce(category_affinity_unknown, 0), 6) AS category_affinity_unknown,
       round(coalesce(category_affinity_00, 0), 6) AS category_affinity_00,
       round(coalesce(category_affinity_01, 0), 6) AS category_affinity_01,
       round(coalesce(category_affinity_02, 0), 6) AS category_affinity_02,
       round(coalesce(category_affinity_03, 0), 6) AS category_affinity_03,
       round(coalesce(category_affinity_04, 0), 6) AS category_affinity_04 FROM affinity""")
def category_affinity(ws):
    return _rounded(features.category_affinity(_baskets(ws), ws.taxonomy, CATEGORIES))


@query("e13_engagement_score", """
SELECT customer_id, round(engagement_score, 6) AS engagement_score FROM engagement""")
def engagement_score(ws):
    base = (features.rfm(_orders(ws), ws.churn_cutoff)
            .join(features.net_spend(_past(ws)), "customer_id", "left").fillna(0.0, ["net_spend"]))
    fitted = base.join(ws.training_ids, "customer_id", "left_semi")
    return _rounded(features.engagement(base, fitted))


@query("e14_feature_validation", """
SELECT unnest(['not_finite', 'affinity_sum', 'several_cutoffs', 'repeated_customer', 'population'])
       AS rule, CAST(0 AS BIGINT) AS failures""")
def feature_validation(ws):
    table = ws.churn_features
    numeric = [c for c, t in table.dtypes if t in ("double", "bigint", "int")]
    return features.feature_violations(table, ws.customers, numeric,
                                       features.affinity_columns(CATEGORIES))


@query("feature_table_at_churn_cutoff", """
SELECT feature_base.customer_id, churn, partition_name AS "partition",
       round(recency_days, 6) AS recency_days, frequency_orders, round(net_spend, 6) AS net_spend,
       round(avg_order_value, 6) AS avg_order_value,
       round(variance_interpurchase_gap_days, 6) AS variance_interpurchase_gap_days,
       round(purchase_frequency_trend, 6) AS purchase_frequency_trend,
       round(return_rate, 6) AS return_rate,
       round(markdown_affinity_proxy, 6) AS markdown_affinity_proxy,
       round(engagement_score, 6) AS engagement_score
FROM feature_base JOIN engagement USING (customer_id) JOIN churn_flags USING (customer_id)
JOIN split_table USING (customer_id)""")
def feature_table(ws):
    return _rounded(snapshots.labelled_table(
        ws.build_features(ws.churn_cutoff),
        snapshots.churn_labels(ws.clean, ws.customers, ws.churn_cutoff), ws.split).select(
        "customer_id", "churn", "partition", "recency_days", "frequency_orders", "net_spend",
        "avg_order_value", "variance_interpurchase_gap_days", "purchase_frequency_trend",
        "return_rate", "markdown_affinity_proxy", "engagement_score"))


# --- forward-value features at the churn cutoff -------------------------------------------------
block("clv_orders", """
SELECT customer_id, invoice, min(invoice_date) AS invoice_date,
       sum(gross_positive_value) AS order_value, CAST(sum(quantity) AS BIGINT) AS order_units
FROM cleaned WHERE is_positive_purchase AND customer_id IS NOT NULL GROUP BY customer_id, invoice""")


@query("e16_order_table", f"""
SELECT customer_id, invoice, strftime(invoice_date, {_STAMP}) AS invoice_date,
       CAST(order_value AS DOUBLE) AS order_value, order_units FROM clv_orders""")
def order_table(ws):
    return rolling.order_table(ws.clean).select(
        "customer_id", "invoice", stamp(F.col("invoice_date")).alias("invoice_date"),
        F.col("order_value").cast("double").alias("order_value"), "order_units")


def snapshot_blocks(prefix: str, snaps: str) -> str:
    """Register the blocks of the 27 inputs for the (customer_id, cutoff) rows of ``snaps``."""
    block(f"{prefix}_orders", f"""
SELECT customer_id, cutoff, invoice, invoice_date, CAST(order_value AS DOUBLE) AS v, order_units
FROM clv_orders JOIN {snaps} USING (customer_id) WHERE invoice_date < cutoff""")
    windows = []
    for d in (30, 60, 90, 180):
        inside = f"FILTER (invoice_date >= cutoff - INTERVAL {d} DAY)"
        windows.append(f"sum(v) {inside} AS spend_{d}d, count(*) {inside} AS orders_{d}d, "
                       f"avg(v) {inside} AS avg_order_value_{d}d")
    recent = "FILTER (invoice_date >= cutoff - INTERVAL 180 DAY)"
    before = ("FILTER (invoice_date >= cutoff - INTERVAL 60 DAY "
              "AND invoice_date < cutoff - INTERVAL 30 DAY)")
    block(f"{prefix}_windows", f"""
SELECT customer_id, cutoff, {', '.join(windows)},
       sum(v) {before} AS spend_before, count(*) {before} AS orders_before,
       max(v) {recent} AS maximum_recent_order_value, stddev_pop(v) {recent} AS recent_order_value_std,
       count(DISTINCT strftime(invoice_date, '%Y-%m')) {recent} AS active_month_count,
       avg(CASE WHEN order_units >= 10 THEN 1.0 ELSE 0.0 END) {recent} AS bulk_order_share,
       avg(CASE WHEN v >= 60000 THEN 1.0 ELSE 0.0 END) {recent} AS high_value_order_share,
       count(*) AS lifetime_orders, sum(v) AS lifetime_positive_spend,
       (epoch(cutoff) - epoch(min(invoice_date))) / 86400.0 AS customer_tenure_days,
       (epoch(cutoff) - epoch(max(invoice_date))) / 86400.0 AS recency_days
FROM {prefix}_orders GROUP BY customer_id, cutoff""")
    block(f"{prefix}_gaps", f"""
SELECT customer_id, cutoff, avg(gap) AS purchase_gap_mean_days,
       stddev_samp(gap) AS purchase_gap_std_days
FROM (SELECT customer_id, cutoff, (epoch(invoice_date) - epoch(lag(invoice_date) OVER (
        PARTITION BY customer_id, cutoff ORDER BY invoice_date, invoice))) / 86400.0 AS gap
      FROM {prefix}_orders) GROUP BY customer_id, cutoff""")
    block(f"{prefix}_values", f"""
SELECT customer_id, cutoff,
       CAST(sum(signed_merchandise_value) FILTER (is_valid_merchandise) AS DOUBLE) AS lifetime_net_revenue,
       CAST(sum(-signed_merchandise_value) FILTER (is_valid_merchandise AND signed_merchandise_value < 0
         AND invoice_date >= cutoff - INTERVAL 180 DAY) AS DOUBLE)
       / NULLIF(CAST(sum(signed_merchandise_value) FILTER (is_valid_merchandise
         AND signed_merchandise_value > 0 AND invoice_date >= cutoff - INTERVAL 180 DAY) AS DOUBLE), 0.0)
         AS return_value_ratio,
       max(invoice_date) AS feature_max_timestamp
FROM cleaned JOIN {snaps} USING (customer_id) WHERE invoice_date < cutoff
GROUP BY customer_id, cutoff""")
    columns = ", ".join(
        f"round(coalesce(CAST({expression} AS DOUBLE), 0.0), 6) AS {name}"
        for name, expression in {
            **{n: n for n in rolling.CLV_FEATURES},
            "recent_spend_velocity": "(coalesce(spend_30d, 0) - coalesce(spend_before, 0)) / 30.0",
            "recent_order_frequency_velocity":
                "(coalesce(orders_30d, 0) - coalesce(orders_before, 0)) / 30.0",
        }.items())
    block(f"{prefix}_features", f"""
SELECT customer_id, cutoff, {columns}, feature_max_timestamp
FROM {snaps} LEFT JOIN {prefix}_windows USING (customer_id, cutoff)
LEFT JOIN {prefix}_gaps USING (customer_id, cutoff)
LEFT JOIN {prefix}_values USING (customer_id, cutoff)""")
    return f"{prefix}_features"


block("churn_snaps", "SELECT customer_id, churn_cutoff AS cutoff FROM population, cutoffs")
snapshot_blocks("single", "churn_snaps")


def _clv(ws, *names):
    table = rolling.clv_features_at(ws.clean, ws.customers, ws.churn_cutoff, ws.rolling_cfg)
    return _rounded(table.select("customer_id", *names))


_WINDOWED = [f"{kind}_{d}d" for d in rolling.WINDOWS
             for kind in ("spend", "orders", "avg_order_value")]
_GROUPS = {
    "e17_windowed_spend": _WINDOWED,
    "e18_recent_order_shape": ["maximum_recent_order_value", "recent_order_value_std",
                               "active_month_count", "bulk_order_share", "high_value_order_share"],
    "e19_velocities": ["recent_spend_velocity", "recent_order_frequency_velocity"],
    "e20_lifetime_and_gaps": ["lifetime_orders", "lifetime_positive_spend", "lifetime_net_revenue",
                              "customer_tenure_days", "recency_days", "purchase_gap_mean_days",
                              "purchase_gap_std_days"],
    "e21_return_value_ratio": ["return_value_ratio"],
    "e22_clv_features_at_cutoff": list(rolling.CLV_FEATURES),
}
for _name, _columns in _GROUPS.items():
    query(_name, f"SELECT customer_id, {', '.join(_columns)} FROM single_features")(
        lambda ws, columns=tuple(_columns): _clv(ws, *columns))

"""Registration of queries and the shared building blocks of their SQL statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlake.plans.workspace import Workspace, workspace
from basketlake.settings import ADMIN_CODES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(workspace) -> DataFrame`` under ``name``, with its SQL when it has one."""
    def register(build: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(workspace(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


BLOCKS: dict[str, str] = {}


RECURSIVE: set[str] = set()


def block(name: str, sql: str, recursive: bool = False) -> None:
    """A named part of statements; a recursive one refers to itself."""
    BLOCKS[name] = sql
    if recursive:
        RECURSIVE.add(name)


def _needs(sql: str) -> list[str]:
    return [name for name in BLOCKS if re.search(rf"\b{name}\b", sql)]


def statement(sql: str) -> str:
    """``sql`` preceded by every block it uses, in order of dependency."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(BLOCKS[name]):
            if other != name:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    own = sql.strip()
    for name in _needs(own):
        visit(name)
    if not ordered:
        return own
    head = ",\n".join(f"{name} AS (\n{BLOCKS[name].strip()}\n)" for name in ordered)
    if own.upper().startswith("WITH "):
        own = ", " + own[5:]
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(ordered) else ''}{head}\n{own}"


block("canonical", """
SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'C' ELSE '' END
         || CAST(l_orderkey AS VARCHAR) AS invoice,
       CASE WHEN l_linenumber = 7 THEN 'POST' ELSE CAST(l_partkey AS VARCHAR) END AS stock_code,
       CASE WHEN l_linenumber = 5 AND l_partkey % 20 = 0 THEN '  '
            WHEN l_linenumber = 3 THEN '  ' || p_name || '   ' || p_type || ' '
            WHEN l_linenumber = 4 THEN p_name || ' ' || p_type || ' ' || p_brand
            ELSE p_name || ' ' || p_type END AS description,
       CAST(l_quantity AS BIGINT)
         * CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS quantity,
       o_orderdate AS invoice_date,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN CAST(0 AS DECIMAL(18,4))
            ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2))
                      AS DECIMAL(18,4)) END AS price,
       CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
       n_name AS country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN part ON l_partkey = p_partkey""")

block("copied", """
SELECT * FROM canonical UNION ALL SELECT * FROM canonical WHERE quantity < 0""")

_CODES = ", ".join(f"'{code}'" for code in ADMIN_CODES)


def clean_sql(source: str, thresholds: str | None = None, quantity_limit: int = 100_000,
              price_limit: float = 50_000.0) -> str:
    """Distinct lines of ``source`` with flags; ``thresholds`` names a one-row bounds block."""
    if thresholds:
        q_out = "NOT (CAST(quantity AS DOUBLE) BETWEEN quantity_lower AND quantity_upper)"
        p_out = "NOT (CAST(price AS DOUBLE) BETWEEN price_lower AND price_upper)"
        tail = f", {thresholds}"
    else:
        q_out, p_out, tail = "FALSE", "FALSE", ""
    return f"""
SELECT *, CASE WHEN is_valid_merchandise THEN CAST(quantity * price AS DECIMAL(18,4))
               ELSE CAST(0 AS DECIMAL(18,4)) END AS signed_merchandise_value,
       CASE WHEN is_positive_purchase THEN CAST(quantity * price AS DECIMAL(18,4))
            ELSE CAST(0 AS DECIMAL(18,4)) END AS gross_positive_value
FROM (
 SELECT *, is_valid_merchandise AND quantity > 0 AND NOT is_cancelled_invoice AS is_positive_purchase
 FROM (
  SELECT *, is_product AND NOT is_non_positive_price AND NOT is_zero_quantity
            AND NOT is_likely_data_error AS is_valid_merchandise,
         is_quantity_iqr_outlier OR is_price_iqr_outlier AS is_statistical_outlier
  FROM (
   SELECT d.*, NULLIF(trim(regexp_replace(upper(description), '\\s+', ' ', 'g')), '')
            AS description_normalized,
          customer_id IS NULL AS is_missing_customer_id,
          upper(invoice) LIKE 'C%' AS is_cancelled_invoice,
          quantity < 0 AS is_return, price <= 0 AS is_non_positive_price,
          quantity = 0 AS is_zero_quantity,
          NOT (upper(trim(stock_code)) IN ({_CODES})
               OR regexp_matches(upper(trim(stock_code)), '^(ADJUST|AMAZONFEE$|BANK CHARGES$|GIFT_|TEST)'))
            AS is_product,
          (upper(trim(stock_code)) IN ({_CODES})
               OR regexp_matches(upper(trim(stock_code)), '^(ADJUST|AMAZONFEE$|BANK CHARGES$|GIFT_|TEST)'))
            AS is_administrative_line,
          {q_out} AS is_quantity_iqr_outlier, {p_out} AS is_price_iqr_outlier,
          abs(quantity) > {quantity_limit} OR price > {price_limit} AS is_likely_data_error
   FROM (SELECT DISTINCT * FROM {source}) d{tail})))"""


block("cleaned", clean_sql("canonical"))
block("cutoffs", """
SELECT max(invoice_date) AS observation_end,
       max(invoice_date) - INTERVAL 90 DAY AS churn_cutoff,
       max(invoice_date) - INTERVAL 180 DAY AS clv_cutoff FROM cleaned""")
block("population", """
SELECT DISTINCT customer_id FROM cleaned, cutoffs
WHERE customer_id IS NOT NULL AND is_positive_purchase AND invoice_date < clv_cutoff""")
block("split_table", """
SELECT customer_id,
       CASE WHEN place <= floor(total * 0.70) THEN 'train'
            WHEN place <= floor(total * 0.70) + floor(total * 0.15) THEN 'validation'
            ELSE 'test' END AS partition_name
FROM (SELECT customer_id, count(*) OVER () AS total,
             row_number() OVER (ORDER BY md5('42|' || customer_id), customer_id) AS place
      FROM population)""")
block("trainers", "SELECT customer_id FROM split_table WHERE partition_name = 'train'")
block("training", """
SELECT cleaned.* FROM cleaned JOIN trainers USING (customer_id), cutoffs
WHERE invoice_date < clv_cutoff""")
block("catalogue", """
SELECT CAST(p_partkey AS VARCHAR) AS stock_code,
       CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2
                   WHEN 'SMALL' THEN 3 WHEN 'STANDARD' THEN 4 END AS category_id
FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD')""")
block("prices", """
SELECT stock_code, median(CAST(price AS DOUBLE)) AS reference_price,
       count(*) AS reference_observations
FROM training WHERE is_valid_merchandise AND price > 0 GROUP BY stock_code HAVING count(*) >= 5""")
block("popular_counts", """
SELECT stock_code, count(DISTINCT invoice) AS training_order_frequency
FROM training WHERE is_positive_purchase GROUP BY stock_code""")
block("popular_shares", """
SELECT *, training_order_frequency / (SELECT CAST(sum(training_order_frequency) AS DOUBLE)
                                      FROM popular_counts) AS product_popularity
FROM popular_counts""")
block("popular", """
SELECT *, product_popularity <= (SELECT quantile_cont(product_popularity, 0.10)
                                 FROM popular_shares) AS is_rare_product
FROM popular_shares""")
# History and features at the churn cutoff.
block("hist", """
SELECT cleaned.* FROM cleaned JOIN population USING (customer_id), cutoffs
WHERE invoice_date < churn_cutoff""")
block("positive", "SELECT * FROM hist WHERE is_positive_purchase")
block("order_rows", """
SELECT customer_id, invoice, min(invoice_date) AS invoice_date,
       sum(gross_positive_value) AS order_value, CAST(sum(quantity) AS BIGINT) AS basket_units,
       count(DISTINCT stock_code) AS distinct_products
FROM positive GROUP BY customer_id, invoice""")
block("rfm", """
SELECT customer_id,
       (epoch(any_value(churn_cutoff)) - epoch(max(invoice_date))) / 86400.0 AS recency_days,
       (epoch(any_value(churn_cutoff)) - epoch(min(invoice_date))) / 86400.0 AS customer_tenure_days,
       count(*) AS frequency_orders, CAST(sum(order_value) AS DOUBLE) AS gross_spend,
       CAST(sum(order_value) AS DOUBLE) / count(*) AS avg_order_value,
       avg(CAST(basket_units AS DOUBLE)) AS avg_basket_units,
       avg(CAST(distinct_products AS DOUBLE)) AS avg_distinct_products_per_order
FROM order_rows, cutoffs GROUP BY customer_id""")
block("net", """
SELECT customer_id,
       greatest(CAST(sum(signed_merchandise_value) AS DOUBLE), 0.0) AS net_spend,
       coalesce(CAST(sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS DOUBLE)
         / NULLIF(CAST(sum(CASE WHEN is_positive_purchase THEN quantity ELSE 0 END) AS DOUBLE), 0.0),
         0.0) AS return_rate
FROM hist WHERE is_valid_merchandise GROUP BY customer_id""")
block("gap_stats", """
SELECT customer_id, coalesce(avg(gap), 0.0) AS mean_interpurchase_gap_days,
       coalesce(var_pop(gap), 0.0) AS variance_interpurchase_gap_days
FROM (SELECT customer_id, (epoch(invoice_date) - epoch(lag(invoice_date) OVER (
                PARTITION BY customer_id ORDER BY invoice_date, invoice))) / 86400.0 AS gap
      FROM order_rows) GROUP BY customer_id""")
block("trend", """
SELECT customer_id, sum(least(greatest(floor((epoch(invoice_date)
         - epoch(churn_cutoff - INTERVAL 90 DAY)) / 604800.0), 0), 12) - 6) / 182.0
         AS purchase_frequency_trend
FROM order_rows, cutoffs WHERE invoice_date >= churn_cutoff - INTERVAL 90 DAY GROUP BY customer_id""")
block("season", """
SELECT customer_id, CAST(max(n) AS DOUBLE) / sum(n) AS seasonal_purchase_concentration
FROM (SELECT customer_id, year(invoice_date) AS y, quarter(invoice_date) AS q, count(*) AS n
      FROM order_rows GROUP BY ALL) GROUP BY customer_id""")
block("markdown", """
SELECT customer_id, count(DISTINCT CASE WHEN CAST(price AS DOUBLE) <= 0.96 * reference_price
                                        THEN invoice END)
         / CAST(count(DISTINCT invoice) AS DOUBLE) AS markdown_affinity_proxy
FROM positive JOIN prices USING (stock_code) GROUP BY customer_id""")
block("pop_mix", """
SELECT customer_id, avg(product_popularity) AS mean_product_popularity,
       median(product_popularity) AS median_product_popularity,
       max(product_popularity) AS max_product_popularity,
       avg(CASE WHEN is_rare_product THEN 1.0 ELSE 0.0 END) AS rare_product_share
FROM positive JOIN popular USING (stock_code) GROUP BY customer_id""")
block("affinity", """
SELECT customer_id, sum(v) FILTER (category_id IS NULL) / sum(v) AS category_affinity_unknown,
       sum(v) FILTER (category_id = 0) / sum(v) AS category_affinity_00,
       sum(v) FILTER (category_id = 1) / sum(v) AS category_affinity_01,
       sum(v) FILTER (category_id = 2) / sum(v) AS category_affinity_02,
       sum(v) FILTER (category_id = 3) / sum(v) AS category_affinity_03,
       sum(v) FILTER (category_id = 4) / sum(v) AS category_affinity_04
FROM (SELECT customer_id, category_id, CAST(gross_positive_value AS DOUBLE) AS v
      FROM positive LEFT JOIN catalogue USING (stock_code)) GROUP BY customer_id""")
block("churn_flags", """
SELECT customer_id, CASE WHEN customer_id IN (
    SELECT customer_id FROM cleaned, cutoffs WHERE is_positive_purchase AND customer_id IS NOT NULL
    AND invoice_date >= churn_cutoff AND invoice_date <= churn_cutoff + INTERVAL 90 DAY)
  THEN 0 ELSE 1 END AS churn FROM population""")
block("feature_base", """
SELECT rfm.*, coalesce(net_spend, 0.0) AS net_spend, coalesce(return_rate, 0.0) AS return_rate,
       mean_interpurchase_gap_days, variance_interpurchase_gap_days,
       coalesce(purchase_frequency_trend, 0.0) AS purchase_frequency_trend,
       seasonal_purchase_concentration,
       coalesce(markdown_affinity_proxy, 0.0) AS markdown_affinity_proxy
FROM rfm LEFT JOIN net USING (customer_id) JOIN gap_stats USING (customer_id)
LEFT JOIN trend USING (customer_id) JOIN season USING (customer_id)
LEFT JOIN markdown USING (customer_id)""")
block("train_rfm", "SELECT feature_base.* FROM feature_base JOIN trainers USING (customer_id)")
block("engagement", """
SELECT b.customer_id, least(greatest(100.0 * (
         0.4 * (1.0 - (SELECT count(*) FROM train_rfm t WHERE t.recency_days <= b.recency_days)
                      / CAST(n AS DOUBLE))
         + 0.3 * (SELECT count(*) FROM train_rfm t WHERE t.frequency_orders <= b.frequency_orders)
                 / CAST(n AS DOUBLE)
         + 0.3 * (SELECT count(*) FROM train_rfm t WHERE t.net_spend <= b.net_spend)
                 / CAST(n AS DOUBLE)), 0.0), 100.0) AS engagement_score
FROM feature_base b, (SELECT count(*) AS n FROM train_rfm)""")

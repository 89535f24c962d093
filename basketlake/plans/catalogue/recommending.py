"""Recommender operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions.columns import r6
from basketlake.functions.timing import stamp
from basketlake.operators import products, recommend
from basketlake.plans.catalogue.registry import block, query

_STAMP = "'%Y-%m-%d %H:%M:%S'"

# Segments from a formula: every seventh customer has none and one segment is left empty.
block("segment_map", """
SELECT customer_id, CAST(CAST(customer_id AS BIGINT) % 5 AS INTEGER) AS segment_id
FROM population WHERE CAST(customer_id AS BIGINT) % 7 <> 0""")


def segment_map(ws):
    number = F.col("customer_id").cast("bigint")
    return ws.customers.where(number % 7 != 0).select(
        "customer_id", (number % 5).cast("int").alias("segment_id"))


block("rec_lines", """
SELECT customer_id, invoice, invoice_date, stock_code, quantity FROM cleaned
JOIN trainers USING (customer_id) WHERE is_positive_purchase AND is_product""")


def _lines(ws):
    return recommend.product_lines(ws.clean, ws.training_ids)


@query("j1_positive_product_lines", f"""
SELECT customer_id, invoice, strftime(invoice_date, {_STAMP}) AS invoice_date, stock_code, quantity
FROM rec_lines""")
def positive_product_lines(ws):
    return _lines(ws).withColumn("invoice_date", stamp(F.col("invoice_date")))


block("marked_lines", """
SELECT * FROM (
  SELECT *, invoice = last_value(invoice) OVER (PARTITION BY customer_id
              ORDER BY invoice_date, invoice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
              AS is_holdout,
         count(DISTINCT invoice) OVER (PARTITION BY customer_id) AS n FROM rec_lines) WHERE n >= 2""")


@query("j2_leave_last_order_out", """
SELECT customer_id, invoice, stock_code, quantity, is_holdout FROM marked_lines""")
def leave_last_order_out(ws):
    return recommend.leave_last_order_out(_lines(ws)).select(
        "customer_id", "invoice", "stock_code", "quantity", "is_holdout")


block("weights", """
SELECT customer_id, stock_code, ln(1 + CAST(sum(quantity) AS DOUBLE)) AS weight FROM marked_lines
WHERE NOT is_holdout GROUP BY customer_id, stock_code HAVING sum(quantity) > 0""")


def _history(ws):
    return ws.stage("recommender_lines",
                    lambda: recommend.leave_last_order_out(_lines(ws)))


def _weights(ws):
    return recommend.interactions(_history(ws).where("NOT is_holdout"))


@query("j3_interaction_weights", """
SELECT customer_id, stock_code, round(weight, 6) AS weight FROM weights""")
def interaction_weights(ws):
    return _weights(ws).withColumn("weight", r6(F.col("weight")))


block("neighbours", """
SELECT * FROM (SELECT stock_code, neighbour, similarity, row_number() OVER (
    PARTITION BY stock_code ORDER BY similarity DESC, neighbour) AS rank
  FROM (SELECT a.stock_code, b.stock_code AS neighbour,
               round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 9)
                 AS similarity
        FROM weights a JOIN weights b ON a.customer_id = b.customer_id AND a.stock_code <> b.stock_code
        JOIN (SELECT stock_code, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1) na
          ON na.stock_code = a.stock_code
        JOIN (SELECT stock_code, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1) nb
          ON nb.stock_code = b.stock_code
        GROUP BY a.stock_code, b.stock_code)) WHERE rank <= 25""")


@query("j4_item_neighbours", """
SELECT stock_code, neighbour, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM neighbours""")
def item_neighbours(ws):
    return recommend.item_neighbours(_weights(ws)).withColumn(
        "similarity", r6(F.col("similarity")))


block("popular_lists", """
SELECT segment_id, stock_code, CAST(quantity AS BIGINT) AS quantity, CAST(place AS INTEGER) AS place
FROM (SELECT segment_id, stock_code, quantity, row_number() OVER (
        PARTITION BY segment_id ORDER BY quantity DESC, stock_code) AS place
      FROM (SELECT segment_id, stock_code, sum(quantity) AS quantity FROM marked_lines
            JOIN segment_map USING (customer_id) WHERE NOT is_holdout
            GROUP BY ALL
            UNION ALL SELECT NULL, stock_code, sum(quantity) FROM marked_lines WHERE NOT is_holdout
            GROUP BY stock_code)) WHERE place <= 50""")


def _popular(ws):
    return recommend.popular_items(_history(ws).where("NOT is_holdout"),
                                   segment_map(ws))


@query("j5_popular_items", """
SELECT coalesce(segment_id, -1) AS segment_id, stock_code, quantity, place FROM popular_lists""")
def popular_items(ws):
    return _popular(ws).withColumn("segment_id", F.coalesce("segment_id", F.lit(-1)))


block("seen", "SELECT DISTINCT customer_id, stock_code FROM marked_lines WHERE NOT is_holdout")
block("tier_rows", """
SELECT customer_id, neighbour AS stock_code, round(sum(similarity), 6) AS score, 1 AS tier,
       0 AS place
FROM seen JOIN neighbours USING (stock_code) WHERE similarity > 0
  AND (customer_id, neighbour) NOT IN (SELECT (customer_id, stock_code) FROM seen) GROUP BY ALL""")
block("recommended", """
SELECT customer_id, stock_code, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id
              ORDER BY tier, score DESC, place, stock_code) AS rank
  FROM (SELECT * FROM tier_rows
        UNION ALL
        SELECT s.customer_id, p.stock_code, 0.0, 2, p.place
        FROM (SELECT customer_id, segment_id
              FROM (SELECT DISTINCT customer_id FROM seen) LEFT JOIN segment_map USING (customer_id)) s
        JOIN popular_lists p ON p.segment_id IS NOT DISTINCT FROM s.segment_id
        WHERE (s.customer_id, p.stock_code) NOT IN (SELECT (customer_id, stock_code) FROM seen)
          AND (s.customer_id, p.stock_code) NOT IN (SELECT (customer_id, stock_code) FROM tier_rows)))
WHERE rank <= 5""")


def _neighbours(ws):
    return ws.stage("neighbours", lambda: recommend.item_neighbours(_weights(ws)))


def recommendations(ws):
    def build():
        seen = _history(ws).where("NOT is_holdout").select("customer_id", "stock_code")
        return recommend.recommend(seen, _neighbours(ws), _popular(ws), segment_map(ws))
    return ws.stage("recommendations", build)


@query("j6_recommendations", """
SELECT customer_id, stock_code, round(score, 4) AS score, rank FROM recommended""")
def recommended(ws):
    seen = _history(ws).where("NOT is_holdout").select("customer_id", "stock_code")
    return recommend.recommend(seen, _neighbours(ws), _popular(ws), segment_map(ws)).withColumn(
        "score", F.round("score", 4))


block("truth", "SELECT DISTINCT customer_id, stock_code FROM marked_lines WHERE is_holdout")


@query("j7_offline_evaluation", """
SELECT round(avg(hits / CAST(n AS DOUBLE)), 6) AS recall_at_k,
       round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k,
       count(*) AS evaluated_customers,
       round((SELECT count(DISTINCT stock_code) FROM recommended)
             / CAST((SELECT count(DISTINCT stock_code) FROM seen) AS DOUBLE), 6) AS catalog_coverage
FROM (SELECT t.customer_id, count(*) AS n, count(r.stock_code) AS hits
      FROM truth t LEFT JOIN recommended r USING (customer_id, stock_code)
      WHERE t.customer_id IN (SELECT customer_id FROM seen) GROUP BY t.customer_id)""")
def offline_evaluation(ws):
    history = _history(ws)
    result = recommend.evaluate(recommendations(ws), history.where("is_holdout"),
                                history.where("NOT is_holdout"))
    return result.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c)
                           for c, t in result.dtypes])


@query("j8_recommendation_reasons", """
SELECT n.stock_code AS source_stock_code,
       coalesce(s.description_normalized, 'unknown product') AS source_description,
       neighbour AS recommended_stock_code,
       coalesce(t.description_normalized, 'unknown product') AS recommended_description,
       round(similarity, 6) AS cosine_similarity, CAST(rank AS INTEGER) AS rank,
       'Recommended because it is behaviorally similar to ' || n.stock_code || '.' AS reason
FROM neighbours n LEFT JOIN descriptions s ON s.stock_code = n.stock_code
LEFT JOIN descriptions t ON t.stock_code = neighbour WHERE similarity > 0 AND rank <= 5""")
def recommendation_reasons(ws):
    names = products.modal_descriptions(ws.training_lines)
    return recommend.reasons(_neighbours(ws), names).withColumn(
        "cosine_similarity", r6(F.col("cosine_similarity")))

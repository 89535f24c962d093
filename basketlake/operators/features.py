"""Point-in-time customer features: one row per customer, from lines strictly before a cutoff.

Heavy customers are never gathered in one task: lines are reduced to invoices, invoices to months,
and only month rows meet per customer. Every reduction is a partial (map-side) aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import ratio
from basketlake.functions.distributed import middle, share_at_or_below, with_middle
from basketlake.session import stored
from basketlake.functions.timing import (
    days, elapsed_days, elapsed_seconds, moment, month_start, quarter_start)

# What each feature is for.
FEATURE_NOTES = {
    "recency_days": "days since the last purchase",
    "frequency_orders": "number of completed orders",
    "gross_spend": "value of all positive lines",
    "net_spend": "value after returns, not below zero",
    "avg_order_value": "mean value of an order",
    "historical_customer_value": "realized net value",
    "avg_basket_units": "mean units of an order",
    "avg_distinct_products_per_order": "mean product variety of an order",
    "unique_product_count": "lifetime product variety",
    "customer_tenure_days": "days since the first purchase",
    "mean_interpurchase_gap_days": "typical days between orders",
    "variance_interpurchase_gap_days": "spread of days between orders",
    "purchase_frequency_trend": "slope of weekly orders in the trend window",
    "seasonal_purchase_concentration": "share of orders in the busiest quarter",
    "return_rate": "returned units relative to bought units",
    "markdown_affinity_proxy": "share of orders with a marked-down product",
    "engagement_score": "recency, frequency and spend percentiles on a 0-100 scale",
    "mean_product_popularity": "mean popularity of bought lines",
    "median_product_popularity": "median popularity of bought lines",
    "max_product_popularity": "largest popularity of bought lines",
    "rare_product_share": "share of bought lines of rare products",
}


def known_lines(cleaned: DataFrame, cutoff: Column | str) -> DataFrame:
    """Lines of any identified customer strictly before the cutoff."""
    return cleaned.where(F.col("customer_id").isNotNull() & (F.col("invoice_date") < moment(cutoff)))


def customer_history(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str) -> DataFrame:
    return known_lines(cleaned, cutoff).join(customers.select("customer_id"), "customer_id", "left_semi")


def baskets(history: DataFrame) -> DataFrame:
    """Positive lines at (customer, invoice, product) grain, the base of orders and variety."""
    return (history.where("is_positive_purchase")
            .groupBy("customer_id", "invoice", "stock_code")
            .agg(F.min("invoice_date").alias("invoice_date"),
                 F.sum("gross_positive_value").alias("value"), F.sum("quantity").alias("units"),
                 F.count(F.lit(1)).alias("n_lines"), F.min("price").alias("lowest_price")))


def orders(basket_rows: DataFrame) -> DataFrame:
    """Per (customer, invoice): first timestamp, value, units, distinct products."""
    return basket_rows.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("invoice_date"), F.sum("value").alias("order_value"),
        F.sum("units").alias("basket_units"), F.count(F.lit(1)).alias("distinct_products"))


def with_previous_order(order_rows: DataFrame) -> DataFrame:
    """Adds ``event_rank`` and ``previous_date`` in order of (date, invoice) per customer.

    Inside a month by window; across months through one row per (customer, month).
    """
    dated = order_rows.withColumn("__month", month_start(F.col("invoice_date")))
    in_month = Window.partitionBy("customer_id", "__month").orderBy("invoice_date", "invoice")
    months = dated.groupBy("customer_id", "__month").agg(
        F.count(F.lit(1)).alias("__n"), F.max("invoice_date").alias("__last"))
    by_month = Window.partitionBy("customer_id").orderBy("__month")
    months = months.select(
        "customer_id", "__month",
        F.coalesce(F.sum("__n").over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__before"), F.lag("__last").over(by_month).alias("__prev"))
    return (dated.withColumn("__rn", F.row_number().over(in_month))
            .withColumn("__lag", F.lag("invoice_date").over(in_month))
            .join(months, ["customer_id", "__month"])
            .withColumn("event_rank", F.col("__before") + F.col("__rn"))
            .withColumn("previous_date", F.coalesce("__lag", "__prev"))
            .drop("__month", "__rn", "__lag", "__before", "__prev"))


def _rfm_sums() -> list[Column]:
    return [F.max("invoice_date").alias("last"), F.min("invoice_date").alias("first"),
            F.count(F.lit(1)).alias("frequency_orders"), F.sum("order_value").alias("spend"),
            F.avg(F.col("basket_units").cast("double")).alias("avg_basket_units"),
            F.avg(F.col("distinct_products").cast("double"))
            .alias("avg_distinct_products_per_order")]


def _rfm_columns(cutoff: Column | str) -> list[Column]:
    at, spend = moment(cutoff), F.col("spend").cast("double")
    return [F.col("customer_id"), elapsed_days(at, F.col("last")).alias("recency_days"),
            elapsed_days(at, F.col("first")).alias("customer_tenure_days"),
            F.col("frequency_orders"), spend.alias("gross_spend"),
            (spend / F.col("frequency_orders")).alias("avg_order_value"),
            F.col("avg_basket_units"), F.col("avg_distinct_products_per_order")]


def rfm(order_rows: DataFrame, cutoff: Column | str) -> DataFrame:
    """Recency, tenure, frequency, spend and mean basket shape."""
    return order_rows.groupBy("customer_id").agg(*_rfm_sums()).select(*_rfm_columns(cutoff))


def variety(basket_rows: DataFrame) -> DataFrame:
    """Distinct products per customer (pairs are made distinct before the customer meets)."""
    return (basket_rows.select("customer_id", "stock_code").distinct()
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("unique_product_count")))


def net_spend(history: DataFrame) -> DataFrame:
    """Net value floored at zero and return rate, from the same pass over valid lines."""
    sums = history.where("is_valid_merchandise").groupBy("customer_id").agg(
        F.sum("signed_merchandise_value").alias("net"),
        F.sum(F.when(F.col("quantity") < 0, -F.col("quantity")).otherwise(0)).alias("returned"),
        F.sum(F.when(F.col("is_positive_purchase"), F.col("quantity")).otherwise(0))
        .alias("bought"))
    net = F.greatest(F.col("net").cast("double"), F.lit(0.0))
    return sums.select("customer_id", net.alias("net_spend"),
                       net.alias("historical_customer_value"),
                       ratio(F.col("returned"), F.col("bought")).alias("return_rate"))


def _gap_sums() -> list[Column]:
    gap = elapsed_days(F.col("invoice_date"), F.col("previous_date"))
    return [F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_interpurchase_gap_days"),
            F.coalesce(F.var_pop(gap), F.lit(0.0)).alias("variance_interpurchase_gap_days")]


def gaps(order_rows: DataFrame) -> DataFrame:
    """Mean and population variance of days between orders; 0 for single orders."""
    return with_previous_order(order_rows).groupBy("customer_id").agg(*_gap_sums())


def _trend_sum(cutoff: Column | str, window_days: int) -> Column:
    weeks = max(-(-window_days // 7), 2)
    centre = (weeks - 1) / 2.0
    spread = sum((w - centre) ** 2 for w in range(weeks))
    start = moment(cutoff) - days(window_days)
    week = F.least(F.greatest(F.floor(
        elapsed_seconds(F.col("invoice_date"), start) / 604800.0), F.lit(0)), F.lit(weeks - 1))
    part = F.when(F.col("invoice_date") >= start, week - F.lit(centre))
    return (F.sum(part) / F.lit(spread)).alias("purchase_frequency_trend")


def weekly_trend(order_rows: DataFrame, cutoff: Column | str, window_days: int = 90) -> DataFrame:
    """Least-squares slope of weekly order counts over the window before the cutoff.

    Weeks without orders add nothing to the closed form, so no calendar is materialized.
    """
    recent = order_rows.where(F.col("invoice_date") >= moment(cutoff) - days(window_days))
    return recent.groupBy("customer_id").agg(_trend_sum(cutoff, window_days))


def seasonality(order_rows: DataFrame) -> DataFrame:
    """Orders in the busiest year-quarter as a share of all orders."""
    return (order_rows.groupBy("customer_id", quarter_start(F.col("invoice_date")).alias("q"))
            .agg(F.count(F.lit(1)).alias("n")).groupBy("customer_id")
            .agg((F.max("n") / F.sum("n")).alias("seasonal_purchase_concentration")))


def markdown_affinity(basket_rows: DataFrame, prices: DataFrame, price_ratio: float = 0.90
                      ) -> DataFrame:
    """Share of orders with a referenced product that hold one at or below the marked-down price.

    A basket row keeps its lowest price, so a line-level comparison is not needed.
    """
    priced = basket_rows.join(prices.select("stock_code", "reference_price"), "stock_code")
    marked = F.col("lowest_price").cast("double") <= F.lit(price_ratio) * F.col("reference_price")
    per_order = priced.groupBy("customer_id", "invoice").agg(
        F.max(marked.cast("int")).alias("marked"))
    return per_order.groupBy("customer_id").agg(
        F.avg("marked").alias("markdown_affinity_proxy"))


def _by_product(basket_rows: DataFrame) -> DataFrame:
    return basket_rows.groupBy("customer_id", "stock_code").agg(
        F.sum("n_lines").alias("n"), F.sum("value").alias("value"))


def _popularity_sums() -> list[Column]:
    """Over (customer, product) rows with ``n`` lines, their middle marked; products without popularity are skipped."""
    known = F.when(F.col("product_popularity").isNotNull(), F.col("n"))
    total = F.nullif(F.sum(known), F.lit(0))
    return [(F.sum(F.col("product_popularity") * F.col("n")) / total)
            .alias("mean_product_popularity"),
            middle().alias("median_product_popularity"),
            F.max("product_popularity").alias("max_product_popularity"),
            (F.sum(F.when(F.col("is_rare_product"), F.col("n")).otherwise(0)) / total)
            .alias("rare_product_share")]


def popularity_mix(basket_rows: DataFrame, popular: DataFrame) -> DataFrame:
    """Mean, median and maximum popularity and the rare share, weighted by lines.

    Lines are counted per (customer, product) first: the median works on those counts.
    """
    known = _by_product(basket_rows).join(
        popular.select("stock_code", "product_popularity", "is_rare_product"), "stock_code")
    return with_middle(known, ["customer_id"], "product_popularity", "n").groupBy("customer_id").agg(
        *_popularity_sums())


def affinity_columns(n_categories: int) -> list[str]:
    return ["category_affinity_unknown",
            *[f"category_affinity_{i:02d}" for i in range(n_categories)]]


def _affinity_sums(n_categories: int) -> list[Column]:
    category = F.coalesce(F.col("category_id").cast("int"), F.lit(-1))
    total = F.sum("value")
    return [ratio(F.sum(F.when(category == i, F.col("value"))), total).alias(name)
            for i, name in enumerate(affinity_columns(n_categories), start=-1)]


def category_affinity(basket_rows: DataFrame, taxonomy: DataFrame, n_categories: int) -> DataFrame:
    """Share of value per category, unknown products apart; a fixed set of columns."""
    valued = _by_product(basket_rows).join(
        taxonomy.select("stock_code", "category_id"), "stock_code", "left")
    return valued.groupBy("customer_id").agg(*_affinity_sums(n_categories))


def engagement(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """0-100 score from the share of fitted (training) values at or below each value."""
    shares = share_at_or_below(features, fitted, "customer_id",
                               ["recency_days", "frequency_orders", "net_spend"])
    score = 100.0 * (0.40 * (1.0 - F.col("recency_days")) + 0.30 * F.col("frequency_orders")
                     + 0.30 * F.col("net_spend"))
    return shares.select("customer_id", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
                         .alias("engagement_score"))


def raw_customer_features(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str,
                          taxonomy: DataFrame, n_categories: int, prices: DataFrame,
                          popular: DataFrame, trend_days: int = 90, price_ratio: float = 0.90
                          ) -> DataFrame:
    """All features but the engagement score, with one pass per grain instead of one per family.

    Order measures share one aggregate, product measures another, line sums a third. Prices are looked
    up before lines meet their order, so lines move once for each; orders are written once, as several
    measures read them. Other customers leave at customer grain, where that moves no line.
    """
    past = known_lines(cleaned, cutoff)
    bought = past.where("is_positive_purchase")
    marked = F.col("price").cast("double") <= F.lit(price_ratio) * F.col("reference_price")
    priced = bought.join(prices.select("stock_code", "reference_price"), "stock_code", "left").select(
        "customer_id", "invoice", "stock_code", "invoice_date", "quantity",
        F.col("gross_positive_value").alias("value"), marked.cast("int").alias("marked"))
    order_rows = stored(
        priced.repartition("customer_id", "invoice").groupBy("customer_id", "invoice", "stock_code").agg(
            F.min("invoice_date").alias("invoice_date"), F.sum("value").alias("value"),
            F.sum("quantity").alias("units"), F.max("marked").alias("marked"))
        .groupBy("customer_id", "invoice").agg(
            F.min("invoice_date").alias("invoice_date"), F.sum("value").alias("order_value"),
            F.sum("units").alias("basket_units"), F.count(F.lit(1)).alias("distinct_products"),
            F.max("marked").alias("marked")))
    by_order = (with_previous_order(order_rows).groupBy("customer_id")
                .agg(*_rfm_sums(), *_gap_sums(), _trend_sum(cutoff, trend_days),
                     F.avg("marked").alias("markdown_affinity_proxy"))
                .select(*_rfm_columns(cutoff), "mean_interpurchase_gap_days",
                        "variance_interpurchase_gap_days", "purchase_frequency_trend",
                        "markdown_affinity_proxy"))
    held = (bought.groupBy("customer_id", "stock_code")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("gross_positive_value").alias("value"))
            .join(popular.select("stock_code", "product_popularity", "is_rare_product"), "stock_code", "left")
            .join(taxonomy.select("stock_code", "category_id"), "stock_code", "left"))
    by_product = (with_middle(held, ["customer_id"], "product_popularity", "n").groupBy("customer_id")
                  .agg(F.count(F.lit(1)).alias("unique_product_count"), *_popularity_sums(),
                       *_affinity_sums(n_categories)))
    zero = ["purchase_frequency_trend", "markdown_affinity_proxy", "mean_product_popularity",
            "median_product_popularity", "max_product_popularity", "rare_product_share",
            "net_spend", "historical_customer_value", "return_rate"]
    return (by_order.join(customers.select("customer_id"), "customer_id", "left_semi")
            .join(by_product, "customer_id").join(seasonality(order_rows), "customer_id")
            .join(net_spend(past), "customer_id", "left")
            .fillna(0.0, subset=zero).withColumn("cutoff_timestamp", moment(cutoff)))


def customer_features(cleaned: DataFrame, customers: DataFrame, cutoff: Column | str,
                      taxonomy: DataFrame, n_categories: int, prices: DataFrame,
                      popular: DataFrame, training_ids: DataFrame, trend_days: int = 90,
                      price_ratio: float = 0.90, fitted: DataFrame | None = None) -> DataFrame:
    """The full table; engagement is fitted on training customers, or on a frozen ``fitted``.

    The customer-grain table is materialized once because the percentile fit reads it repeatedly.
    """
    raw = stored(raw_customer_features(cleaned, customers, cutoff, taxonomy, n_categories,
                                       prices, popular, trend_days, price_ratio))
    base = fitted if fitted is not None else raw.join(
        training_ids.select("customer_id"), "customer_id", "left_semi")
    return raw.join(engagement(raw, base), "customer_id")


def feature_violations(features: DataFrame, customers: DataFrame,
                       numeric: Sequence[str], affinity: Sequence[str]) -> DataFrame:
    """Rules of a feature table as (rule, failures); all zero when sound."""
    bad = F.lit(False)
    for name in numeric:
        x = F.col(name).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    total = F.lit(0.0)
    for name in affinity:
        total = total + F.col(name)
    # Customers are compared by a tagged union, so one shuffle finds repeats and both differences.
    tagged = features.select("customer_id", F.lit(1).alias("f"), F.lit(0).alias("c")).unionByName(
        customers.select("customer_id", F.lit(0).alias("f"), F.lit(1).alias("c")))
    sides = (tagged.groupBy("customer_id").agg(F.sum("f").alias("f"), F.sum("c").alias("c"))
             .agg(F.count_if(F.col("f") > 1).alias("a"),
                  F.count_if((F.col("f") > 0) != (F.col("c") > 0)).alias("b")))
    counted = features.agg(
        F.count_if(bad).alias("not_finite"),
        F.count_if(F.abs(total - 1.0) > 1e-6).alias("affinity_sum"),
        F.greatest(F.count_distinct("cutoff_timestamp") - 1, F.lit(0)).alias("several_cutoffs"))
    first = counted.selectExpr("stack(3, 'not_finite', not_finite, 'affinity_sum', affinity_sum, "
                               "'several_cutoffs', several_cutoffs) as (rule, failures)")
    second = sides.selectExpr("stack(2, 'repeated_customer', a, 'population', b) "
                              "as (rule, failures)")
    return first.unionByName(second)

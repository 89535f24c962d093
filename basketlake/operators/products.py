"""Product artifacts learned from training history: descriptions, terms, prices, popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.distributed import middle, with_middle
from basketlake.functions.timing import moment
from basketlake.settings import ProductSettings


def training_history(cleaned: DataFrame, training_ids: DataFrame, cutoff: Column | str) -> DataFrame:
    return cleaned.where(F.col("invoice_date") < moment(cutoff)).join(
        training_ids.select("customer_id"), "customer_id", "left_semi")


def modal_descriptions(training: DataFrame) -> DataFrame:
    """Per product the most frequent description; ties by latest seen, then alphabetical."""
    counted = (training.where(F.col("is_product") & F.col("description_normalized").isNotNull())
               .groupBy("stock_code", "description_normalized")
               .agg(F.count(F.lit(1)).alias("description_count"),
                    F.max("invoice_date").alias("latest_seen")))
    best = Window.partitionBy("stock_code").orderBy(
        F.desc("description_count"), F.desc("latest_seen"), F.asc("description_normalized"))
    return counted.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def terms(descriptions: DataFrame) -> DataFrame:
    """Unigram and bigram counts per product: (stock_code, term, tf)."""
    words = F.filter(F.split(F.col("description_normalized"), r"(?U)[^\w]+"),
                     lambda w: F.length(w) >= 2)
    pairs = F.when(F.size("w") > 1, F.zip_with(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return (descriptions.select("stock_code", words.alias("w"))
            .select("stock_code", F.explode(F.concat("w", pairs)).alias("term"))
            .groupBy("stock_code", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(counts: DataFrame, max_terms: int) -> DataFrame:
    """The ``max_terms`` heaviest terms by total count, ties alphabetical, with a column index."""
    kept = (counts.groupBy("term").agg(F.sum("tf").alias("total"),
                                       F.count(F.lit(1)).alias("df"))
            .orderBy(F.desc("total"), "term").limit(max_terms))
    place = Window.partitionBy(F.lit(0)).orderBy("term")  # at most max_terms rows
    return kept.withColumn("term_index", F.row_number().over(place) - 1)


def tfidf(descriptions: DataFrame, cfg: ProductSettings = ProductSettings()) -> DataFrame:
    """Sublinear tf, smoothed idf, unit-length rows: (stock_code, term, term_index, weight)."""
    counts = terms(descriptions)
    # The vocabulary is capped at max_terms rows, so it always fits a broadcast.
    kept = counts.join(F.broadcast(vocabulary(counts, cfg.max_terms)), "term")
    documents = descriptions.agg(F.count(F.lit(1)).alias("n")).scalar()
    raw = (1 + F.ln("tf")) * (F.ln((1 + documents) / (1 + F.col("df"))) + 1)
    weighted = kept.withColumn("raw", raw)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("stock_code")))
    return weighted.select("stock_code", "term", "term_index", (F.col("raw") / norm).alias("weight"))


def reference_prices(training: DataFrame, cfg: ProductSettings = ProductSettings()) -> DataFrame:
    """Median valid price of products with enough observations.

    Lines are first counted per (product, price): a hot product spreads over its prices, and the
    median then works on distinct prices with their frequencies.
    """
    counted = (training.where(F.col("is_valid_merchandise") & (F.col("price") > 0))
               .groupBy("stock_code", "price").agg(F.count(F.lit(1)).alias("n")))
    return with_middle(counted, ["stock_code"], "price", "n").groupBy("stock_code").agg(
        middle().alias("reference_price"),
        F.sum("n").alias("reference_observations"),
    ).where(F.col("reference_observations") >= cfg.markdown_min_observations)


def popularity(training: DataFrame, cfg: ProductSettings = ProductSettings()) -> DataFrame:
    """Share of distinct (product, invoice) pairs per product; rare = at or below the 10th pct."""
    counted = (training.where("is_positive_purchase").select("stock_code", "invoice").distinct()
               .groupBy("stock_code").agg(F.count(F.lit(1)).alias("training_order_frequency")))
    total = counted.agg(F.sum("training_order_frequency").alias("t")).scalar()
    shares = counted.withColumn("product_popularity",
                                F.col("training_order_frequency") / total.cast("double"))
    # Frequencies are small integers, so the exact percentile's buffer of distinct values is short.
    rare = shares.agg(F.percentile("product_popularity", cfg.rare_quantile).alias("q")).scalar()
    return shares.withColumn("is_rare_product", F.col("product_popularity") <= rare)



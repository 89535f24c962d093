"""Duplicate removal, audit flags, outlier thresholds and value columns of transaction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.functions.columns import (
    flag_count, is_administrative, line_value, upper_collapsed)
from basketlake.functions.distributed import exact_quantiles
from basketlake.settings import CleaningSettings

AUDIT_FLAGS = (
    "is_missing_customer_id", "is_return", "is_cancelled_invoice", "is_non_positive_price",
    "is_administrative_line", "is_statistical_outlier", "is_likely_data_error")


def without_duplicates(lines: DataFrame) -> DataFrame:
    """One copy of every line; nulls are equal. Copies collapse map-side before the shuffle."""
    return lines.dropDuplicates()


def quality_flags(lines: DataFrame, cfg: CleaningSettings = CleaningSettings()) -> DataFrame:
    admin = is_administrative(F.col("stock_code"), cfg.admin_codes, cfg.admin_patterns)
    falsy = F.lit(False)
    return lines.withColumns({
        "description_normalized": upper_collapsed(F.col("description")),
        "is_missing_customer_id": F.col("customer_id").isNull(),
        "is_cancelled_invoice": F.coalesce(F.upper("invoice").startswith("C"), falsy),
        "is_return": F.coalesce(F.col("quantity") < 0, falsy),
        "is_non_positive_price": F.coalesce(F.col("price") <= 0, falsy),
        "is_zero_quantity": F.coalesce(F.col("quantity") == 0, falsy),
        "is_administrative_line": admin,
        "is_product": ~admin,
    })


def outlier_thresholds(lines: DataFrame, training_ids: DataFrame,
                       cfg: CleaningSettings = CleaningSettings()) -> DataFrame:
    """One row of IQR bounds, fitted on the lines of training customers only.

    ``lines`` must already be cut to the training history.
    """
    known = lines.join(training_ids.select("customer_id"), "customer_id", "left_semi")
    # Both measures are ranked in one pass; prices count only when positive.
    long = known.select(
        F.explode(F.array(
            F.struct(F.lit("quantity").alias("measure"),
                     F.col("quantity").cast("double").alias("x")),
            F.struct(F.lit("price").alias("measure"),
                     F.when(F.col("price") > 0, F.col("price").cast("double")).alias("x"))
        )).alias("e")).select("e.measure", "e.x")
    quartiles = exact_quantiles(long, "x", {"q1": 0.25, "q3": 0.75}, ["measure"])
    spread = (F.col("q3") - F.col("q1")) * F.lit(cfg.iqr_multiplier)
    bounds = quartiles.select("measure", (F.col("q1") - spread).alias("low"),
                              (F.col("q3") + spread).alias("high"))

    def pick(measure: str, side: str):
        return F.max(F.when(F.col("measure") == measure, F.col(side)))

    return bounds.agg(
        pick("quantity", "low").alias("quantity_lower"),
        pick("quantity", "high").alias("quantity_upper"),
        pick("price", "low").alias("price_lower"), pick("price", "high").alias("price_upper"))


def outlier_flags(flagged: DataFrame, thresholds: DataFrame | None,
                  cfg: CleaningSettings = CleaningSettings()) -> DataFrame:
    """Outside the inclusive bounds of ``thresholds`` (none: never), or beyond the domain limits."""
    if thresholds is None:
        quantity_out, price_out = F.lit(False), F.lit(False)
    else:
        bounds = thresholds.select(F.struct(
            "quantity_lower", "quantity_upper", "price_lower", "price_upper").alias("t")).scalar()
        flagged = flagged.withColumn("__t", bounds)
        quantity_out = ~F.col("quantity").cast("double").between(
            F.col("__t.quantity_lower"), F.col("__t.quantity_upper"))
        price_out = ~F.col("price").cast("double").between(
            F.col("__t.price_lower"), F.col("__t.price_upper"))
    beyond = ((F.abs("quantity") > cfg.quantity_limit)
              | (F.col("price") > F.lit(cfg.price_limit).cast("decimal(18,4)")))
    return flagged.withColumns({
        "is_quantity_iqr_outlier": quantity_out, "is_price_iqr_outlier": price_out,
        "is_statistical_outlier": quantity_out | price_out,
        "is_likely_data_error": F.coalesce(beyond, F.lit(False)),
    }).drop("__t")


def eligibility(flagged: DataFrame) -> DataFrame:
    valid = (F.col("is_product") & ~F.col("is_non_positive_price") & ~F.col("is_zero_quantity")
             & ~F.col("is_likely_data_error"))
    positive = valid & (F.col("quantity") > 0) & ~F.col("is_cancelled_invoice")
    value = line_value(F.col("quantity"), F.col("price"))
    nothing = F.lit(0).cast("decimal(18,4)")
    return flagged.withColumns({
        "is_valid_merchandise": valid, "is_positive_purchase": positive,
        "signed_merchandise_value": F.when(valid, value).otherwise(nothing),
        "gross_positive_value": F.when(positive, value).otherwise(nothing),
    })


def clean(lines: DataFrame, cfg: CleaningSettings = CleaningSettings(),
          thresholds: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Distinct lines with every audit flag; nothing but exact copies is removed.

    ``distinct`` says that ``lines`` hold no copies, so none are looked for.
    """
    rows = lines if distinct else without_duplicates(lines)
    return eligibility(outlier_flags(quality_flags(rows, cfg), thresholds, cfg))


def refitted(cleaned: DataFrame, cfg: CleaningSettings, thresholds: DataFrame) -> DataFrame:
    """Clean lines as ``clean`` gives them with these thresholds and limits, from lines cleaned with others.

    The administrative codes of ``cfg`` must be those of ``cleaned``.
    """
    return eligibility(outlier_flags(cleaned, thresholds, cfg))


def cleaning_summary(lines: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row of ten counts."""
    counted = cleaned.agg(
        F.count(F.lit(1)).alias("output_rows"),
        flag_count(F.col("is_missing_customer_id")).alias("missing_customer_rows"),
        flag_count(F.col("is_return")).alias("return_rows"),
        flag_count(F.col("is_cancelled_invoice")).alias("cancelled_invoice_rows"),
        flag_count(F.col("is_non_positive_price")).alias("non_positive_price_rows"),
        flag_count(F.col("is_administrative_line")).alias("administrative_rows"),
        flag_count(F.col("is_statistical_outlier")).alias("statistical_outlier_rows"),
        flag_count(F.col("is_likely_data_error")).alias("likely_data_error_rows"))
    total = lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("input_rows", total).withColumn(
        "exact_duplicates_removed", F.col("input_rows") - F.col("output_rows"))


def clean_violations(cleaned: DataFrame, source_columns: list[str]) -> DataFrame:
    """Rules a clean table must satisfy, as (rule, failures); all zero when sound."""
    copies = (cleaned.groupBy(*source_columns).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("x")))
    counts = cleaned.agg(
        F.count_if(F.col("is_positive_purchase") & F.col("is_return")).alias("positive_return"),
        F.count_if(F.col("is_positive_purchase") & ~F.col("is_valid_merchandise"))
        .alias("positive_not_valid"),
        F.count_if(F.col("gross_positive_value") < 0).alias("negative_gross"))
    return counts.withColumn("remaining_duplicates", copies.scalar()).selectExpr(
        "stack(4, 'remaining_duplicates', remaining_duplicates, 'positive_return', positive_return,"
        " 'positive_not_valid', positive_not_valid, 'negative_gross', negative_gross)"
        " as (rule, failures)")

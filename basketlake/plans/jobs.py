"""Whole jobs made of the operators: data foundation, training, batch scoring, final evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.operators import (
    cleaning, evaluation, features, kmeans, models, products, rolling, segments, sequences, serving,
    snapshots)
from basketlake.session import materialize
from basketlake.settings import BEHAVIOUR_FEATURES, DEFAULTS, Settings
from basketlake.sources.sinks import write_tables


@dataclass(frozen=True)
class ProductTables:
    """Frozen product tables a scoring run needs."""

    taxonomy: DataFrame
    n_categories: int
    prices: DataFrame
    popular: DataFrame


@dataclass(frozen=True)
class ModelSet:
    """Frozen models and thresholds of one training run."""

    feature_names: tuple[str, ...]
    churn: PipelineModel
    churn_threshold: float
    value: models.ValueModel
    category: PipelineModel | models.BoostedCategory
    anomaly: models.AnomalyModel
    anomaly_limit: float
    prepared: PipelineModel
    kmeans: kmeans.Clusters
    segment_names: DataFrame
    sequence: PipelineModel
    sequence_scaler: DataFrame


def build_foundation(lines: DataFrame, taxonomy: DataFrame, n_categories: int, root: str,
                     cfg: Settings = DEFAULTS, markdown_ratio: float | None = None
                     ) -> dict[str, str]:
    """Clean lines, split, product tables and both labelled feature tables, written under ``root``.

    Every stage is written before the next one reads it, so no plan grows over the whole run.
    """
    spark = lines.sparkSession

    def stage(name: str, frame: DataFrame) -> DataFrame:
        return spark.read.parquet(write_tables({name: frame}, root)[name])

    first = stage("transactions_preclean", cleaning.clean(lines, cfg.cleaning))
    cut = stage("cutoffs", snapshots.canonical_cutoffs(first, cfg.snapshots))
    churn_cut, clv_cut = (cut.select(c).scalar() for c in ("churn_cutoff", "clv_cutoff"))
    split = stage("customer_split", snapshots.split_customers(
        snapshots.eligible_customers(first, clv_cut), cfg.split))
    training = snapshots.customers_in(split, "train")
    limits = stage("outlier_thresholds", cleaning.outlier_thresholds(
        first.where(F.col("invoice_date") < clv_cut), training, cfg.cleaning))
    # Flags with thresholds are added to the distinct lines already written: no second dedup.
    clean = stage("transactions_clean", cleaning.eligibility(
        cleaning.outlier_flags(first, limits, cfg.cleaning)))
    history = products.training_history(clean, training, clv_cut)
    prices = stage("product_reference_prices", products.reference_prices(history, cfg.products))
    popular = stage("product_frequency_encoding", products.popularity(history, cfg.products))
    customers = split.select("customer_id")

    def table(cutoff: Column) -> DataFrame:
        return features.customer_features(
            clean, customers, cutoff, taxonomy, n_categories, prices, popular, training,
            cfg.snapshots.trend_days, markdown_ratio or cfg.products.markdown_ratio)

    return write_tables({
        "outlier_audit": clean.where("is_statistical_outlier"),
        "customer_features_churn": snapshots.labelled_table(
            table(churn_cut), snapshots.churn_labels(clean, customers, churn_cut,
                                                     cfg.snapshots.churn_days), split),
        "customer_features_clv": snapshots.labelled_table(
            table(clv_cut), snapshots.clv_targets(clean, customers, clv_cut,
                                                  cfg.snapshots.clv_days), split),
    }, root) | {n: f"{root}/{n}" for n in (
        "transactions_clean", "customer_split", "product_reference_prices",
        "product_frequency_encoding")}


def train_models(churn_table: DataFrame, rolling_table: DataFrame, category_table: DataFrame,
                 padded: DataFrame, sequence_scaler: DataFrame, feature_names: Sequence[str],
                 n_categories: int, cfg: Settings = DEFAULTS, trees: int = 200, depth: int = 8,
                 search_categories: bool = False) -> ModelSet:
    """Fit every production family on train rows; thresholds come from validation rows.

    With ``search_categories`` the next category is the winner of the search over boosted candidates,
    which takes hundreds of passes; without it, a forest.
    """
    names = tuple(feature_names)
    train, validation = (churn_table.where(F.col("partition") == p)
                         for p in ("train", "validation"))
    family = models.churn_families(train.count(), len(names))["random_forest"]
    family = models.Family(family.estimator, family.scale, (
        {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": 5,
         "featureSubsetStrategy": "sqrt"},))
    churn = models.fit_binary(train, names, family)
    curve = evaluation.precision_recall_curve(
        materialize(models.score_binary(churn, validation, names)), "churn", "probability_1",
        cfg.selection.beta)
    threshold = float(evaluation.best_threshold(curve, cfg.selection.min_recall).first().threshold)

    dev = rolling_table.where(F.col("partition") == "train")
    value = models.value_fits(rolling.CLV_FEATURES)["ridge_log1p"](dev)
    known = category_table.where(F.col("partition") == "train")
    category = models.search_next_category(known, names)[0] if search_categories else models.fit_next_category(known, names)
    anomaly = models.fit_anomaly(train, BEHAVIOUR_FEATURES)
    errors = materialize(anomaly.errors(validation).select("anomaly_score"))
    limit = float(errors.select(models.anomaly_threshold(
        errors, cfg.selection.anomaly_quantile).alias("limit")).first()[0])
    prepared, picked, _ = segments.search(train, BEHAVIOUR_FEATURES, mixtures=())
    assigned = segments.assign(train, BEHAVIOUR_FEATURES, prepared, picked)
    labels = segments.business_labels(segments.profiles(
        assigned.join(train.drop("partition"), "customer_id"), "kmeans_segment",
        BEHAVIOUR_FEATURES), "kmeans_segment").select(
        F.col("kmeans_segment").alias("segment_id"), F.col("business_label").alias("segment_name"))
    sequence = models.fit_sequence_model(
        padded.where(F.col("partition") == "train"), n_categories)
    return ModelSet(names, churn, threshold, value, category, anomaly, limit, prepared,
                    picked["kmeans"], materialize(labels), sequence, sequence_scaler)


def prepare_batch(upload: DataFrame, tables: ProductTables, engagement_fit: DataFrame,
                  cfg: Settings = DEFAULTS, markdown_ratio: float | None = None,
                  rolling_cfg: rolling.RollingSettings | None = None
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, forward-value features, latest sequences) of every customer of an upload.

    The cutoff is one second after the last line; outlier thresholds are not refitted, and the
    engagement percentiles stay those of ``engagement_fit``.
    """
    clean = materialize(cleaning.clean(upload, cfg.cleaning))
    cutoff = clean.agg((F.max("invoice_date") + F.expr("interval 1 second")).alias("c")).scalar()
    customers = snapshots.eligible_customers(clean, cutoff)
    table = features.customer_features(
        clean, customers, cutoff, tables.taxonomy, tables.n_categories, tables.prices,
        tables.popular, customers, cfg.snapshots.trend_days,
        markdown_ratio or cfg.products.markdown_ratio, fitted=engagement_fit)
    table = table.join(serving.latest_country(clean), "customer_id", "left")
    value = rolling.clv_features_at(clean, customers, cutoff, rolling_cfg or cfg.rolling)
    events = materialize(sequences.invoice_events(clean, tables.taxonomy))
    return table, value, sequences.latest_sequences(events, cutoff, cfg.sequences)


def score_batch(table: DataFrame, value: DataFrame, latest: DataFrame, fitted: ModelSet,
                n_categories: int, cfg: Settings = DEFAULTS) -> DataFrame:
    """All frozen models on every customer, in the fixed export columns.

    Models run one after the other on the same rows; only value and sequence scores are joined.
    """
    names = list(fitted.feature_names)
    rows = models.score_binary(fitted.churn, table, names, "churn_probability")
    rows = models.score_next_category(fitted.category, rows, names, labelled=False)
    rows = fitted.anomaly.errors(rows).drop("scaled", "rebuilt", "squared_errors",
                                            "class_probabilities")
    points = models.transform(fitted.prepared, rows, BEHAVIOUR_FEATURES)
    rows = fitted.kmeans.assigned(points, vector_to_array("features"), "segment_id").select(*rows.columns, "segment_id")
    worth = fitted.value.predict(value, "predicted_clv_180d").select(
        "customer_id", F.greatest("predicted_clv_180d", F.lit(0.0)).alias("predicted_clv_180d"))
    padded = sequences.padded(latest, fitted.sequence_scaler, cfg.sequences.length)
    chance = models.score_sequences(fitted.sequence, padded, n_categories).select(
        "customer_id", F.col("probability_1").alias("next_purchase_probability"))
    joined = (rows.join(worth, "customer_id", "left").join(chance, "customer_id", "left")
              .join(F.broadcast(fitted.segment_names), "segment_id", "left"))
    scored = joined.withColumns({
        "as_of_timestamp": F.col("cutoff_timestamp"),
        "churn_threshold": F.lit(fitted.churn_threshold),
        "churn_label": F.col("churn_probability") >= F.lit(fitted.churn_threshold),
        "anomaly_flag": F.col("anomaly_score") >= F.lit(fitted.anomaly_limit),
        "next_category_id": F.col("predicted_category"),
        "prediction_id": F.xxhash64("customer_id", "cutoff_timestamp"),
        "segment_name": F.coalesce("segment_name", F.concat(
            F.lit("Segment "), F.col("segment_id").cast("string"))),
        "model_version": F.lit("models-v1"), "persisted": F.lit(False)})
    return serving.batch_results(scored)


def final_evaluation(fitted: ModelSet, churn_table: DataFrame, rolling_features: DataFrame,
                     category_table: DataFrame, test_sequences: DataFrame, n_categories: int,
                     cfg: Settings = DEFAULTS) -> DataFrame:
    """Held-out metrics of every frozen model as (model, metric, value) rows; test rows only."""
    def test(frame: DataFrame) -> DataFrame:
        return frame.where(F.col("partition") == "test")

    def long(frame: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
        return frame.selectExpr(f"'{name}' as model",
                                f"stack({len(metrics)}, {pairs}) as (metric, value)")

    binary = ("accuracy", "precision", "recall", "f1", "roc_auc")
    names = list(fitted.feature_names)
    churn = models.binary_report(
        materialize(models.score_binary(fitted.churn, test(churn_table), names)
                    .select("churn", "probability_1")), "churn",
        threshold=fitted.churn_threshold)
    value = evaluation.regression_metrics(
        fitted.value.predict(test(rolling_features)), "clv_180d_target", "predicted")
    category = evaluation.multiclass_metrics(materialize(models.score_next_category(
        fitted.category, test(category_table), names).select("class_index", "class_probabilities")),
        "class_index", "class_probabilities")
    errors = fitted.anomaly.errors(test(churn_table)).agg(
        F.avg("anomaly_score").alias("error_mean"), F.max("anomaly_score").alias("error_max"),
        F.avg((F.col("anomaly_score") >= F.lit(fitted.anomaly_limit)).cast("double"))
        .alias("flagged_rate"))
    padded = sequences.padded(test(test_sequences), fitted.sequence_scaler, cfg.sequences.length)
    purchase = models.binary_report(materialize(models.score_sequences(
        fitted.sequence, padded, n_categories).select("label", "probability_1")), "sequence", "label")
    parts = [long(churn, "churn", binary), long(value, "value", ("mae", "rmse", "r2")),
             long(category, "next_category", ("macro_f1", "top_1_accuracy", "top_k_accuracy")),
             long(errors, "anomaly", ("error_mean", "error_max", "flagged_rate")),
             long(purchase, "purchase_30d", binary)]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total

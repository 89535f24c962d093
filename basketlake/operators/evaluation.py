"""Folds, class weights, metrics, thresholds and selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import ratio
from basketlake.functions.distributed import hashed_rank, running_totals, value_rank
from basketlake.settings import RollingSettings, SelectionSettings


# --- weights and folds --------------------------------------------------------------------------
def class_weights(table: DataFrame, label: str = "churn") -> DataFrame:
    """n / (classes * n_label) per label, and negatives / positives as ``pos_weight``."""
    counts = table.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"),
        F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("negatives"),
        F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("positives"))
    return counts.withColumn("__t", totals.select(F.struct(*totals.columns).alias("t")).scalar()
                             ).select(
        label, "n", (F.col("__t.all") / (F.col("__t.classes") * F.col("n"))).alias("class_weight"),
        ratio(F.col("__t.negatives"), F.col("__t.positives")).alias("pos_weight"))


def with_class_weight(table: DataFrame, label: str) -> DataFrame:
    """Adds ``class_weight``; there is one weight row per class, so it is broadcast."""
    weights = class_weights(table, label).select(label, "class_weight")
    return table.join(F.broadcast(weights), label)


def stratified_folds(table: DataFrame, label: str, folds: int = 5, seed: int = 42,
                     identity: str = "customer_id") -> DataFrame:
    """Adds ``fold``: rows of each label dealt out in seeded hash order."""
    ranked = hashed_rank(table, identity, str(seed), [label], rank="__r", size="__n")
    return ranked.withColumn("fold", ((F.col("__r") - 1) % folds).cast("int")).drop("__r", "__n")


def quantile_bins(table: DataFrame, value: str, identity: str = "customer_id", bins: int = 10,
                  seed: int = 42) -> DataFrame:
    """Adds ``bin``: equal-count bins of the rank of ``value`` (ties in seeded hash order)."""
    total = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = value_rank(table, value, identity, str(seed), rank="__rank")
    edge = F.ceil((F.col("__rank") - 1) * F.lit(bins) / F.greatest(total - 1, F.lit(1))) - 1
    return ranked.withColumn("bin", F.greatest(edge, F.lit(0)).cast("int")).drop("__rank")


def grouped_folds(table: DataFrame, stratum: str, folds: int = 5, seed: int = 42,
                  group: str = "customer_id") -> DataFrame:
    """Adds ``fold`` so that all rows of a customer share one; dealt out per largest stratum."""
    people = table.groupBy(group).agg(F.max(stratum).alias("__stratum"))
    dealt = stratified_folds(people, "__stratum", folds, seed, group).select(group, "fold")
    return table.join(dealt, group)


def fold_violations(table: DataFrame, group: str = "customer_id") -> DataFrame:
    """Customers found in more than one fold."""
    return (table.groupBy(group).agg(F.count_distinct("fold").alias("n"))
            .agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 1).alias("crossing")))


# --- metrics ------------------------------------------------------------------------------------
def binary_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5,
                   by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1 of score >= threshold."""
    hit, actual = F.col(score) >= F.lit(threshold), F.col(label) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(hit & actual).alias("tp"), F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"), F.count_if(~hit & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def _score_counts(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, so ties and hot scores are a single row each."""
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("p"))


def roc_auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with average ranks on ties, per group of ``by`` (few groups)."""
    counts = _score_counts(scored, label, score, by)
    ranked = running_totals(counts, "score", {"upto": "n"}, by)
    average_rank = F.col("upto") - (F.col("n") - 1) / 2.0
    sums = ranked.groupBy(*by).agg(
        F.sum(average_rank * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, ratio(F.col("s") - p * (p + 1) / 2.0, p * n, None).alias("roc_auc"))


def regression_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
                       ) -> DataFrame:
    y, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    sums = scored.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("sse"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, "mae", "rmse",
                       (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"))


def precision_recall_curve(scored: DataFrame, label: str, score: str, beta: float = 2.0
                           ) -> DataFrame:
    """One row per distinct score t: precision, recall and F-beta of score >= t."""
    counts = _score_counts(scored, label, score)
    positives = counts.agg(F.sum("p").alias("t")).scalar()
    ranked = running_totals(counts, "score", {"flagged": "n", "caught": "p"}, descending=True)
    square = beta * beta
    curve = ranked.select(
        F.col("score").alias("threshold"),
        ratio(F.col("caught"), F.col("flagged")).alias("precision"),
        ratio(F.col("caught"), positives).alias("recall"))
    down = square * F.col("precision") + F.col("recall")
    return curve.withColumn(
        "f_beta", ratio((1 + square) * F.col("precision") * F.col("recall"), down))


def best_threshold(curve: DataFrame, min_recall: float = 0.70) -> DataFrame:
    """The row of largest F-beta with enough recall; ties by recall, precision, threshold."""
    return curve.where(F.col("recall") >= min_recall).orderBy(
        F.desc("f_beta"), F.desc("recall"), F.desc("precision"), F.desc("threshold")).limit(1)


def multiclass_metrics(scored: DataFrame, label: str, probabilities: str, k: int = 3) -> DataFrame:
    """macro-F1, top-1 and top-k accuracy; ``probabilities`` is an array indexed by class.

    Rows shrink to (actual, predicted) counts before classes are compared.
    """
    p = F.col(probabilities)
    own = F.element_at(p, F.col(label).cast("int") + 1)
    # Place of the true class: classes with larger probability, or equal and listed earlier.
    place = F.aggregate(
        F.sequence(F.lit(1), F.size(p)), F.lit(0),
        lambda acc, i: acc + F.when(
            (F.element_at(p, i) > own)
            | ((F.element_at(p, i) == own) & (i < F.col(label).cast("int") + 1)), 1).otherwise(0))
    predicted = F.array_position(p, F.array_max(p)).cast("int") - 1
    counts = (scored.select(F.col(label).cast("int").alias("y"), predicted.alias("z"),
                            (place < k).cast("bigint").alias("near"))
              .groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near")))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), "n", F.lit(1).alias("is_y"),
                 (F.col("y") == F.col("z")).cast("int").alias("ok")),
        F.struct(F.col("z").alias("c"), "n", F.lit(0).alias("is_y"), F.lit(0).alias("ok")),
    )).alias("e")).select("e.*")
    per_class = sides.groupBy("c").agg(
        F.sum(F.col("n") * F.col("is_y")).alias("actual"),
        F.sum(F.col("n") * (1 - F.col("is_y"))).alias("flagged"),
        F.sum(F.col("n") * F.col("ok")).alias("tp"))
    macro = per_class.agg(F.avg(ratio(2 * F.col("tp"), F.col("actual") + F.col("flagged")))
                          .alias("m")).scalar()
    total = F.sum("n")
    return counts.agg(
        (F.sum(F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)) / total)
        .alias("top_1_accuracy"), (F.sum("near") / total).alias("top_k_accuracy"),
        total.alias("n_rows")).withColumn("macro_f1", macro)


def macro_f1(scored: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``n_rows``, ``accuracy`` and ``macro_f1`` of predicted classes, over the classes that occur on either side."""
    counts = scored.groupBy(*by, F.col(label).alias("y"), F.col(predicted).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    hit = (F.col("y") == F.col("z")).cast("int")
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("c"), "n", F.col("n").alias("own"), (hit * F.col("n")).alias("tp")),
        F.struct(F.col("z").alias("c"), "n", F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("tp")))).alias("e"))
    per_class = sides.groupBy(*by, "e.c").agg(F.sum("e.n").alias("both"), F.sum("e.own").alias("own"), F.sum("e.tp").alias("tp"))
    return per_class.groupBy(*by).agg(
        F.sum("own").alias("n_rows"), (F.sum("tp") / F.sum("own")).alias("accuracy"),
        F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"))


def popular_class_baseline(train: DataFrame, validation: DataFrame, label: str, k: int = 3
                           ) -> DataFrame:
    """Accuracy of always naming the most frequent training classes."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: a few dozen at most.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), label)
    places = counts.withColumn("place", F.row_number().over(order)).select(label, "place")
    joined = validation.select(label).join(F.broadcast(places), label, "left")
    return joined.agg(
        F.avg(F.coalesce(F.col("place") == 1, F.lit(False)).cast("double")).alias("top_1_accuracy"),
        F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")).alias("top_k_accuracy"),
        F.count(F.lit(1)).alias("n_rows"))


# --- comparison and selection -------------------------------------------------------------------
def consolidated_comparison(parts: Sequence[DataFrame]) -> DataFrame:
    """All metric rows, best first. Rows that saw held-out data are refused."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    checked = F.when(F.col("held_out_test_accessed"), F.raise_error(
        F.concat(F.lit("held-out data was used by "), "model"))).otherwise(F.col("model"))
    return rows.withColumn("model", checked).orderBy(
        F.desc("validation_roc_auc"), F.desc("validation_recall"))


def select_churn_model(comparison: DataFrame, cfg: SelectionSettings = SelectionSettings()
                       ) -> DataFrame:
    """Enough recall, AUC within the tolerance of the best; then recall, AUC, name."""
    fit = comparison.where(F.col("validation_recall") >= cfg.min_recall)
    best = fit.agg(F.max("validation_roc_auc").alias("b")).scalar()
    return fit.where(F.col("validation_roc_auc") >= best - cfg.auc_tolerance).orderBy(
        F.desc("validation_recall"), F.desc("validation_roc_auc"), "model").limit(1)


def cap_to_training_range(predicted: DataFrame, prediction: str, training: DataFrame, target: str
                          ) -> DataFrame:
    top = training.agg(F.max(target).cast("double").alias("m")).scalar()
    return predicted.withColumn(prediction, F.least(F.greatest(F.col(prediction), F.lit(0.0)), top))


def candidate_summary(fold_rows: DataFrame, validation_rows: DataFrame,
                      cfg: RollingSettings = RollingSettings()) -> DataFrame:
    """Per model: fold statistics, validation metrics, eligibility and its reasons; best first."""
    folds = fold_rows.groupBy("model").agg(
        F.avg("r2").alias("cv_r2_mean"), F.percentile("r2", 0.5).alias("cv_r2_median"),
        F.min("r2").alias("cv_r2_min"), F.stddev_pop("r2").alias("cv_r2_std"),
        F.avg("mae").alias("cv_mae_mean"), F.avg("rmse").alias("cv_rmse_mean"))
    both = folds.join(validation_rows.select(
        "model", F.col("r2").alias("validation_r2"), F.col("mae").alias("validation_mae"),
        F.col("rmse").alias("validation_rmse")), "model")

    def when(bad: Column, text: str) -> Column:
        return F.when(bad, F.lit(text))

    reasons = F.concat_ws(
        "; ", when(F.col("cv_r2_mean") <= 0, "mean CV R2 is not positive"),
        when(F.col("cv_r2_median") <= 0, "median CV R2 is not positive"),
        when(F.col("validation_r2") <= 0, "validation R2 is not positive"),
        when(F.col("cv_r2_min") < cfg.catastrophic_r2,
             "minimum fold R2 is catastrophically unstable"))
    return (both.withColumn("__why", reasons).withColumn("eligible", F.col("__why") == "")
            .withColumn("eligibility_reason", F.when(F.col("eligible"), "eligible")
                        .otherwise(F.col("__why"))).drop("__why")
            .orderBy(F.desc("eligible"), F.desc("cv_r2_mean"), F.desc("cv_r2_min"), "cv_r2_std",
                     F.desc("validation_r2"), "validation_rmse"))


def select_value_model(summary: DataFrame) -> DataFrame:
    """The first eligible candidate in the order of ``candidate_summary``; empty when none is."""
    return summary.where("eligible").orderBy(
        F.desc("cv_r2_mean"), F.desc("cv_r2_min"), "cv_r2_std", F.desc("validation_r2"),
        "validation_rmse").limit(1)


def select_by_validation(comparison: DataFrame) -> DataFrame:
    """The older rule: validation R2, then RMSE."""
    return comparison.orderBy(F.desc("validation_r2"), "validation_rmse").limit(1)

"""Folds, metrics and selection rules as queries, on scores made by formula from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions.columns import r6
from basketlake.operators import evaluation, folds, sequences
from basketlake.plans.catalogue.registry import block, query


def shown(frame, digits: int = 6):
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                          for c, t in frame.dtypes])


@query("h1_class_weights", """
SELECT churn, n, round(alln / (2.0 * n), 6) AS class_weight, round(neg / pos, 6) AS pos_weight
FROM (SELECT churn, count(*) AS n FROM labelled WHERE partition_name = 'train' GROUP BY churn),
     (SELECT CAST(count(*) AS DOUBLE) AS alln,
             CAST(count(*) FILTER (churn = 0) AS DOUBLE) AS neg,
             CAST(count(*) FILTER (churn = 1) AS DOUBLE) AS pos
      FROM labelled WHERE partition_name = 'train')""")
def class_weights(ws):
    return shown(evaluation.class_weights(ws.churn_table.where("partition = 'train'")))


@query("h2_stratified_folds", """
SELECT customer_id, churn, CAST((row_number() OVER (PARTITION BY churn
         ORDER BY md5('42|' || customer_id), customer_id) - 1) % 5 AS INTEGER) AS fold
FROM labelled WHERE partition_name = 'train'""")
def stratified_folds(ws):
    rows = ws.churn_table.where("partition = 'train'").select("customer_id", "churn")
    return evaluation.stratified_folds(rows, "churn").select("customer_id", "churn", "fold")


block("value_bins", """
SELECT customer_id, CAST(greatest(ceil((r - 1) * 10.0 / (n - 1)) - 1, 0) AS INTEGER) AS bin
FROM (SELECT customer_id, count(*) OVER () AS n, row_number() OVER (
        ORDER BY ln(1 + clv_180d_target), md5('42|' || customer_id), customer_id) AS r
      FROM clv_values JOIN trainers USING (customer_id))""")


@query("h3_quantile_folds", """
SELECT customer_id, bin, CAST((row_number() OVER (PARTITION BY bin
         ORDER BY md5('42|' || customer_id), customer_id) - 1) % 5 AS INTEGER) AS fold
FROM value_bins""")
def quantile_folds(ws):
    rows = ws.clv_table.where("partition = 'train'").select(
        "customer_id", F.log1p("clv_180d_target").alias("target"))
    binned = evaluation.quantile_bins(rows, "target")
    return evaluation.stratified_folds(binned, "bin").select("customer_id", "bin", "fold")


# Rank bins of log1p of the target over all training snapshots; a customer counts by its highest.
block("stratum", """
SELECT customer_id, max(bin) AS s, count(*) AS n FROM (
  SELECT customer_id, CAST(greatest(ceil((r - 1) * 10.0 / (k - 1)) - 1, 0) AS INTEGER) AS bin
  FROM (SELECT customer_id, count(*) OVER () AS k, row_number() OVER (
          ORDER BY ln(1 + clv_180d_target), md5('42|' || snapshot), snapshot) AS r
        FROM (SELECT *, customer_id || '|' || strftime(cutoff, '%Y-%m-%d') AS snapshot
              FROM rolled_table WHERE partition_name = 'train'))) GROUP BY customer_id""")


def _binned(train, cfg):
    named = train.withColumn("__snapshot", F.concat(
        "customer_id", F.lit("|"), F.date_format("cutoff_timestamp", "yyyy-MM-dd"))).withColumn(
        "__target", F.log1p("clv_180d_target"))
    return evaluation.quantile_bins(named, "__target", "__snapshot", cfg.bins).drop("__snapshot", "__target")


def value_folds(train, cfg):
    """Training snapshots with ``bin`` and ``fold``: no customer in two folds, ten rank bins."""
    return evaluation.grouped_folds(_binned(train, cfg), "bin", cfg.folds)


def balanced_value_folds(train, cfg):
    """As ``value_folds``, with every bin shared evenly among the folds."""
    return folds.balanced_group_folds(_binned(train, cfg), "bin", cfg.bins, cfg.folds)


def _grouped(ws):
    rows = ws.rolling_table.where("partition = 'train'").select(
        "customer_id", "cutoff_timestamp", "clv_180d_target")
    return value_folds(rows, ws.settings.rolling)


@query("h4_grouped_folds", """
SELECT customer_id, n, CAST((row_number() OVER (PARTITION BY s
         ORDER BY md5('42|' || customer_id), customer_id) - 1) % 5 AS INTEGER) AS fold FROM stratum""")
def grouped_folds(ws):
    return _grouped(ws).groupBy("customer_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("h4_fold_isolation", """
SELECT count(*) AS customers, CAST(0 AS BIGINT) AS crossing FROM stratum""")
def fold_isolation(ws):
    return evaluation.fold_violations(_grouped(ws))


block("binned_snapshots", """
SELECT customer_id, CAST(greatest(ceil((r - 1) * 10.0 / (k - 1)) - 1, 0) AS INTEGER) AS bin
FROM (SELECT customer_id, count(*) OVER () AS k, row_number() OVER (
        ORDER BY ln(1 + clv_180d_target), md5('42|' || snapshot), snapshot) AS r
      FROM (SELECT *, customer_id || '|' || strftime(cutoff, '%Y-%m-%d') AS snapshot
            FROM rolled_table WHERE partition_name = 'train'))""")


def _balanced(ws):
    return ws.stage("balanced_folds", lambda: balanced_value_folds(ws.rolling_table.where("partition = 'train'").select(
        "customer_id", "cutoff_timestamp", "clv_180d_target"), ws.settings.rolling))


@query("h4_balanced_folds", """
SELECT bin, count(*) AS n, max(own) AS largest_customer, true AS within_bound
FROM (SELECT *, count(*) OVER (PARTITION BY bin, customer_id) AS own FROM binned_snapshots) GROUP BY bin""")
def balanced_folds(ws):
    """By bin: folds differ by no more rows than two of its largest customers have."""
    return folds.fold_balance(_balanced(ws), "bin", ws.settings.rolling.folds).select(
        "bin", "n", "largest_customer", (F.col("most") - F.col("fewest") <= 2 * F.col("largest_customer")).alias("within_bound"))


@query("h4_balanced_isolation", """
SELECT count(DISTINCT customer_id) AS customers, CAST(0 AS BIGINT) AS crossing FROM binned_snapshots""")
def balanced_isolation(ws):
    return evaluation.fold_violations(_balanced(ws))


# A churn score by formula, with many ties.
block("scored", """
SELECT customer_id, churn, partition_name, round(recency_days / (recency_days + 100.0), 2) AS score
FROM labelled""")


def scored(ws):
    days = F.col("recency_days")
    return ws.churn_table.select("customer_id", "churn", "partition",
                                 F.round(days / (days + 100.0), 2).alias("score"))


@query("h12_binary_metrics", """
SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
       round(coalesce(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
       round(coalesce(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1
FROM (SELECT count(*) FILTER (score >= 0.5 AND churn = 1) AS tp,
             count(*) FILTER (score >= 0.5 AND churn = 0) AS fp,
             count(*) FILTER (score < 0.5 AND churn = 1) AS fn,
             count(*) FILTER (score < 0.5 AND churn = 0) AS tn FROM scored)""")
def binary_metrics(ws):
    return shown(evaluation.binary_metrics(scored(ws), "churn", "score"))


@query("h13_roc_auc", """
SELECT partition_name AS "partition",
       round((sum(CASE WHEN churn = 1 THEN r + (peers - 1) / 2.0 ELSE 0 END) - p * (p + 1) / 2.0)
             / (p * (n - p)), 6) AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY partition_name ORDER BY score) AS r,
             count(*) OVER (PARTITION BY partition_name, score) AS peers,
             sum(churn) OVER (PARTITION BY partition_name) AS p,
             count(*) OVER (PARTITION BY partition_name) AS n FROM scored)
GROUP BY partition_name, p, n""")
def roc_auc(ws):
    return shown(evaluation.roc_auc(scored(ws), "churn", "score", ["partition"]))


block("value_predictions", """
SELECT customer_id, CAST(CAST(customer_id AS BIGINT) % 5 AS INTEGER) AS fold, model,
       clv_180d_target AS y,
       CASE model WHEN 'half' THEN 0.5 * clv_180d_target + 100.0 * (CAST(customer_id AS BIGINT) % 13)
                  WHEN 'double' THEN 2.0 * clv_180d_target + 1.0 ELSE 50000.0 END AS predicted
FROM clv_values, (SELECT unnest(['half', 'double', 'flat']) AS model)""")


def value_predictions(ws):
    y, number = F.col("clv_180d_target"), F.col("customer_id").cast("bigint")
    return ws.clv_table.select(
        "customer_id", (number % 5).cast("int").alias("fold"), y.alias("y"),
        F.explode(F.array(
            F.struct(F.lit("half").alias("model"), (0.5 * y + 100.0 * (number % 13)).alias("p")),
            F.struct(F.lit("double").alias("model"), (2.0 * y + 1.0).alias("p")),
            F.struct(F.lit("flat").alias("model"), F.lit(50000.0).alias("p")))).alias("e")).select(
        "customer_id", "fold", "y", "e.model", F.col("e.p").alias("predicted"))


def _regression_sql(keys: str) -> str:
    return f"""SELECT {keys}, avg(abs(y - predicted)) AS mae,
       sqrt(avg((y - predicted) * (y - predicted))) AS rmse,
       1 - sum((y - predicted) * (y - predicted)) / (var_pop(y) * count(*)) AS r2
FROM value_predictions"""


block("fold_metrics", _regression_sql("model, fold") + " WHERE fold < 4 GROUP BY model, fold")
block("validation_metrics", _regression_sql("model") + " WHERE fold = 4 GROUP BY model")


@query("h14_regression_metrics", """
SELECT model, fold, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2
FROM fold_metrics""")
def regression_metrics(ws):
    rows = value_predictions(ws).where("fold < 4")
    return evaluation.regression_metrics(rows, "y", "predicted", ["model", "fold"]).select(
        "model", "fold", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
        r6(F.col("r2")).alias("r2"))


# Three churn "models": the formula score, its coarse form, and its reverse.
block("model_scores", """
SELECT customer_id, churn, model, CASE model WHEN 'fine' THEN score
  WHEN 'coarse' THEN round(score, 1) ELSE 1 - score END AS s
FROM scored, (SELECT unnest(['fine', 'coarse', 'reverse']) AS model) WHERE partition_name = 'validation'""")
block("model_rows", """
SELECT m.model, accuracy AS validation_accuracy, recall AS validation_recall,
       auc AS validation_roc_auc FROM
  (SELECT model, count(*) FILTER ((s >= 0.5) = (churn = 1)) / CAST(count(*) AS DOUBLE) AS accuracy,
          count(*) FILTER (s >= 0.5 AND churn = 1) / CAST(count(*) FILTER (churn = 1) AS DOUBLE) AS recall
   FROM model_scores GROUP BY model) m JOIN
  (SELECT model, (sum(CASE WHEN churn = 1 THEN r + (peers - 1) / 2.0 ELSE 0 END) - p * (p + 1) / 2.0)
                 / (p * (n - p)) AS auc
   FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY s) AS r,
                count(*) OVER (PARTITION BY model, s) AS peers,
                sum(churn) OVER (PARTITION BY model) AS p, count(*) OVER (PARTITION BY model) AS n
         FROM model_scores) GROUP BY model, p, n) a USING (model)""")


def model_rows(ws):
    s = F.col("score")
    rows = scored(ws).where("partition = 'validation'").select(
        "customer_id", "churn", F.explode(F.create_map(
            F.lit("fine"), s, F.lit("coarse"), F.round(s, 1), F.lit("reverse"), 1 - s)
        ).alias("model", "s"))
    metrics = evaluation.binary_metrics(rows, "churn", "s", 0.5, ["model"])
    auc = evaluation.roc_auc(rows, "churn", "s", ["model"])
    return metrics.join(auc, "model").select(
        "model", F.col("accuracy").alias("validation_accuracy"),
        F.col("recall").alias("validation_recall"), F.col("roc_auc").alias("validation_roc_auc"),
        F.lit(False).alias("held_out_test_accessed"))


@query("h15_select_churn_model", """
SELECT model, round(validation_recall, 6) AS validation_recall,
       round(validation_roc_auc, 6) AS validation_roc_auc FROM model_rows
WHERE validation_recall >= 0.70 AND validation_roc_auc >= (
  SELECT max(validation_roc_auc) FROM model_rows WHERE validation_recall >= 0.70) - 0.01
ORDER BY validation_recall DESC, validation_roc_auc DESC, model LIMIT 1""")
def select_churn_model(ws):
    return shown(evaluation.select_churn_model(model_rows(ws)).select(
        "model", "validation_recall", "validation_roc_auc"))


block("curve", """
SELECT score AS threshold, prec, rec,
       coalesce(5 * prec * rec / NULLIF(4 * prec + rec, 0), 0) AS f_beta
FROM (SELECT score, caught / CAST(flagged AS DOUBLE) AS prec, caught / CAST(positives AS DOUBLE) AS rec
      FROM (SELECT score, sum(n) OVER (ORDER BY score DESC) AS flagged,
                   sum(p) OVER (ORDER BY score DESC) AS caught, sum(p) OVER () AS positives
            FROM (SELECT score, count(*) AS n, sum(churn) AS p FROM scored
                  WHERE partition_name = 'validation' GROUP BY score)))""")


def _curve(ws):
    return evaluation.precision_recall_curve(
        scored(ws).where("partition = 'validation'"), "churn", "score")


@query("h16_precision_recall_curve", """
SELECT threshold, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f_beta, 6) AS f_beta
FROM curve""")
def precision_recall_curve(ws):
    return shown(_curve(ws))


@query("h17_fbeta_threshold", """
SELECT threshold, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f_beta, 6) AS f_beta
FROM curve WHERE rec >= 0.70 ORDER BY f_beta DESC, rec DESC, prec DESC, threshold DESC LIMIT 1""")
def fbeta_threshold(ws):
    return shown(evaluation.best_threshold(_curve(ws)))


@query("h18_consolidated_comparison", """
SELECT model, round(validation_accuracy, 6) AS validation_accuracy,
       round(validation_recall, 6) AS validation_recall,
       round(validation_roc_auc, 6) AS validation_roc_auc FROM model_rows""")
def consolidated_comparison(ws):
    rows = model_rows(ws)
    parts = [rows.where("model = 'reverse'"), rows.where("model <> 'reverse'")]
    return shown(evaluation.consolidated_comparison(parts).drop("held_out_test_accessed"))


@query("h23_training_range_cap", """
SELECT customer_id, model, round(least(greatest(predicted - 1000.0, 0.0),
         (SELECT max(y) FROM value_predictions WHERE fold < 4)), 4) AS predicted
FROM value_predictions""")
def training_range_cap(ws):
    rows = value_predictions(ws)
    low = rows.withColumn("predicted", F.col("predicted") - 1000.0)
    return evaluation.cap_to_training_range(low, "predicted", rows.where("fold < 4"), "y").select(
        "customer_id", "model", F.round("predicted", 4).alias("predicted"))


block("candidates", """
SELECT f.*, v.r2 AS validation_r2, v.mae AS validation_mae, v.rmse AS validation_rmse,
       cv_r2_mean > 0 AND cv_r2_median > 0 AND v.r2 > 0 AND cv_r2_min >= -0.5 AS eligible,
       concat_ws('; ', CASE WHEN cv_r2_mean <= 0 THEN 'mean CV R2 is not positive' END,
         CASE WHEN cv_r2_median <= 0 THEN 'median CV R2 is not positive' END,
         CASE WHEN v.r2 <= 0 THEN 'validation R2 is not positive' END,
         CASE WHEN cv_r2_min < -0.5 THEN 'minimum fold R2 is catastrophically unstable' END) AS why
FROM (SELECT model, avg(r2) AS cv_r2_mean, median(r2) AS cv_r2_median, min(r2) AS cv_r2_min,
             stddev_pop(r2) AS cv_r2_std, avg(mae) AS cv_mae_mean, avg(rmse) AS cv_rmse_mean
      FROM fold_metrics GROUP BY model) f JOIN validation_metrics v USING (model)""")


def _summary(ws):
    rows = value_predictions(ws)
    return evaluation.candidate_summary(
        evaluation.regression_metrics(rows.where("fold < 4"), "y", "predicted", ["model", "fold"]),
        evaluation.regression_metrics(rows.where("fold = 4"), "y", "predicted", ["model"]))


@query("h24_evaluate_candidates", """
SELECT model, round(cv_r2_mean, 4) AS cv_r2_mean, round(cv_r2_median, 4) AS cv_r2_median,
       round(cv_r2_min, 4) AS cv_r2_min, round(cv_r2_std, 4) AS cv_r2_std,
       round(cv_mae_mean, 4) AS cv_mae_mean, round(cv_rmse_mean, 4) AS cv_rmse_mean,
       round(validation_r2, 4) AS validation_r2, round(validation_mae, 4) AS validation_mae,
       round(validation_rmse, 4) AS validation_rmse, eligible,
       CASE WHEN eligible THEN 'eligible' ELSE why END AS eligibility_reason FROM candidates""")
def evaluate_candidates(ws):
    return shown(_summary(ws), 4)


@query("h25_select_value_model", """
SELECT model FROM candidates WHERE eligible ORDER BY cv_r2_mean DESC, cv_r2_min DESC, cv_r2_std,
  validation_r2 DESC, validation_rmse LIMIT 1""")
def select_value_model(ws):
    return evaluation.select_value_model(_summary(ws)).select("model")


block("category_targets", """
SELECT customer_id, category_id FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, q DESC, category_id) AS r
  FROM (SELECT c.customer_id, coalesce(category_id, -1) AS category_id,
               sum(gross_positive_value) AS v, sum(quantity) AS q
        FROM cleaned c JOIN (
          SELECT customer_id, invoice, row_number() OVER (PARTITION BY customer_id
                   ORDER BY min(invoice_date), invoice) AS o
          FROM cleaned, cutoffs WHERE customer_id IS NOT NULL AND invoice_date >= clv_cutoff
            AND is_positive_purchase AND is_product GROUP BY customer_id, invoice) n
          ON n.customer_id = c.customer_id AND n.invoice = c.invoice AND o = 1
        LEFT JOIN catalogue USING (stock_code), cutoffs
        WHERE invoice_date >= clv_cutoff AND is_positive_purchase AND is_product
        GROUP BY ALL)) WHERE r = 1""")
block("class_scores", """
SELECT t.customer_id, category_id + 1 AS y, i AS c,
       ((CAST(t.customer_id AS BIGINT) * (i + 3) * 7) % 11) / 11.0 AS p
FROM category_targets t, (SELECT unnest(range(0, 6)) AS i)""")
block("class_places", """
SELECT customer_id, y, c, row_number() OVER (PARTITION BY customer_id ORDER BY p DESC, c) AS place
FROM class_scores""")


def category_labels(ws):
    return sequences.next_category(ws.clean, ws.taxonomy, ws.clv_cutoff).select(
        "customer_id", (F.col("next_category_id") + 1).alias("y"))


@query("h27_multiclass_metrics", """
SELECT (SELECT count(*) FROM class_places WHERE place = 1) AS n_rows,
  (SELECT round(avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) FROM class_places WHERE place = 1)
    AS top_1_accuracy,
  (SELECT round(sum(CASE WHEN c = y AND place <= 3 THEN 1.0 ELSE 0.0 END)
          / count(DISTINCT customer_id), 6) FROM class_places) AS top_k_accuracy,
  (SELECT round(avg(f1), 6) FROM (
     SELECT 2.0 * sum(CASE WHEN y = k AND c = k THEN 1 ELSE 0 END)
            / (sum(CASE WHEN y = k THEN 1 ELSE 0 END) + sum(CASE WHEN c = k THEN 1 ELSE 0 END)) AS f1
     FROM (SELECT * FROM class_places WHERE place = 1),
          (SELECT DISTINCT y AS k FROM class_places UNION
           SELECT c FROM class_places WHERE place = 1) GROUP BY k)) AS macro_f1""")
def multiclass_metrics(ws):
    number = F.col("customer_id").cast("bigint")
    rows = category_labels(ws).withColumn("p", F.transform(
        F.sequence(F.lit(0), F.lit(5)), lambda i: ((number * (i + 3) * 7) % 11) / 11.0))
    return shown(evaluation.multiclass_metrics(rows, "y", "p"))


block("class_order", """
SELECT y, row_number() OVER (ORDER BY count(*) DESC, y) AS place
FROM (SELECT category_id + 1 AS y FROM category_targets JOIN trainers USING (customer_id)) GROUP BY y""")


@query("h28_popular_class_baseline", """
SELECT round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1_accuracy,
       round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top_k_accuracy,
       count(*) AS n_rows
FROM (SELECT category_id + 1 AS y FROM category_targets JOIN split_table USING (customer_id)
      WHERE partition_name = 'validation') LEFT JOIN class_order USING (y)""")
def popular_class_baseline(ws):
    rows = category_labels(ws).join(ws.split.select("customer_id", "partition"), "customer_id")
    return shown(evaluation.popular_class_baseline(
        rows.where("partition = 'train'"), rows.where("partition = 'validation'"), "y"))

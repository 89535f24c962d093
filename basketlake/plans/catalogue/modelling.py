"""Model training, clustering, explanation and batch scoring as queries (rows-only checks)."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from basketlake.functions.columns import r6
from basketlake.operators import (
    evaluation, explain, feature_selection, mixtures, models, products, rolling, segments, sequences,
    taxonomy)
from basketlake.plans import jobs
from basketlake.plans.catalogue.evaluation import balanced_value_folds, category_labels, scored, shown
from basketlake.plans.catalogue.registry import block, query
from basketlake.plans.workspace import CATEGORIES, MARKDOWN_RATIO
from basketlake.session import materialize
from basketlake.settings import BEHAVIOUR_FEATURES

# The production candidate of each family where it is not the first: 200 trees of depth 8.
CANDIDATES = {"random_forest": 2}


# --- taxonomy -----------------------------------------------------------------------------------
def _weights(ws):
    return ws.stage("term_weights", lambda: products.tfidf(
        products.modal_descriptions(ws.training_lines), ws.settings.products))


def _embedded(ws):
    return ws.stage("embeddings", lambda: taxonomy.embeddings(
        _weights(ws), taxonomy.term_directions(_weights(ws), ws.settings.products)))


@query("d3_svd_embeddings", """
SELECT DISTINCT stock_code, CAST(least(50, (SELECT count(DISTINCT stock_code) FROM term_counts JOIN vocabulary USING (term)) - 1,
       (SELECT count(*) FROM vocabulary) - 1) AS INTEGER) AS dimensions, 1.0::DOUBLE AS length
FROM term_counts JOIN vocabulary USING (term)""")
def svd_embeddings(ws):
    weights = _weights(ws)
    points = taxonomy.embeddings(weights, taxonomy.term_directions(weights, ws.settings.products))
    x = vector_to_array("features")
    return points.select("stock_code", F.size(x).alias("dimensions"), F.sqrt(F.aggregate(
        x, F.lit(0.0), lambda s, v: s + v * v)).alias("length")).withColumn("length", F.round("length", 9))


def _taxonomy(ws):
    if "_taxonomy" not in ws.__dict__:
        ws.__dict__["_taxonomy"] = taxonomy.candidates(_embedded(ws), ws.settings.products)
    return ws.__dict__["_taxonomy"]


@query("d4_taxonomy_candidates")
def taxonomy_candidates(ws):
    return _taxonomy(ws)[1]


def _assigned(ws):
    return taxonomy.assign(_embedded(ws), _taxonomy(ws)[0],
                           products.modal_descriptions(ws.training_lines))


@query("d5_taxonomy_assignment")
def taxonomy_assignment(ws):
    return _assigned(ws).select("stock_code", "description_normalized", "category_id",
                                "taxonomy_version")


@query("d6_cluster_top_terms")
def cluster_top_terms(ws):
    return taxonomy.top_terms(_weights(ws), _assigned(ws))


# --- preprocessing and schema -------------------------------------------------------------------
def _train(ws):
    return ws.churn_table.where("partition = 'train'")


def _validation(ws):
    return ws.churn_table.where("partition = 'validation'")


def _model(ws, name, fit):
    """Fitted models are kept per workspace, so queries about one model share its fit."""
    kept = ws.__dict__.setdefault("_models", {})
    if name not in kept:
        kept[name] = fit()
    return kept[name]


@query("e15_preprocessing_contracts")
def preprocessing_contracts(ws):
    fitted = models.preprocessing_contracts(_train(ws), ws.feature_names)
    rows = models.transform(fitted["scaled"], ws.churn_table, ws.feature_names)
    return rows.select("customer_id", "partition", F.posexplode(vector_to_array("features")).alias(
        "position", "scaled"))


@query("g11_variance_inflation")
def variance_inflation(ws):
    usable = [c for c in ws.feature_names
              if c not in ("category_affinity_unknown", "historical_customer_value")]
    return feature_selection.vif(_train(ws), usable)


@query("g12_frozen_feature_schema")
def frozen_schema(ws):
    return feature_selection.freeze_schema(ws.churn_table, ws.feature_names)


def selected_features(ws):
    return _model(ws, "schema", lambda: [
        r.feature for r in frozen_schema(ws).where("selected").orderBy("position").collect()])


# --- churn --------------------------------------------------------------------------------------
def _family(ws, name):
    rows = _model(ws, "n_train", lambda: _train(ws).count())
    return models.churn_families(rows, len(selected_features(ws)))[name]


def _churn_model(ws, name):
    return _model(ws, f"churn_{name}", lambda: models.fit_binary(
        _train(ws), selected_features(ws), _family(ws, name), CANDIDATES.get(name, 0)))


@query("h5_grid_search")
def grid_search(ws):
    family = _family(ws, "logistic_regression")
    dealt = evaluation.stratified_folds(evaluation.with_class_weight(_train(ws), "churn"), "churn")
    fitted = models.grid_search(dealt, selected_features(ws), family, models.binary_evaluator())
    return models.search_report(fitted, family, ws.spark)


def _report(ws, name):
    # two metrics read the scores: they are written once
    score = ws.stage(f"churn_scores_{name}", lambda: models.score_binary(
        _churn_model(ws, name), _validation(ws), selected_features(ws)).select("churn", "probability_1"))
    return models.binary_report(score, name)


for _id, _name in (("h6_churn_logistic_regression", "logistic_regression"),
                   ("h7_churn_decision_tree", "decision_tree"),
                   ("h8_churn_random_forest", "random_forest"),
                   ("h9_churn_boosted_depth", "boosted_depth"),
                   ("h9_churn_boosted_leaves", "boosted_leaves"),
                   ("h10_churn_linear_svm", "linear_svm"),
                   ("h11_churn_feed_forward", "feed_forward")):
    query(_id)(lambda ws, name=_name: _report(ws, name))


# --- value --------------------------------------------------------------------------------------
def _value_report(ws, name):
    scored = ws.stage(f"value_scores_{name}", lambda: _value_model(ws, name).predict(
        ws.rolling_table.where("partition = 'validation'")).select(models.TARGET, "predicted"))
    return evaluation.regression_metrics(scored, models.TARGET, "predicted").withColumn("model", F.lit(name))


def _value_model(ws, name):
    return _model(ws, f"value_{name}", lambda: models.value_fits(rolling.CLV_FEATURES)[name](
        ws.rolling_table.where("partition = 'train'")))


for _id, _name in (("h19_value_ridge_log1p", "ridge_log1p"),
                   ("h20_value_boosted_log1p", "boosted_log1p"),
                   ("h20_value_boosted_squared_error", "boosted_squared_error"),
                   ("h21_value_tweedie", "tweedie")):
    query(_id)(lambda ws, name=_name: _value_report(ws, name))


@query("h22_value_hurdle")
def value_hurdle(ws):
    return _value_model(ws, "hurdle").predict(ws.rolling_table.where("partition = 'validation'")).select(
        "customer_id", F.date_format("cutoff_timestamp", "yyyy-MM-dd").alias("cutoff"),
        models.TARGET, "predicted")


@query("h24_value_cross_validation")
def value_cross_validation(ws):
    """Grouped cross-validation of all five candidates on the whole rolling table."""
    dataset = ws.rolling_table
    dealt = balanced_value_folds(dataset.where("partition = 'train'"), ws.settings.rolling).drop("bin")
    both = dealt.unionByName(dataset.where("partition = 'validation'").withColumn(
        "fold", F.lit(-1)))
    table = ws.stage("rolling_folds", lambda: both)
    per_fold, final = models.evaluate_value_candidates(table, models.fit_value_candidates(
        table, rolling.CLV_FEATURES, ws.settings.rolling.folds), ws.settings.rolling.folds)
    return evaluation.candidate_summary(per_fold, final)


# --- next category, sequences, anomalies --------------------------------------------------------
def category_table(ws):
    return ws.stage("category_table", lambda: ws.clv_table.join(
        category_labels(ws).select("customer_id", (F.col("y") - 1).alias("next_category_id")),
        "customer_id"))


@query("h26_next_category_model")
def next_category_model(ws):
    table, names = category_table(ws), ws.feature_names
    fitted = _model(ws, "category", lambda: models.fit_next_category(
        table.where("partition = 'train'"), names))
    rows = models.score_next_category(fitted, table.where("partition = 'validation'"), names)
    return evaluation.multiclass_metrics(rows, "class_index", "class_probabilities")


def _category_search(ws):
    return _model(ws, "category_search", lambda: models.search_next_category(
        category_table(ws).where("partition = 'train'"), ws.feature_names))


@query("h26_category_search")
def category_search(ws):
    """Macro-F1 of every boosted candidate and fold."""
    return _category_search(ws)[1]


@query("h26_category_winner")
def category_winner(ws):
    rows = models.score_next_category(_category_search(ws)[0], category_table(ws).where("partition = 'validation'"), ws.feature_names)
    return evaluation.multiclass_metrics(materialize(rows.select("class_index", "class_probabilities")),
                                         "class_index", "class_probabilities")


def padded_sequences(ws):
    table = ws.sequence_table
    return sequences.padded(table, _scaler(ws))


def _scaler(ws):
    return ws.stage("sequence_scaler", lambda: sequences.scaler(
        ws.sequence_table.where("partition = 'train'")))


def _sequence_model(ws):
    return _model(ws, "sequence", lambda: models.fit_sequence_model(
        padded_sequences(ws).where("partition = 'train'"), CATEGORIES))


@query("f10_purchase_within_30_days")
def purchase_model(ws):
    rows = ws.stage("sequence_scores", lambda: models.score_sequences(
        _sequence_model(ws), padded_sequences(ws).where("partition = 'validation'"), CATEGORIES).select(
        "label", "probability_1"))
    return models.binary_report(rows, "sequence_logistic", "label")


def _anomaly(ws):
    return _model(ws, "anomaly", lambda: models.fit_anomaly(_train(ws), BEHAVIOUR_FEATURES))


def _errors(ws):
    return ws.stage("anomaly_errors", lambda: _anomaly(ws).errors(
        _validation(ws).select("customer_id", *BEHAVIOUR_FEATURES)))


@query("h29_anomaly_scores")
def anomaly_scores(ws):
    errors = _errors(ws)
    return errors.select("customer_id", "anomaly_score").withColumn(
        "anomaly_flag", F.col("anomaly_score") >= models.anomaly_threshold(errors))


@query("h30_anomaly_contributions")
def anomaly_contributions(ws):
    errors = _errors(ws)
    return models.error_contributions(errors, BEHAVIOUR_FEATURES, models.anomaly_threshold(errors))


# --- segments -----------------------------------------------------------------------------------
def _segments(ws):
    return _model(ws, "segments", lambda: segments.search(_train(ws), BEHAVIOUR_FEATURES))


@query("i1_kmeans_search")
def kmeans_search(ws):
    return segments.search(_train(ws), BEHAVIOUR_FEATURES, mixtures=())[2]


@query("i2_mixture_search")
def mixture_search(ws):
    return _segments(ws)[2].where("algorithm = 'gmm'")


@query("i3_silhouette")
def silhouette(ws):
    """Of the chosen K-means model."""
    return _segments(ws)[2].where("selected AND algorithm = 'kmeans'").select(
        F.col("components").alias("clusters"), "silhouette")


_COORDINATES = BEHAVIOUR_FEATURES
_DISTANCE = " + ".join(f"(l.{c} - c.{c}) * (l.{c} - c.{c})" for c in _COORDINATES)
_APART = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _COORDINATES)
block("labelled_segments", """
SELECT labelled.*, segment_id FROM labelled JOIN segment_map USING (customer_id)""")
block("centres", f"""
SELECT segment_id, {', '.join(f'avg(CAST({c} AS DOUBLE)) AS {c}' for c in _COORDINATES)}
FROM labelled_segments GROUP BY segment_id""")
block("spreads", f"""
SELECT c.*, s FROM centres c JOIN (
  SELECT l.segment_id, avg(sqrt({_DISTANCE})) AS s FROM labelled_segments l
  JOIN centres c ON c.segment_id = l.segment_id GROUP BY l.segment_id) USING (segment_id)""")


def _labelled_segments(ws):
    from basketlake.plans.catalogue.recommending import segment_map
    return ws.churn_table.join(segment_map(ws), "customer_id")


@query("i4_davies_bouldin", f"""
SELECT round(avg(r), 6) AS davies_bouldin FROM (
  SELECT a.segment_id, max((a.s + b.s) / sqrt({_APART})) AS r FROM spreads a
  JOIN spreads b ON a.segment_id <> b.segment_id GROUP BY a.segment_id)""")
def davies_bouldin(ws):
    return segments.davies_bouldin(_labelled_segments(ws), "segment_id", _COORDINATES).select(
        r6(F.col("davies_bouldin")).alias("davies_bouldin"))


# The mixture that the given segments describe, and its fit to the same rows.
_KNOWN = [f"coalesce(CAST({c} AS DOUBLE), 0)" for c in _COORDINATES]
block("mixture_points", f"""
SELECT segment_id, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_KNOWN))} FROM labelled_segments""")
block("mixture_parts", f"""
SELECT segment_id, count(*) / CAST((SELECT count(*) FROM mixture_points) AS DOUBLE) AS w,
       {', '.join(f'avg(x{i}) AS m{i}, greatest(var_pop(x{i}), 0.00001) AS v{i}' for i in range(len(_KNOWN)))}
FROM mixture_points GROUP BY segment_id""")
_LOGS = " + ".join(f"(-0.5 * (ln(2 * pi() * v{i}) + (x{i} - m{i}) * (x{i} - m{i}) / v{i}))" for i in range(len(_KNOWN)))


def _points(ws):
    return _labelled_segments(ws).select("customer_id", "segment_id", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(_COORDINATES)])


@query("i2_mixture_of_segments", f"""
SELECT CAST((SELECT count(*) FROM mixture_parts) AS INTEGER) AS components, count(*) AS n,
       CAST((SELECT count(*) FROM mixture_parts) * {2 * len(_KNOWN) + 1} - 1 AS INTEGER) AS parameters,
       round(sum(l), 3) AS log_likelihood,
       round(((SELECT count(*) FROM mixture_parts) * {2 * len(_KNOWN) + 1} - 1) * ln(count(*)) - 2 * sum(l), 3) AS bic
FROM (SELECT customer_id, max(l) + ln(sum(exp(l - top))) AS l FROM (
        SELECT customer_id, l, max(l) OVER (PARTITION BY customer_id) AS top FROM (
          SELECT customer_id, ln(w) + {_LOGS} AS l
          FROM (SELECT row_number() OVER () AS customer_id, * FROM mixture_points) CROSS JOIN
               (SELECT * EXCLUDE segment_id FROM mixture_parts)))
      GROUP BY customer_id)""")
def mixture_of_segments(ws):
    names = [f"x{i}" for i in range(len(_COORDINATES))]
    points = _points(ws)
    return shown(mixtures.of_labels(points, "segment_id", names).measured(points, F.array(*names)), 3)


# Silhouette of the given segments by squared distances: mean distances come from sums of a segment.
_SIZE = " + ".join(f"x{i} * x{i}" for i in range(len(_KNOWN)))
block("silhouette_rows", f"""
SELECT row_number() OVER () AS r, *, {_SIZE} AS size FROM mixture_points""")
block("silhouette_sums", f"""
SELECT segment_id AS other, count(*) AS n, sum(size) AS total,
       {', '.join(f'sum(x{i}) AS y{i}' for i in range(len(_KNOWN)))} FROM silhouette_rows GROUP BY segment_id""")


@query("i3_silhouette_of_segments", f"""
SELECT CAST(count(DISTINCT segment_id) AS INTEGER) AS clusters,
       round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette
FROM (SELECT r, segment_id, min(d / (n - 1)) FILTER (same AND n > 1) AS own, min(d / n) FILTER (NOT same) AS other
      FROM (SELECT r, segment_id, segment_id = other AS same, n,
                   n * size + total - 2 * ({' + '.join(f'x{i} * y{i}' for i in range(len(_KNOWN)))}) AS d
            FROM silhouette_rows CROSS JOIN silhouette_sums) GROUP BY r, segment_id)""")
def silhouette_of_segments(ws):
    points = _points(ws).withColumn("features", array_to_vector(F.array(*[f"x{i}" for i in range(len(_COORDINATES))])))
    value = ClusteringEvaluator(predictionCol="segment_id").evaluate(points)
    return points.agg(F.count_distinct("segment_id").cast("int").alias("clusters"),
                      F.round(F.lit(float(value)), 6).alias("silhouette"))


@query("i5_segment_assignment")
def segment_assignment(ws):
    prepared, picked, _ = _segments(ws)
    return segments.assign(ws.churn_table.where("partition <> 'test'"), BEHAVIOUR_FEATURES, prepared,
                           picked)


_PROFILED = BEHAVIOUR_FEATURES


@query("i6_segment_profiles", f"""
SELECT segment_id, {', '.join(f'round(avg(CAST({c} AS DOUBLE)), 4) AS {c}' for c in _PROFILED)},
       count(*) AS customer_count FROM labelled_segments GROUP BY segment_id""")
def segment_profiles(ws):
    return shown(segments.profiles(_labelled_segments(ws), "segment_id", _PROFILED), 4)


block("profile_ranks", """
SELECT segment_id, round(-(rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0) / k
     + (rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0) / k
     + (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / k, 9) AS score
FROM (SELECT segment_id, avg(recency_days) AS r, avg(CAST(frequency_orders AS DOUBLE)) AS f,
             avg(net_spend) AS n, CAST(count(*) OVER () AS DOUBLE) AS k
      FROM labelled_segments GROUP BY segment_id)""")


@query("i7_business_labels", """
SELECT segment_id, ['Champions', 'Loyal High Value', 'Established', 'Developing', 'Occasional',
                    'At Risk', 'Dormant', 'Lowest Engagement'][
         row_number() OVER (ORDER BY score DESC, segment_id)] AS business_label FROM profile_ranks""")
def business_labels(ws):
    profile = segments.profiles(_labelled_segments(ws), "segment_id", _PROFILED)
    return segments.business_labels(profile, "segment_id").select("segment_id", "business_label")


@query("i8_projection_sample")
def projection_sample(ws):
    return segments.projection(_train(ws), ws.churn_table.where("partition <> 'test'"),
                               BEHAVIOUR_FEATURES)


# --- explanations -------------------------------------------------------------------------------
def _churn_scorer(ws, name="random_forest"):
    model, names = _churn_model(ws, name), selected_features(ws)
    return lambda rows: models.score_binary(model, rows, names)


@query("k1_churn_linear_importance")
def churn_linear_importance(ws):
    return explain.global_importance(explain.linear_contributions(
        _churn_model(ws, "logistic_regression"), _validation(ws), selected_features(ws)))


@query("k1_value_linear_importance")
def value_linear_importance(ws):
    fitted = _value_model(ws, "ridge_log1p")
    return explain.global_importance(explain.linear_contributions(
        fitted.pipeline, ws.rolling_table.where("partition = 'validation'"), rolling.CLV_FEATURES))


@query("k1_churn_permutation_importance")
def churn_permutation_importance(ws):
    return explain.permutation_importance(
        _churn_scorer(ws), _validation(ws), selected_features(ws), "churn")


@query("k1_category_permutation_importance")
def category_permutation_importance(ws):
    next_category_model(ws)
    fitted, names = ws.__dict__["_models"]["category"], ws.feature_names
    return explain.permutation_change(
        lambda rows: models.score_next_category(fitted, rows, names, labelled=False),
        category_table(ws).where("partition = 'validation'"), names, "next_category_probability")


def _drivers(ws):
    return ws.stage("drivers", lambda: explain.local_drivers(
        _churn_scorer(ws), _validation(ws), _train(ws), selected_features(ws)))


@query("k2_local_drivers")
def local_drivers(ws):
    return _drivers(ws)


def _tree_contributions(ws):
    """Shapley values of the log of the Tweedie trees' prediction, of every validation snapshot."""
    return ws.stage("tree_contributions", lambda: _value_model(ws, "tweedie").parts[0].contributions(
        ws.rolling_table.where("partition = 'validation'"), ["customer_id", "cutoff_timestamp"]))


@query("k1_value_tree_importance")
def value_tree_importance(ws):
    return explain.global_importance(_tree_contributions(ws))


@query("k2_value_tree_contributions", f"""
SELECT customer_id, strftime(cutoff, '%Y-%m-%d') AS cutoff, CAST({len(rolling.CLV_FEATURES)} AS BIGINT) AS features,
       0.0::DOUBLE AS gap FROM rolled_table WHERE partition_name = 'validation'""")
def value_tree_contributions(ws):
    """How far contributions and base together are from the raw score: nothing, for every snapshot."""
    total = _tree_contributions(ws).groupBy("customer_id", "cutoff_timestamp").agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("contribution") + F.first("base") - F.first("raw_score"), 6).alias("gap"))
    return total.select("customer_id", F.date_format("cutoff_timestamp", "yyyy-MM-dd").alias("cutoff"), "features",
                        F.abs("gap").alias("gap"))


@query("k3_representatives", """
SELECT 'low' AS risk_profile, arg_min(customer_id, (score, customer_id)) AS customer_id,
       min(score) AS probability FROM scored
UNION ALL SELECT 'borderline', arg_min(customer_id, (abs(score - 0.5), customer_id)),
       arg_min(score, (abs(score - 0.5), customer_id)) FROM scored
UNION ALL SELECT 'high', arg_min(customer_id, (-score, customer_id)), max(score) FROM scored""")
def representatives(ws):
    return explain.representatives(scored(ws), 0.5, "score")


# Drivers by formula: signed distances of three features from fixed points.
block("formula_drivers", """
SELECT customer_id, score AS probability, feature, CASE feature
         WHEN 'recency' THEN round(recency_days / 1000.0 - 0.5, 6)
         WHEN 'orders' THEN round(0.1 - frequency_orders / 100.0, 6)
         ELSE round(0.25 - return_rate, 6) END AS contribution
FROM scored JOIN feature_base USING (customer_id),
     (SELECT unnest(['recency', 'orders', 'returns']) AS feature)""")


@query("k4_plain_language", """
SELECT customer_id, probability, 'Estimated churn risk is ' || printf('%.1f', round(probability * 100, 1))
  || '%, ' || CASE WHEN probability >= 0.5 THEN 'above' ELSE 'below' END
  || ' the frozen 50.0% decision threshold; '
  || CASE WHEN probability >= 0.5 THEN 'prioritize for retention review' ELSE 'monitor normally' END
  || '. Main upward drivers: ' || coalesce(string_agg(feature, ', ' ORDER BY contribution DESC, feature)
       FILTER (contribution > 0), 'no dominant upward driver')
  || '. Main risk-reducing drivers: ' || coalesce(string_agg(feature, ', ' ORDER BY contribution, feature)
       FILTER (contribution < 0), 'no dominant downward driver') || '.' AS text
FROM formula_drivers GROUP BY customer_id, probability""")
def plain_language(ws):
    rows = scored(ws).join(ws.churn_features.select(
        "customer_id", "recency_days", "frequency_orders", "return_rate"), "customer_id")
    drivers = rows.select("customer_id", F.col("score").alias("probability"), F.explode(F.create_map(
        F.lit("recency"), r6(F.col("recency_days") / 1000.0 - 0.5),
        F.lit("orders"), r6(0.1 - F.col("frequency_orders") / 100.0),
        F.lit("returns"), r6(0.25 - F.col("return_rate")))).alias("feature", "contribution"))
    return explain.plain_language(drivers, 0.5)


@query("k5_partial_dependence")
def partial_dependence(ws):
    names = selected_features(ws)
    leading = [r.feature for r in churn_permutation_importance(ws).orderBy(
        F.desc("importance"), "feature").limit(3).collect()]
    return explain.forest_dependence(_churn_model(ws, "random_forest"), _train(ws), leading, names)


@query("k6_event_masking")
def event_masking(ws):
    model = _sequence_model(ws)
    rows = padded_sequences(ws).where("partition = 'validation'")
    return explain.event_masking(
        lambda frame: models.score_sequences(model, frame, CATEGORIES), rows).withColumn(
        "cutoff_timestamp", F.date_format("cutoff_timestamp", "yyyy-MM-dd"))


@query("k7_worst_anomaly")
def worst_anomaly(ws):
    return explain.worst_anomaly(_errors(ws), BEHAVIOUR_FEATURES)


# --- jobs ---------------------------------------------------------------------------------------
def model_set(ws):
    return _model(ws, "set", lambda: jobs.train_models(
        ws.churn_table, ws.rolling_table, category_table(ws), padded_sequences(ws), _scaler(ws),
        ws.feature_names, CATEGORIES, ws.settings))


def _batch(ws):
    tables = jobs.ProductTables(ws.taxonomy, CATEGORIES, ws.prices, ws.popular)
    fit = ws.churn_features.join(ws.training_ids, "customer_id", "left_semi")
    # The upload is every identified line; anonymous lines are not accepted in a batch.
    return jobs.prepare_batch(ws.lines.where("customer_id is not null"), tables, fit, ws.settings,
                              MARKDOWN_RATIO, ws.rolling_cfg)


block("batch_lines", "SELECT * FROM cleaned WHERE customer_id IS NOT NULL")
block("batch_positive", "SELECT * FROM batch_lines WHERE is_positive_purchase")
block("batch_cut", "SELECT max(invoice_date) + INTERVAL 1 SECOND AS cut_at FROM batch_lines")


@query("l11_batch_preparation", """
SELECT o.customer_id, round((epoch(cut_at) - epoch(last)) / 86400.0, 6) AS recency_days, frequency_orders,
       round(greatest(coalesce(CAST(net AS DOUBLE), 0.0), 0.0), 6) AS net_spend, country,
       round(coalesce(CAST(spend_90d AS DOUBLE), 0.0), 6) AS spend_90d,
       CAST(frequency_orders AS DOUBLE) AS lifetime_orders,
       CASE WHEN frequency_orders >= 2 THEN least(frequency_orders, 20) ELSE 0 END AS sequence_length
FROM (SELECT customer_id, count(DISTINCT invoice) AS frequency_orders, max(invoice_date) AS last
      FROM batch_positive GROUP BY 1) o
LEFT JOIN (SELECT customer_id, sum(signed_merchandise_value) AS net FROM batch_lines
           WHERE is_valid_merchandise GROUP BY 1) n USING (customer_id)
LEFT JOIN (SELECT customer_id, sum(gross_positive_value) AS spend_90d FROM batch_positive, batch_cut
           WHERE invoice_date >= cut_at - INTERVAL 90 DAY GROUP BY 1) s USING (customer_id)
LEFT JOIN last_country USING (customer_id), batch_cut""")
def batch_preparation(ws):
    table, value, latest = _batch(ws)
    return shown(table.select("customer_id", "recency_days", "frequency_orders", "net_spend", "country")
                 .join(value.select("customer_id", "spend_90d", "lifetime_orders"), "customer_id")
                 .join(latest.select("customer_id", F.col("length").cast("bigint")
                                     .alias("sequence_length")), "customer_id", "left")
                 .fillna(0, ["sequence_length"]))


@query("l12_batch_scoring")
def batch_scoring(ws):
    table, value, latest = _batch(ws)
    return jobs.score_batch(table, value, latest, model_set(ws), CATEGORIES, ws.settings)


@query("h31_held_out_evaluation")
def held_out_evaluation(ws):
    everyone = ws.split.withColumn("partition", F.when(
        F.col("partition") == "test", "train").otherwise("test"))
    # The held-out customers' own rolling rows: the dataset builder leaves "test" out by design.
    held = rolling.rolling_dataset(ws.clean, everyone.where("partition = 'train'"),
                                   ws.rolling_cfg).withColumn("partition", F.lit("test"))
    held_sequences = sequences.rolling_sequences(
        ws.events, ws.split, ws.observation_end, ws.settings.sequences, ("test",))
    return jobs.final_evaluation(model_set(ws), ws.churn_table, held, category_table(ws),
                                 held_sequences, CATEGORIES, ws.settings)

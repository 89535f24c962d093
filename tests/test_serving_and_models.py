"""Recommender, metrics, selection rules, priority, forecast, segments and model contracts."""

from __future__ import annotations

import itertools
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlake.operators import (
    cleaning, eda, evaluation, explain, feature_selection, models, products, recommend, segments,
    serving, taxonomy)
from basketlake.settings import ProductSettings, RecommenderSettings, SelectionSettings


def test_last_order_is_held_out(make_lines, spark):
    lines = cleaning.clean(make_lines([
        ("1", "P1", "a", 1, "2021-01-01", 1, "X", "S"), ("1", "P2", "a", 1, "2021-01-01", 1, "X", "S"),
        ("2", "P3", "a", 1, "2021-02-01", 1, "X", "S"), ("3", "P3", "a", 1, "2021-02-01", 1, "Y", "S")]))
    who = spark.createDataFrame([("X",), ("Y",)], "customer_id string")
    marked = recommend.leave_last_order_out(recommend.product_lines(lines, who)).collect()
    assert {r.stock_code for r in marked if not r.is_holdout} == {"P1", "P2"}
    assert {r.stock_code for r in marked if r.is_holdout} == {"P3"}


def test_neighbours_match_brute_force_with_a_heavy_customer(spark):
    rng = np.random.default_rng(5)
    items = [f"I{i:03d}" for i in range(150)]
    rows = {("hot", i): float(rng.integers(1, 9)) for i in items}
    for c in range(40):
        for i in rng.choice(items, 6, replace=False):
            rows[f"c{c}", str(i)] = float(rng.integers(1, 9))
    frame = spark.createDataFrame([(c, i, w) for (c, i), w in rows.items()],
                                  "customer_id string, stock_code string, weight double")
    got = {(r.stock_code, r["rank"]): (r.neighbour, r.similarity) for r in
           recommend.item_neighbours(frame, RecommenderSettings(neighbours=4)).collect()}
    people = sorted({c for c, _ in rows})
    matrix = np.zeros((len(people), len(items)))
    for (c, i), w in rows.items():
        matrix[people.index(c), items.index(i)] = w
    unit = matrix / np.linalg.norm(matrix, axis=0)
    cosine = np.round(unit.T @ unit, 9)
    for a, name in enumerate(items):
        order = sorted((b for b in range(len(items)) if b != a), key=lambda b: (-cosine[a, b], items[b]))
        for place, b in enumerate(order[:4], start=1):
            assert got[name, place][1] == pytest.approx(cosine[a, b], abs=2e-9)


def test_recommendations_fill_up_from_segment_then_overall(spark):
    seen = spark.createDataFrame([("X", "A"), ("Y", "A"), ("Z", "Q")],
                                 "customer_id string, stock_code string")
    neighbours = spark.createDataFrame([("A", "B", 0.5, 1), ("A", "C", 0.0, 2)],
                                       "stock_code string, neighbour string, similarity double, rank int")
    popular = spark.createDataFrame(
        [(1, "B", 1), (1, "S1", 2), (1, "A", 3), (1, "S2", 4), (None, "G1", 1), (None, "G2", 2)],
        "segment_id int, stock_code string, place int")
    segment = spark.createDataFrame([("X", 1), ("Y", 9)], "customer_id string, segment_id int")
    got = recommend.recommend(seen, neighbours, popular, segment, RecommenderSettings(top_k=3))
    rows = {}
    for r in got.orderBy("customer_id", "rank").collect():
        rows.setdefault(r.customer_id, []).append(r.stock_code)
    assert rows == {"X": ["B", "S1", "S2"], "Y": ["B", "G1", "G2"], "Z": ["G1", "G2"]}


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 500), np.round(rng.random(500), 1)
    frame = spark.createDataFrame([(str(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                                  "customer_id string, y int, s double")
    pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(s[y == 1], s[y == 0])]
    assert evaluation.roc_auc(frame, "y", "s").first()[0] == pytest.approx(np.mean(pairs))
    curve = evaluation.precision_recall_curve(frame, "y", "s")
    for r in curve.collect():
        hit = s >= r.threshold
        assert r.precision == pytest.approx(y[hit].mean())
        assert r.recall == pytest.approx(y[hit].sum() / y.sum())
    best = evaluation.best_threshold(curve).first()
    assert best.recall >= 0.7 and best.f_beta == max(
        r.f_beta for r in curve.collect() if r.recall >= 0.7)
    empty = evaluation.binary_metrics(frame.where("y = 0"), "y", "s", 2.0).first()
    assert empty.precision == empty.recall == empty.f1 == 0.0


def test_folds_are_balanced_and_isolated(spark):
    frame = spark.range(300).select(F.col("id").cast("string").alias("customer_id"),
                                    (F.col("id") % 3 == 0).cast("int").alias("y"))
    counts = evaluation.stratified_folds(frame, "y").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in counts if r.y == 1} == {20}
    twice = frame.unionByName(frame)
    folded = evaluation.grouped_folds(twice, "y")
    assert evaluation.fold_violations(folded).first().crossing == 0
    bins = evaluation.quantile_bins(frame.withColumn("v", F.lit(0.0)), "v").groupBy("bin").count()
    assert [r["count"] for r in bins.orderBy("bin").collect()] == [30] * 10


def test_selection_rules(spark):
    rows = spark.createDataFrame(
        [("a", 0.72, 0.810), ("b", 0.80, 0.805), ("c", 0.95, 0.700), ("d", 0.60, 0.900)],
        "model string, validation_recall double, validation_roc_auc double")
    assert evaluation.select_churn_model(rows, SelectionSettings()).first().model == "b"
    folds = spark.createDataFrame([("good", r, 1.0, 2.0) for r in (0.2, 0.3)]
                                  + [("wild", r, 1.0, 2.0) for r in (0.9, -0.7)],
                                  "model string, r2 double, mae double, rmse double")
    final = spark.createDataFrame([("good", 0.1, 1.0, 2.0), ("wild", 0.9, 1.0, 2.0)],
                                  "model string, r2 double, mae double, rmse double")
    summary = evaluation.candidate_summary(folds, final)
    assert evaluation.select_value_model(summary).first().model == "good"
    reasons = {r.model: r.eligibility_reason for r in summary.collect()}
    assert reasons["good"] == "eligible" and "catastrophically" in reasons["wild"]
    seen = rows.withColumn("held_out_test_accessed", F.lit(True))
    with pytest.raises(Exception, match="held-out"):
        evaluation.consolidated_comparison([seen]).collect()


def _serving(spark, values):
    now = datetime(2024, 1, 1)
    customers = spark.createDataFrame([(c, "Spain", "low") for c in "ABC"],
                                      "customer_id string, country string, value_tier string")
    segment = spark.createDataFrame([(c, 1, "One") for c in "ABC"],
                                    "customer_id string, segment_id int, segment_name string")
    scores = spark.createDataFrame(
        [(i, c, now, p, v) for i, (c, p, v) in enumerate(values)],
        "id int, customer_id string, scored_at timestamp_ntz, churn_probability double, "
        "predicted_clv_180d double")
    return customers, segment, scores


def test_retention_priority_goldens(spark):
    rows = serving.retention_priority(*_serving(
        spark, [("A", .1, 100.), ("B", .9, 50.), ("C", .5, 200.), ("C", .2, 1.), ("C", .5, 200.)])).collect()
    assert [r.customer_id for r in rows] == ["C", "B", "A"]
    assert [r.retention_priority for r in rows] == [0.5, 0.0, 0.0]
    same = serving.retention_priority(*_serving(spark, [(c, .5, 10.) for c in "ABC"])).collect()
    assert [r.retention_priority for r in same] == [1.0, 1.0, 1.0]
    none = serving.retention_priority(*_serving(spark, [("A", .1, 1.)]), country="Peru").collect()
    assert none == []


def test_forecast_methods(spark):
    def months(name, n):
        return [(name, str(m)[:7], float(100 + 10 * (i % 12) + i))
                for i, m in enumerate(pd.date_range("2020-01-01", periods=n, freq="MS"))]

    lengths = {"one": 1, "short": 2, "trend": 6, "season": 24, "long": 48}
    frame = spark.createDataFrame([r for name, n in lengths.items() for r in months(name, n)]
                                  + [("below", "2021-01", -5.0)], "k string, period string, revenue double")
    rows = serving.revenue_forecast(frame, "k").toPandas()
    method = rows.groupby("k").method.first()
    assert method["season"].endswith("season") and method["trend"] == "damped trend"
    assert method["short"] == method["one"] == "last value"
    ahead = {k: g.sort_values("period").revenue.to_numpy() for k, g in rows[rows.series == "forecast"].groupby("k")}
    assert all(len(v) == 6 for v in ahead.values())
    assert (ahead["short"] == 111).all() and (ahead["one"] == 100).all() and (ahead["below"] == 0).all()
    assert np.abs(ahead["long"] - [148, 159, 170, 181, 192, 203]).max() < 25
    assert sorted(rows[(rows.k == "short") & (rows.series == "forecast")].period) == [f"2020-{m:02d}" for m in range(3, 9)]


def test_gaps_in_months_count_as_zero(spark):
    frame = spark.createDataFrame([("a", "2021-01", 5.0), ("a", "2021-03", 7.0)],
                                  "k string, period string, revenue double")
    got = [r.revenue for r in serving.filled_months(frame, ["k"]).orderBy("month").collect()]
    assert got == [5.0, 0.0, 7.0]


def test_segment_names_and_davies_bouldin(spark):
    profile = spark.createDataFrame([(0, 300.0, 1.0, 10.0), (1, 5.0, 30.0, 900.0), (2, 90.0, 7.0, 200.0)],
                                    "s int, recency_days double, frequency_orders double, net_spend double")
    names = {r.s: r.business_label for r in segments.business_labels(profile, "s").collect()}
    assert names == {1: "Champions", 2: "Loyal High Value", 0: "Established"}
    points = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 10.0), (1, 14.0)], "c int, x double")
    assert segments.davies_bouldin(points, "c", ["x"]).first()[0] == pytest.approx(3 / 11)


def test_text_and_representatives(spark):
    drivers = spark.createDataFrame([("A", 0.75, "x", 0.2), ("A", 0.75, "y", -0.1)],
                                    "customer_id string, probability double, feature string, contribution double")
    text = explain.plain_language(drivers, 0.5).first().text
    assert text == ("Estimated churn risk is 75.0%, above the frozen 50.0% decision threshold; prioritize "
                    "for retention review. Main upward drivers: x. Main risk-reducing drivers: y.")


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        x = rng.normal(size=3)
        y = float(max(0.0, 20 * x[0] + 5 * rng.normal()))
        rows.append((str(i), *map(float, x), 2.0, int(x[0] + 0.3 * rng.normal() > 0), y,
                     "train" if i < 160 else "validation"))
    return spark.createDataFrame(rows, "customer_id string, a double, b double, c double, k double, "
                                       "churn int, clv_180d_target double, partition string")


def test_model_contracts(training):
    names = ["a", "b", "c"]
    train, validation = (training.where(F.col("partition") == p) for p in ("train", "validation"))
    family = models.churn_families(160, 3)["logistic_regression"]
    scored = models.score_binary(models.fit_binary(train, names, family), validation, names)
    assert scored.where("probability_1 not between 0 and 1").count() == 0
    assert models.binary_report(scored, "lr").first().roc_auc > 0.8
    top = train.agg(F.max("clv_180d_target")).first()[0]
    fits = models.value_fits(names, rounds=3)
    for name in models.BOOSTED_VALUES:
        assert fits[name](train).predict(validation).where(
            (F.col("predicted") < 0) | (F.col("predicted") > top)).count() == 0
    nothing = fits["hurdle"](train.withColumn("clv_180d_target", F.lit(0.0)))
    assert nothing.predict(validation).where("predicted <> 0").count() == 0
    with pytest.raises(ValueError):
        fits["tweedie"](train.withColumn("clv_180d_target", F.lit(-1.0)))
    anomaly = models.fit_anomaly(train, names, 2)
    errors = anomaly.errors(validation)
    assert errors.where("anomaly_score < 0").count() == 0
    drivers = explain.local_drivers(
        lambda rows: models.score_binary(models.fit_binary(train, names, family), rows, names),
        validation, train, names)
    assert drivers.count() == 80 * 3


def test_forest_dependence_equals_rescored_copies(training):
    names = ["a", "b", "c"]
    train = training.where("partition = 'train'").withColumn("b", F.when(F.col("customer_id") != "3", F.col("b")))
    fitted = models.fit_binary(train, names, models.churn_families(160, 3)["random_forest"], 2)
    slow = explain.partial_dependence(lambda rows: models.score_binary(fitted, rows, names), train, ["a", "b"], names, 7)
    fast = explain.forest_dependence(fitted, train, ["a", "b"], names, 7)
    told = [{(r.feature, r.step): (r.grid_value, r.mean_score) for r in table.collect()} for table in (slow, fast)]
    assert len(told[0]) == 14 and len({v[1] for v in told[0].values()}) > 5
    assert told[0].keys() == told[1].keys()
    assert all(told[1][k] == pytest.approx(v, abs=1e-9) for k, v in told[0].items())


def test_permuted_rows_are_scored_once(training, spark):
    scored = spark.sparkContext.accumulator(0)
    from pyspark.sql.types import DoubleType

    @F.udf(DoubleType())
    def score(x):
        scored.add(1)
        return 1 / (1 + math.exp(-x))

    rows = training.where("partition = 'validation'")
    found = explain.permutation_importance(
        lambda frame: frame.withColumn("probability_1", score("a")), rows, ["a", "b"], "churn").collect()
    told = {r.feature: r.importance for r in found}
    assert told["a"] > 0.2 and abs(told["b"]) < 1e-9
    assert scored.value == 3 * 80  # two copies and the rows themselves


def test_ridge_is_the_closed_form(training):
    names = ["a", "b", "c"]
    train = training.where("partition = 'train'")
    pdf = train.select(*names, "clv_180d_target").toPandas().astype(float)
    x = (pdf[names] - pdf[names].mean()) / pdf[names].std()
    y = np.log1p(pdf["clv_180d_target"])
    for ridge in (10.0, 200.0):
        candidate = models.value_candidates(ridge=ridge)["ridge_log1p"]
        fitted = models.fit_value(train, names, *candidate).pipeline.stages[-1]
        want = np.linalg.solve(x.T @ x + ridge * np.eye(3), x.T @ (y - y.mean()))
        assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-6)


def test_macro_f1_counts_classes_alike(spark):
    rows = [(0.0, 0.0)] * 8 + [(0.0, 1.0), (1.0, 1.0), (2.0, 0.0)]
    frame = spark.createDataFrame(rows, "y double, prediction double")
    want = np.mean([16 / 18, 2 / 3, 0.0])
    assert models.multiclass_evaluator("y").evaluate(frame) == pytest.approx(want)


def test_every_value_candidate_is_evaluated(training):
    names = ["a", "b", "c"]
    table = training.withColumn("fold", F.pmod(F.xxhash64("customer_id"), F.lit(2)).cast("int"))
    fitted = models.fit_value_candidates(table, names, 2, rounds=4)
    candidates = {"ridge_log1p", *models.BOOSTED_VALUES}
    assert set(fitted) == {(n, f) for n in candidates for f in (0, 1, None)}
    folds, final = models.evaluate_value_candidates(table, fitted, 2)
    assert folds.count() == 10 and {r.model for r in final.collect()} == candidates
    # a model grown beside others is the one grown alone on the rows outside its fold
    alone = models.value_fits(names, rounds=4)["tweedie"](table.where("partition = 'train'"))
    values = np.random.default_rng(1).normal(size=(20, 3))
    assert np.allclose(alone.parts[0].raw_of(values), fitted["tweedie", None].parts[0].raw_of(values), atol=1e-9)
    assert fitted["tweedie", 0].top == table.where("partition = 'train' and fold <> 0").agg(
        F.max("clv_180d_target")).first()[0]


def test_schema_drops_constants_and_copies(training):
    table = training.withColumn("a2", F.col("a") + 0.1 * F.sin(17 * F.col("customer_id").cast("int")))
    rows = {r.feature: r for r in feature_selection.freeze_schema(
        table, ["a", "a2", "b", "c", "k"]).collect()}
    assert not rows["k"].selected and rows["k"].reason == "zero variance"
    assert rows["a"].selected != rows["a2"].selected and rows["b"].selected and rows["c"].selected
    changed = table.withColumn("b", F.when(F.col("partition") == "train", F.col("b")).otherwise(9.9))
    again = feature_selection.freeze_schema(changed, ["a", "a2", "b", "c", "k"]).collect()
    assert {r.feature: r.selected for r in again} == {f: r.selected for f, r in rows.items()}
    pair = eda.correlated_pairs(eda.correlations(table, ["a", "a2", "b"])).first()
    assert {pair.feature_a, pair.feature_b} == {"a", "a2"}


def test_taxonomy_groups_alike_products(spark):
    words = ["RED CUP", "RED MUG", "RED CUP SMALL", "BLUE LAMP", "BLUE LAMP TALL", "BLUE LIGHT",
             "RED CUP LARGE", "BLUE LAMP SHADE"]
    table = spark.createDataFrame([(f"P{i}", w) for i, w in enumerate(words)],
                                  "stock_code string, description_normalized string")
    weights = products.tfidf(table)
    norms = weights.groupBy("stock_code").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert norms.where("abs(n - 1) > 1e-9").count() == 0
    cfg = ProductSettings(taxonomy_clusters=(2,), components=3)
    assigned, term_weights, report = taxonomy.fit_taxonomy(table, cfg)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.category_id, set()).add(r.description_normalized.split()[0])
    assert sorted(map(sorted, groups.values())) == [["BLUE"], ["RED"]]
    assert report.first().selected and taxonomy.top_terms(term_weights, assigned).count() > 2

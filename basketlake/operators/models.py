"""Model families on Spark ML: preprocessing, search, fitting and scoring.

Everything that touches rows is a Spark ML stage or a DataFrame expression; the driver only holds
parameters and metrics.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import Imputer, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.functions.distributed import exact_quantiles
from basketlake.operators import boosting, evaluation
from basketlake.session import materialize, shared_folder, training_rows
from basketlake.settings import RollingSettings

SEED = 42
TREES = (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)
FITS_AT_ONCE = 4


def side_by_side(tasks: Sequence, at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent fits, a few submitted at a time so that their small jobs overlap."""
    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


# --- preprocessing ------------------------------------------------------------------------------
def preprocessing(features: Sequence[str], scale: bool) -> list:
    """Median imputation, one vector in frozen column order, optionally standardized."""
    imputed = [f"{f}__imputed" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="assembled" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="assembled", outputCol="features", withMean=True,
                                     withStd=True))
    return stages


def fit_pipeline(train: DataFrame, features: Sequence[str], estimator: Estimator | None,
                 scale: bool = True) -> PipelineModel:
    rows = as_doubles(train, features)
    if estimator is None:
        return Pipeline(stages=preprocessing(features, scale)).fit(rows)
    rows = rows.select(*_fit_columns(features, estimator))
    return Pipeline(stages=preprocessing(features, scale) + [estimator]).fit(
        _fit_rows(rows, estimator))


def _fit_columns(features: Sequence[str], estimator: Estimator) -> list[str]:
    """Columns that a fit reads: only these are written once and read by every pass."""
    read = [estimator.getOrDefault(p) for p in ("labelCol", "weightCol")
            if estimator.hasParam(p) and estimator.isDefined(p) and estimator.getOrDefault(p)]
    return [*features, *(c for c in read if c not in features)]


def _fit_rows(rows: DataFrame, estimator: Estimator) -> DataFrame:
    """Trees do much work per pass and want every core; gradient fits make many light passes."""
    return training_rows(rows) if isinstance(estimator, TREES) else materialize(rows)


def as_doubles(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: F.col(f).cast("double") for f in features})


def preprocessing_contracts(train: DataFrame, features: Sequence[str]) -> dict[str, PipelineModel]:
    """Frozen preprocessing with and without standardization, fitted on training rows."""
    return {"scaled": fit_pipeline(train, features, None, True),
            "unscaled": fit_pipeline(train, features, None, False)}


def transform(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(as_doubles(rows, features))


# --- churn families -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Family:
    """An estimator, whether it wants scaled inputs, and its candidate settings."""

    estimator: Estimator
    scale: bool
    grid: tuple[Mapping[str, object], ...]
    weighted: bool = True


# The settings of every candidate below.
def churn_families(n_train: int, n_features: int) -> dict[str, Family]:
    """The churn candidates.

    An inverse penalty C over n rows equals ``regParam = 1 / (C * n)``.
    """
    common = dict(featuresCol="features", labelCol="churn")
    weighted = dict(common, weightCol="class_weight")

    return {
        "logistic_regression": Family(
            LogisticRegression(maxIter=100, **weighted), True,
            tuple({"elasticNetParam": mix, "regParam": 1.0 / (c * n_train)}
                  for mix in (1.0, 0.0) for c in (0.1, 1.0, 10.0))),
        "decision_tree": Family(
            DecisionTreeClassifier(seed=SEED, **weighted), False,
            ({"maxDepth": 4, "minInstancesPerNode": 5}, {"maxDepth": 8, "minInstancesPerNode": 10},
             {"maxDepth": 30, "minInstancesPerNode": 20})),
        "random_forest": Family(
            RandomForestClassifier(seed=SEED, cacheNodeIds=True, **weighted), False,
            ({"numTrees": 160, "maxDepth": 30, "minInstancesPerNode": 2,
              "featureSubsetStrategy": "sqrt"},
             {"numTrees": 240, "maxDepth": 12, "minInstancesPerNode": 5,
              "featureSubsetStrategy": "0.7"},
             {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 10,
              "featureSubsetStrategy": "sqrt"})),
        "boosted_depth": Family(
            GBTClassifier(seed=SEED, **weighted), False,
            ({"maxIter": 160, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.85,
              "featureSubsetStrategy": "0.85"},
             {"maxIter": 240, "maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 1.0,
              "featureSubsetStrategy": "0.8"},
             {"maxIter": 180, "maxDepth": 5, "stepSize": 0.07, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "all"})),
        # Leaf-wise candidates: about log2(leaves) levels, with a minimum leaf size.
        "boosted_leaves": Family(
            GBTClassifier(seed=SEED, **weighted), False,
            ({"maxIter": 160, "maxDepth": 4, "stepSize": 0.05, "minInstancesPerNode": 20},
             {"maxIter": 240, "maxDepth": 5, "stepSize": 0.03, "minInstancesPerNode": 30},
             {"maxIter": 180, "maxDepth": 5, "stepSize": 0.07, "minInstancesPerNode": 40})),
        "linear_svm": Family(
            LinearSVC(maxIter=100, **weighted), True,
            tuple({"regParam": 1.0 / (c * n_train)} for c in (0.5, 1.0, 3.0))),
        "feed_forward": Family(
            MultilayerPerceptronClassifier(layers=[n_features, 128, 64, 2], maxIter=60, seed=SEED,
                                           **common), True, ({"stepSize": 0.03},), weighted=False),
    }


def param_maps(estimator: Estimator, grid: Sequence[Mapping[str, object]]
               ) -> list[dict[Param, object]]:
    return [{estimator.getParam(name): value for name, value in settings.items()}
            for settings in grid]


def grid_search(train: DataFrame, features: Sequence[str], family: Family, evaluator: Evaluator,
                folds: int = 5, parallelism: int = 8):
    """Cross-validate every candidate on the ``fold`` column and refit the best on all rows."""
    pipeline = Pipeline(stages=preprocessing(features, family.scale) + [family.estimator])
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=param_maps(family.estimator, family.grid),
        evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED)
    # Every fold of every candidate reads the rows again, so they are materialized once.
    rows = as_doubles(train, features).select(*_fit_columns(features, family.estimator), "fold")
    return search.fit(_fit_rows(rows, family.estimator))


def search_report(fitted, family: Family, spark) -> DataFrame:
    """One row per candidate: settings, fold mean and deviation, and whether it won."""
    larger = fitted.getEvaluator().isLargerBetter()
    best = (max if larger else min)(fitted.avgMetrics)
    rows = [(i, ", ".join(f"{k}={v}" for k, v in settings.items()), float(m), float(s), bool(m == best))
            for i, (settings, m, s) in enumerate(
                zip(family.grid, fitted.avgMetrics, fitted.stdMetrics, strict=True))]
    return spark.createDataFrame(
        rows, "candidate int, settings string, cv_mean double, cv_std double, is_best boolean")


def binary_evaluator(label: str = "churn") -> Evaluator:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")


class MacroF1(Evaluator):
    """Mean of the classes' F1, each class counting once; classes are those seen or predicted."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.groupBy(F.col(self.label).cast("int").alias("y"), F.col("prediction").cast("int").alias("z")
                                ).agg(F.count(F.lit(1)).alias("n"))
        # one row for each pair of classes
        seen = [tuple(r) for r in pairs.collect()]
        classes = {y for y, _, _ in seen} | {z for _, z, _ in seen}
        return sum(2 * sum(n for y, z, n in seen if y == z == c) /
                   sum(n * ((y == c) + (z == c)) for y, z, n in seen) for c in classes) / max(1, len(classes))

    def isLargerBetter(self) -> bool:
        return True


def multiclass_evaluator(label: str) -> Evaluator:
    return MacroF1(label)


def fit_binary(train: DataFrame, features: Sequence[str], family: Family, candidate: int = 0,
               label: str = "churn") -> PipelineModel:
    """Fit one candidate. Families without weights get the rarer class repeated instead."""
    estimator = family.estimator.copy(param_maps(family.estimator, family.grid)[candidate])
    rows = (evaluation.with_class_weight(train, label) if family.weighted
            else balanced_by_repetition(train, label))
    return fit_pipeline(rows, features, estimator, family.scale)


def balanced_by_repetition(train: DataFrame, label: str) -> DataFrame:
    """Every class repeated by the whole number that brings it nearest to the largest class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n").alias("m")).scalar()
    copies = counts.select(label, F.greatest(F.round(top / F.col("__n")).cast("int"), F.lit(1))
                           .alias("__copies"))
    return (train.join(F.broadcast(copies), label)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .drop("__copy", "__copies"))


def score_binary(model: PipelineModel, rows: DataFrame, features: Sequence[str],
                 output: str = "probability_1") -> DataFrame:
    """Adds the score of class 1; margins without probabilities go through a logistic curve."""
    scored = transform(model, rows, features)
    if "probability" in scored.columns:
        value = F.get(vector_to_array("probability"), F.lit(1))
    else:
        value = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return scored.withColumn(output, value).select(*rows.columns, output)


def forest_tables(model, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """Feature (leaf: -1), threshold, left, right and share of class 1 by node, per tree of a fitted forest.

    Read from the model's saved form; parents come before children.
    """
    path = f"{shared_folder(spark)}/basketlake/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees = []
    for _, rows in itertools.groupby(nodes, key=lambda r: r.treeID):
        rows = list(rows)
        if any(r.split.numCategories >= 0 for r in rows if r.leftChild >= 0):
            raise ValueError("splits by category have no interval")
        inner = [r.leftChild >= 0 for r in rows]
        trees.append((
            np.array([r.split.featureIndex if i else -1 for r, i in zip(rows, inner)]),
            np.array([r.split.leftCategoriesOrThreshold[0] if i else np.nan for r, i in zip(rows, inner)]),
            np.array([r.leftChild for r in rows]), np.array([r.rightChild for r in rows]),
            np.array([r.impurityStats[1] / sum(r.impurityStats) for r in rows])))
    return trees


def binary_report(scored: DataFrame, name: str, label: str = "churn",
                  score: str = "probability_1", threshold: float = 0.5) -> DataFrame:
    metrics = evaluation.binary_metrics(scored, label, score, threshold)
    auc = evaluation.roc_auc(scored, label, score).scalar()
    return metrics.withColumn("roc_auc", auc).withColumn("model", F.lit(name)).withColumn(
        "threshold", F.lit(threshold))


# --- value families -----------------------------------------------------------------------------
TARGET = "clv_180d_target"


@dataclass(frozen=True)
class ValueModel:
    """A fitted value model; predictions stay inside the training range."""

    pipeline: PipelineModel
    features: tuple[str, ...]
    log_target: bool
    top: float
    unit: float = 1.0

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        raw = transform(self.pipeline, rows, self.features)
        value = F.expm1("prediction") if self.log_target else F.col("prediction") * self.unit
        return raw.withColumn(output, F.least(F.greatest(value, F.lit(0.0)), F.lit(self.top))
                              ).select(*rows.columns, output)


def fit_value(train: DataFrame, features: Sequence[str], estimator: Estimator, log_target: bool,
              scale: bool) -> ValueModel:
    top, mean = (float(x) for x in train.agg(
        F.max(TARGET).cast("double"), F.avg(TARGET).cast("double")).first())
    # In units of the mean, a fit with a log link starts near its solution.
    unit = 1.0 if log_target or mean <= 0 else mean
    y = F.log1p(TARGET) if log_target else F.col(TARGET).cast("double") / unit
    if isinstance(estimator, LinearRegression):
        # Spark divides the label by its deviation before it applies the penalty, and scales features
        # of unit sample deviation once more by n / (n - 1); the ridge is stated for the label itself,
        # and as a sum over the rows of this fit.
        n, deviation = train.agg(F.count(F.lit(1)), F.stddev_samp(y)).first()
        factor = (deviation or 1.0) * math.sqrt(n / max(1, n - 1)) / max(1, n)
        estimator = estimator.copy({estimator.regParam: estimator.getRegParam() * factor})
    model = fit_pipeline(train.withColumn("__y", y), features, estimator.copy(
        {estimator.getParam("labelCol"): "__y"}), scale)
    return ValueModel(model, tuple(features), log_target, top, unit)


def value_candidates(ridge: float = 10.0) -> dict[str, tuple[Estimator, bool, bool]]:
    """name -> (estimator, log target, scaled) of what Spark ML fits. ``ridge`` is a penalty on the sum over rows."""
    return {"ridge_log1p": (LinearRegression(elasticNetParam=0.0, regParam=ridge), True, True)}


BOOSTED_VALUES = ("boosted_log1p", "boosted_squared_error", "tweedie", "hurdle")


# The settings of the boosted value candidates.
def value_boosts(name: str, weight: Column, rounds: int = 360, power: float = RollingSettings.tweedie_power
                 ) -> list[boosting.Boost]:
    """The models of a candidate over rows of positive weight; the hurdle has an occurrence and a magnitude."""
    settings = dict(rounds=rounds, depth=3, rate=0.035, min_weight=8.0, row_share=0.85, column_share=0.9,
                    ridge=12.0, power=power, seed=SEED)
    value = F.col(TARGET).cast("double")
    positive = F.when(value > 0, weight)
    return {
        "boosted_log1p": [boosting.Boost("squared", F.log1p(value), weight, **settings)],
        "boosted_squared_error": [boosting.Boost("squared", value, weight, **settings)],
        "tweedie": [boosting.Boost("tweedie", value, weight, **settings)],
        "hurdle": [boosting.Boost("logistic", (value > 0).cast("double"), weight, **settings),
                   boosting.Boost("tweedie", value, positive, **settings)],
    }[name]


@dataclass(frozen=True)
class BoostedValue:
    """Boosted trees of one candidate; predictions stay inside [0, largest training value]."""

    name: str
    parts: tuple[boosting.BoostedModel, ...]
    top: float

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        scores = [p.score() for p in self.parts]
        value = F.expm1(scores[0]) if self.name == "boosted_log1p" else scores[0]
        for score in scores[1:]:  # the chance of any value times its size
            value = value * score
        return rows.withColumn(output, F.least(F.greatest(value, F.lit(0.0)), F.lit(self.top)))


def row_key(rows: DataFrame) -> Column:
    """A number that names a snapshot row for row sampling."""
    return F.xxhash64(*[c for c in ("customer_id", "cutoff_timestamp") if c in rows.columns])


def fit_boosted_values(rows: DataFrame, features: Sequence[str], asked: Sequence[tuple[str, Column]],
                       rounds: int = 360) -> list[BoostedValue]:
    """One model for each (candidate, weight of the rows), all grown in the same passes over the rows."""
    low = rows.agg(F.min(TARGET).cast("double")).first()[0]
    if (low or 0.0) < 0 and any(name in ("tweedie", "hurdle") for name, _ in asked):
        raise ValueError("targets must not be negative")
    tops = rows.agg(*[F.coalesce(F.max(F.when(w > 0, F.col(TARGET))).cast("double"), F.lit(0.0)) for _, w in asked]).first()
    boosts = [value_boosts(name, weight, rounds) for name, weight in asked]
    fitted = iter(boosting.fit(rows, features, row_key(rows), [b for own in boosts for b in own]))
    return [BoostedValue(name, tuple(next(fitted) for _ in own), float(top))
            for (name, _), own, top in zip(asked, boosts, tops)]


def value_fits(features: Sequence[str], rounds: int = 360) -> dict[str, Callable[[DataFrame], object]]:
    """name -> a fit of training rows, for each of the five value candidates."""
    fits: dict[str, Callable[[DataFrame], object]] = {
        name: (lambda train, c=candidate: fit_value(train, features, *c))
        for name, candidate in value_candidates().items()}
    for name in BOOSTED_VALUES:
        fits[name] = lambda train, n=name: fit_boosted_values(train, features, [(n, F.lit(1.0))], rounds)[0]
    return fits


def fit_value_candidates(dataset: DataFrame, features: Sequence[str], folds: int, rounds: int = 360
                         ) -> dict[tuple[str, int | None], object]:
    """(candidate, fold left out or None) -> fitted model, on the rows of ``partition`` train.

    The boosted candidates of all folds share one binned table and its passes.
    """
    train = dataset.where(F.col("partition") == "train")
    asked = [(name, fold) for name in value_candidates() for fold in (*range(folds), None)]
    fitted: dict = dict(zip(asked, side_by_side([
        lambda n=name, f=fold: fit_value(train if f is None else train.where(F.col("fold") != f), features,
                                         *value_candidates()[n]) for name, fold in asked]), strict=True))
    asked = [(name, fold) for name in BOOSTED_VALUES for fold in (*range(folds), None)]
    weights = {fold: F.lit(1.0) if fold is None else F.when(F.col("fold") != fold, 1.0).otherwise(0.0)
               for fold in (*range(folds), None)}
    return fitted | dict(zip(asked, fit_boosted_values(
        train, features, [(name, weights[fold]) for name, fold in asked], rounds), strict=True))


def evaluate_value_candidates(dataset: DataFrame, fitted: Mapping[tuple[str, int | None], object],
                              folds: int) -> tuple[DataFrame, DataFrame]:
    """Metrics of every candidate on the folds it left out, and of its last fit on validation rows."""
    train, validation = (dataset.where(F.col("partition") == p) for p in ("train", "validation"))
    fold_rows, validation_rows = None, None
    for name in dict.fromkeys(n for n, _ in fitted):
        scored = None
        for fold in range(folds):
            part = fitted[name, fold].predict(train.where(F.col("fold") == fold)).select(
                TARGET, "predicted", "fold")
            scored = part if scored is None else scored.unionByName(part)
        rows = evaluation.regression_metrics(materialize(scored), TARGET, "predicted", ["fold"]).withColumn(
            "model", F.lit(name))
        fold_rows = rows if fold_rows is None else fold_rows.unionByName(rows)
        final = evaluation.regression_metrics(materialize(fitted[name, None].predict(validation).select(
            TARGET, "predicted")), TARGET, "predicted").withColumn("model", F.lit(name))
        validation_rows = final if validation_rows is None else validation_rows.unionByName(final)
    return fold_rows, validation_rows


# --- next category ------------------------------------------------------------------------------
def fit_next_category(train: DataFrame, features: Sequence[str], trees: int = 160, depth: int = 8,
                      min_rows: int = 15, label: str = "next_category_id") -> PipelineModel:
    """Multiclass forest with balanced weights; a class unseen in training is an error."""
    weighted = evaluation.with_class_weight(train, label)
    stages = [StringIndexer(inputCol=label, outputCol="class_index", handleInvalid="error",
                            stringOrderType="alphabetAsc")]
    stages += preprocessing(features, False)
    stages.append(RandomForestClassifier(
        featuresCol="features", labelCol="class_index", weightCol="class_weight", numTrees=trees,
        maxDepth=depth, minInstancesPerNode=min_rows, cacheNodeIds=True, seed=SEED))
    return Pipeline(stages=stages).fit(training_rows(as_doubles(weighted, features)))


# The boosted candidates of the next category.
CATEGORY_CANDIDATES = (
    {"rounds": 160, "leaves": 15, "rate": 0.05, "min_rows": 15},
    {"rounds": 240, "leaves": 31, "rate": 0.03, "min_rows": 20},
    {"rounds": 180, "leaves": 20, "rate": 0.07, "min_rows": 30},
)


@dataclass(frozen=True)
class BoostedCategory:
    """Boosted trees over the classes ``labels``; class i of the chances is ``labels[i]``."""

    model: boosting.BoostedModel
    labels: tuple[int, ...]
    label: str

    def score(self, rows: DataFrame, labelled: bool = True) -> DataFrame:
        """As ``score_next_category``: a row whose label is missing or unseen in training is an error."""
        names = F.array(*[F.lit(n) for n in self.labels])
        scored = rows.withColumn("class_probabilities", self.model.chances())
        p = F.col("class_probabilities")
        scored = scored.withColumns({
            "next_category_probability": F.array_max(p),
            "predicted_category": F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).cast("string")})
        if labelled:
            place = F.array_position(names, F.col(self.label).cast("int"))
            scored = scored.withColumn("class_index", F.when(place > 0, (place - 1).cast("double")).otherwise(F.raise_error(
                F.concat(F.lit("category not seen in training: "), F.coalesce(F.col(self.label).cast("string"), F.lit("null"))))))
        return scored.select(*rows.columns, *(["class_index"] if labelled else []),
                             "class_probabilities", "predicted_category", "next_category_probability")


def search_next_category(train: DataFrame, features: Sequence[str], candidates: Sequence[Mapping] = CATEGORY_CANDIDATES,
                         folds: int = 5, label: str = "next_category_id") -> tuple[BoostedCategory, DataFrame]:
    """The winner by mean macro-F1 over stratified folds, refitted on all rows, and a report row a candidate and fold.

    All candidates of all folds are grown in the same passes over one binned table; a left-out fold has
    weight 0, and classes weigh the same among the rows of each fit. Ties go to the earlier candidate. A
    candidate's leaves become the nearest depth. Rows without a label are left out; none at all is an error.
    """
    wanted = train.where(F.col(label).isNotNull())
    dealt = materialize(evaluation.stratified_folds(wanted, label, folds, SEED).withColumn("__label", F.col(label).cast("int")))
    counts = dealt.groupBy("__label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()  # classes x folds
    labels = tuple(sorted({r["__label"] for r in counts}))
    if not labels:
        raise ValueError("no row has a category")
    target = (F.array_position(F.array(*[F.lit(n) for n in labels]), F.col("__label")) - 1).cast("double")

    def weight(left_out: int | None) -> Column:
        sizes = {n: sum(r["n"] for r in counts if r["__label"] == n and r["fold"] != left_out) for n in labels}
        present = [n for n in labels if sizes[n]]
        balanced = F.coalesce(*[F.when(F.col("__label") == n, sum(sizes.values()) / (len(present) * sizes[n])) for n in present],
                              F.lit(0.0)) if present else F.lit(0.0)
        return balanced if left_out is None else F.when(F.col("fold") != left_out, balanced).otherwise(0.0)

    def boost(candidate: Mapping, left_out: int | None) -> boosting.Boost:
        return boosting.Boost("softmax", target, weight(left_out), rounds=candidate["rounds"],
                              depth=max(1, round(math.log2(candidate["leaves"]))), rate=candidate["rate"],
                              min_rows=candidate["min_rows"], min_weight=1e-3, ridge=1e-3, classes=len(labels), seed=SEED)

    key = row_key(dealt)
    asked = [(c, f) for c in range(len(candidates)) for f in range(folds)]
    fitted = boosting.fit(dealt, features, key, [boost(candidates[c], f) for c, f in asked])
    told = None
    for (c, f), model in zip(asked, fitted):
        p = model.chances()
        rows = dealt.where(F.col("fold") == f).select(
            F.lit(c).alias("candidate"), "fold", target.cast("int").alias("y"), p.alias("p")).select(
            "candidate", "fold", "y", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("z"))
        told = rows if told is None else told.unionByName(rows)
    by_fold = evaluation.macro_f1(materialize(told), "y", "z", ["candidate", "fold"])
    report = materialize(by_fold)
    means = {r["candidate"]: r["m"] for r in report.groupBy("candidate").agg(F.avg("macro_f1").alias("m")).collect()}
    best = min(range(len(candidates)), key=lambda c: (-means.get(c, 0.0), c))
    final = boosting.fit(dealt, features, key, [boost(candidates[best], None)])[0]
    return (BoostedCategory(final, labels, label),
            report.withColumn("selected", F.col("candidate") == best).orderBy("candidate", "fold"))


def score_next_category(model: PipelineModel | BoostedCategory, rows: DataFrame, features: Sequence[str],
                        labelled: bool = True) -> DataFrame:
    """Adds class probabilities, the likeliest category and its probability."""
    if isinstance(model, BoostedCategory):
        return model.score(rows, labelled)
    names = model.stages[0].labels
    stages = model.stages if labelled else model.stages[1:]
    scored = as_doubles(rows, features)
    for stage in stages:
        scored = stage.transform(scored)
    p = vector_to_array("probability")
    keep = [*rows.columns, *(["class_index"] if labelled else [])]
    return scored.withColumns({
        "class_probabilities": p, "next_category_probability": F.array_max(p),
        "predicted_category": F.element_at(
            F.array(*[F.lit(n) for n in names]), F.array_position(p, F.array_max(p)).cast("int")),
    }).select(*keep, "class_probabilities", "predicted_category", "next_category_probability")


# --- anomalies ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class AnomalyModel:
    """Scaling and principal directions; the score is the mean squared reconstruction error."""

    pipeline: PipelineModel
    features: tuple[str, ...]

    def errors(self, rows: DataFrame) -> DataFrame:
        """Adds ``scaled``, ``rebuilt`` and ``squared_errors`` arrays and ``anomaly_score``."""
        directions = self.pipeline.stages[-1].pc.toArray().tolist()
        scored = transform(self.pipeline, rows, self.features).withColumns({
            "scaled": vector_to_array("features"), "__z": vector_to_array("components")})
        rebuilt = F.array(*[
            sum((F.get("__z", F.lit(k)) * F.lit(float(w)) for k, w in enumerate(weights)),
                F.lit(0.0)) for weights in directions])
        return (scored.withColumn("rebuilt", rebuilt)
                .withColumn("squared_errors", F.zip_with(
                    "scaled", "rebuilt", lambda a, b: (a - b) * (a - b)))
                .withColumn("anomaly_score", F.aggregate(
                    "squared_errors", F.lit(0.0), lambda s, e: s + e) / len(self.features))
                .select(*rows.columns, "scaled", "rebuilt", "squared_errors", "anomaly_score"))


def fit_anomaly(train: DataFrame, features: Sequence[str], components: int = 8) -> AnomalyModel:
    pca = PCA(k=min(components, len(features)), inputCol="features", outputCol="components")
    return AnomalyModel(fit_pipeline(train, features, pca, True), tuple(features))


def anomaly_threshold(errors: DataFrame, quantile: float = 0.99) -> Column:
    return exact_quantiles(errors, "anomaly_score", {"q": quantile}).scalar()


def error_contributions(errors: DataFrame, features: Sequence[str], threshold: Column) -> DataFrame:
    """Mean squared error per feature over flagged rows, largest first."""
    names = F.array(*[F.lit(f) for f in features])
    return (errors.where(F.col("anomaly_score") >= threshold)
            .select(F.explode(F.arrays_zip(names.alias("feature"), F.col("squared_errors"))).alias("e"))
            .select(F.col("e.feature").alias("feature"), F.col("e.squared_errors").alias("error"))
            .groupBy("feature").agg(F.avg("error").alias("mean_flagged_squared_error"))
            .orderBy(F.desc("mean_flagged_squared_error")))


# --- purchase within 30 days --------------------------------------------------------------------
def sequence_vector(padded: DataFrame, categories: int) -> DataFrame:
    """Adds ``features``: scaled amounts, scaled gaps, category counts and sequence length."""
    counts = [F.size(F.filter("categories", lambda c, i=i: c == i)).cast("double")
              for i in range(1, categories + 2)]
    return padded.withColumn("features", array_to_vector(F.concat(
        "amounts", "gaps", F.array(*counts, F.col("length").cast("double")))))


def fit_sequence_model(padded: DataFrame, categories: int) -> PipelineModel:
    rows = evaluation.with_class_weight(sequence_vector(padded, categories), "label")
    return Pipeline(stages=[LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="class_weight", regParam=1e-3,
        maxIter=100)]).fit(materialize(rows.select("features", "label", "class_weight")))


def score_sequences(model: PipelineModel, padded: DataFrame, categories: int) -> DataFrame:
    scored = model.transform(sequence_vector(padded, categories))
    return scored.withColumn("probability_1", F.get(vector_to_array("probability"), F.lit(1))
                             ).select(*padded.columns, "probability_1")

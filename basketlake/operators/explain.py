"""Explanations of scores: importances, local drivers, representatives, text, dependence.

Every method rescores altered copies of rows in one ``transform``: the copies are made with an
explode over the few features or grid values, never with a join of rows against rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.functions.distributed import exact_quantiles, hashed_rank
from basketlake.operators import evaluation, models
from basketlake.session import materialize

Scorer = Callable[[DataFrame], DataFrame]


def linear_contributions(model: PipelineModel, rows: DataFrame, features: Sequence[str]
                         ) -> DataFrame:
    """w * (x - mean) per customer and feature of a standardized linear model, long form."""
    weights = [float(w) for w in model.stages[-1].coefficients.toArray()]
    prepared = rows.withColumns({f: F.col(f).cast("double") for f in features})
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    names, factors = (F.array(*[F.lit(x) for x in xs]) for xs in (features, weights))
    return prepared.select(
        "customer_id", F.explode(F.arrays_zip(
            names.alias("feature"), factors.alias("w"),
            vector_to_array("features").alias("x"))).alias("e")).select(
        "customer_id", F.col("e.feature").alias("feature"),
        (F.col("e.w") * F.col("e.x")).alias("contribution"))


def global_importance(contributions: DataFrame) -> DataFrame:
    return (contributions.groupBy("feature")
            .agg(F.avg(F.abs("contribution")).alias("mean_absolute_contribution"))
            .orderBy(F.desc("mean_absolute_contribution"), "feature"))


def _variants(rows: DataFrame, features: Sequence[str], donor: Callable[[str], Column]
              ) -> DataFrame:
    """One copy of every row per feature, with that feature replaced by ``donor(feature)``."""
    exploded = rows.withColumn("changed", F.explode(F.array(*[F.lit(f) for f in features])))
    return exploded.withColumns({
        f: F.when(F.col("changed") == f, donor(f).cast("double"))
        .otherwise(F.col(f).cast("double")) for f in features})


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: few of them make many copies to score."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def permutation_importance(scorer: Scorer, rows: DataFrame, features: Sequence[str], label: str,
                           score: str = "probability_1") -> DataFrame:
    """Loss of AUC when a feature comes from another row.

    Rows and donors are paired by two independent hash orders: an exact random permutation without
    any global sort.
    """
    own = hashed_rank(rows, "customer_id", "rows", rank="__place", size="__n")
    donors = hashed_rank(rows, "customer_id", "donors", rank="__place", size="__n").select(
        "__place", *[F.col(f).alias(f"__d_{f}") for f in features])
    paired = _spread(own.join(donors, "__place"))
    changed = _variants(paired, features, lambda f: F.col(f"__d_{f}")).select(
        "customer_id", label, "changed", *features)
    # the curve reads its scores several times: they are written once
    permuted = evaluation.roc_auc(materialize(scorer(changed).select("changed", label, score)),
                                  label, score, ["changed"])
    base = evaluation.roc_auc(materialize(scorer(rows).select(label, score)), label, score).scalar()
    return permuted.select(F.col("changed").alias("feature"),
                           (base - F.col("roc_auc")).alias("importance"))


def permutation_change(scorer: Scorer, rows: DataFrame, features: Sequence[str], score: str
                       ) -> DataFrame:
    """Mean absolute change of a score when a feature comes from another row."""
    own = hashed_rank(rows, "customer_id", "rows", rank="__place", size="__n")
    donors = hashed_rank(rows, "customer_id", "donors", rank="__place", size="__n").select(
        "__place", *[F.col(f).alias(f"__d_{f}") for f in features])
    changed = _variants(_spread(own.join(donors, "__place")), features, lambda f: F.col(f"__d_{f}")).select(
        "customer_id", "changed", *features)
    base = scorer(rows).select("customer_id", F.col(score).alias("__base"))
    return (scorer(changed).join(base, "customer_id").groupBy(F.col("changed").alias("feature"))
            .agg(F.avg(F.abs(F.col(score) - F.col("__base"))).alias("importance")))


def local_drivers(scorer: Scorer, rows: DataFrame, training: DataFrame, features: Sequence[str],
                  score: str = "probability_1") -> DataFrame:
    """Per customer and feature: base score minus the score with the training median instead."""
    values = training.select(F.explode(F.create_map(
        *[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "v"))
    medians = exact_quantiles(values, "v", {"median": 0.5}, ["feature"]).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    base = scorer(rows).select("customer_id", F.col(score).alias("base_score"),
                               *[F.col(f).cast("double").alias(f) for f in features])
    changed = _variants(base.withColumn("__m", medians), features, lambda f: F.col("__m")[f]).drop(
        "__m")
    return scorer(changed).select(
        "customer_id", F.col("changed").alias("feature"), F.col("base_score").alias("probability"),
        (F.col("base_score") - F.col(score)).alias("contribution"))


def representatives(scored: DataFrame, threshold: float, score: str = "probability_1") -> DataFrame:
    """The lowest, the nearest-to-threshold and the highest risk, ties by customer."""
    who = F.col("customer_id")
    row = F.struct(who, F.col(score).alias("p"))
    near = F.struct(F.abs(F.col(score) - F.lit(threshold)), who)
    picked = scored.agg(
        F.min_by(row, F.struct(F.col(score), who)).alias("low"),
        F.min_by(row, near).alias("borderline"),
        F.min_by(row, F.struct(-F.col(score), who)).alias("high"))
    return picked.selectExpr(
        "stack(3, 'low', low.customer_id, low.p, 'borderline', borderline.customer_id, "
        "borderline.p, 'high', high.customer_id, high.p) as (risk_profile, customer_id, probability)")


def plain_language(drivers: DataFrame, threshold: float) -> DataFrame:
    """One sentence per customer from its three strongest drivers in each direction.

    ``drivers`` has customer_id, probability, feature, contribution.
    """
    up = F.col("contribution") > 0
    down = F.col("contribution") < 0

    def three(mask: Column, sign: int) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(mask, F.struct(
            (sign * F.col("contribution")).alias("order"), F.col("feature").alias("feature")))))
        return F.transform(F.slice(ordered, 1, 3), lambda e: e["feature"])

    def words(names: str, none: str) -> Column:
        return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(none)

    # A customer has one row per feature, so the lists are as short as the feature schema.
    gathered = drivers.groupBy("customer_id", "probability").agg(
        three(up, -1).alias("upward"), three(down, 1).alias("downward"))
    above = F.col("probability") >= F.lit(threshold)
    percent = lambda x: F.concat(
        F.format_string("%.1f", F.round(x * 100, 1)), F.lit("%"))
    text = F.concat(
        F.lit("Estimated churn risk is "), percent(F.col("probability")), F.lit(", "),
        F.when(above, "above").otherwise("below"), F.lit(" the frozen "),
        percent(F.lit(threshold)), F.lit(" decision threshold; "),
        F.when(above, "prioritize for retention review").otherwise("monitor normally"),
        F.lit(". Main upward drivers: "), words("upward", "no dominant upward driver"),
        F.lit(". Main risk-reducing drivers: "),
        words("downward", "no dominant downward driver"), F.lit("."))
    return gathered.select("customer_id", "probability", text.alias("text"))


def _grid_ends(training: DataFrame, features: Sequence[str]) -> DataFrame:
    values = training.select(F.explode(F.create_map(
        *[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "v"))
    return exact_quantiles(values, "v", {"a": 0.05, "b": 0.95}, ["feature"])


def partial_dependence(scorer: Scorer, training: DataFrame, features: Sequence[str],
                       all_features: Sequence[str], points: int = 30,
                       score: str = "probability_1") -> DataFrame:
    """Mean score when one feature is set to each of ``points`` values from its 5th to 95th pct."""
    ends = _grid_ends(training, features).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("a", "b")))).alias("m")
    ).scalar()
    copies = (training.withColumn("__ends", ends)
              .withColumn("changed", F.explode(F.array(*[F.lit(f) for f in features])))
              .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
              .withColumn("grid_value", F.expr(
                  f"__ends[changed].a + (__ends[changed].b - __ends[changed].a) * step / {points - 1}")))
    altered = copies.withColumns({
        f: F.when(F.col("changed") == f, F.col("grid_value")).otherwise(F.col(f).cast("double"))
        for f in features}).select("customer_id", "changed", "step", "grid_value", *all_features)
    return scorer(altered).groupBy(F.col("changed").alias("feature"), "step").agg(
        F.first("grid_value").alias("grid_value"), F.avg(score).alias("mean_score"))


def forest_dependence(model: PipelineModel, training: DataFrame, features: Sequence[str],
                      all_features: Sequence[str], points: int = 30) -> DataFrame:
    """``partial_dependence`` of a forest's class 1, without a copy of the rows for every grid value.

    A row goes down every tree once per feature and takes both sides of that feature's splits; the leaves
    it ends in, each with the interval of the feature that leads there, hold its score at every grid value.
    Tasks send back one sum per feature and grid value.
    """
    grid = _grid_ends(training, features).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "grid_value", F.expr(f"a + (b - a) * step / {points - 1}"))
    # the preprocessing of the fit, column by column, also places the grid values
    shown = _prepared(model, grid.withColumns({f: F.col("grid_value") for f in all_features})).select(
        "feature", "step", "grid_value", "x").collect()
    places = [(f, list(all_features).index(f), sorted(
        (r.step, r.grid_value, r.x[list(all_features).index(f)]) for r in shown if r.feature == f)) for f in features]
    context = training.sparkSession.sparkContext
    trees = context.broadcast(models.forest_tables(model.stages[-1], training.sparkSession))

    def descend(tree, x, free, into):
        """Adds the rows (columns of ``x``) that reach each leaf on either side of splits on ``free``."""
        feature, threshold, left, right, _ = tree
        reached = {0: np.arange(x.shape[1])}
        while reached:
            node, rows = reached.popitem()
            if feature[node] < 0:
                into[node] += len(rows)
            elif feature[node] == free:
                reached[left[node]] = reached[right[node]] = rows
            elif len(rows):
                low = x[feature[node]][rows] <= threshold[node]
                reached[left[node]], reached[right[node]] = rows[low], rows[~low]

    def intervals(tree, free):
        """Per node: values of ``free`` above the first and up to the second lead to it."""
        feature, threshold, left, right, _ = tree
        low, high = np.full(len(feature), -np.inf), np.full(len(feature), np.inf)
        for node in np.flatnonzero(feature >= 0):
            both = [left[node], right[node]]
            low[both], high[both] = low[node], high[node]
            if feature[node] == free:
                high[left[node]] = min(high[node], threshold[node])
                low[right[node]] = max(low[node], threshold[node])
        return low, high

    def sums(batches):
        counts = [[np.zeros(len(tree[0]), np.int64) for tree in trees.value] for _ in places]
        n = 0
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), -1).T.copy()
            n += len(batch)
            for (_, column, _), held in zip(places, counts):
                for tree, into in zip(trees.value, held):
                    descend(tree, x, column, into)
        for (name, column, steps), held in zip(places, counts):
            at = np.array([v for _, _, v in steps])
            total = np.zeros(len(at))
            for tree, reached in zip(trees.value, held):
                low, high = intervals(tree, column)
                leaf = np.flatnonzero(reached)
                inside = (low[leaf, None] < at) & (at <= high[leaf, None])
                total += (reached[leaf] * tree[4][leaf]) @ inside
            yield pd.DataFrame({"feature": name, "step": np.array([s for s, _, _ in steps], "int32"),
                                "grid_value": [g for _, g, _ in steps], "total": total / len(held), "n": n})

    rows = _prepared(model, _spread(models.as_doubles(training.select(*all_features), all_features))).select("x")
    return rows.mapInPandas(sums, "feature string, step int, grid_value double, total double, n bigint").groupBy(
        "feature", "step").agg(F.first("grid_value").alias("grid_value"),
                               (F.sum("total") / F.sum("n")).alias("mean_score"))


def _prepared(model: PipelineModel, rows: DataFrame) -> DataFrame:
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return rows.withColumn("x", vector_to_array("features"))


def event_masking(scorer: Scorer, padded: DataFrame) -> DataFrame:
    """Probability change when one event of a sequence is blanked, per position."""
    base = scorer(padded).withColumnRenamed("probability_1", "base_probability")
    copies = base.withColumn("masked", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))

    def blank(name: str, zero: Column) -> Column:
        return F.transform(name, lambda x, i: F.when(i == F.col("masked"), zero).otherwise(x))

    altered = copies.withColumns({
        "amounts": blank("amounts", F.lit(0.0)), "gaps": blank("gaps", F.lit(0.0)),
        "categories": blank("categories", F.lit(0))})
    return scorer(altered).select(
        "customer_id", "cutoff_timestamp", F.col("masked").alias("event_position_oldest_zero"),
        (F.col("length") - F.col("masked")).alias("event_recency_rank"), "base_probability",
        F.col("probability_1").alias("masked_probability"),
        (F.col("base_probability") - F.col("probability_1")).alias("probability_delta"))


def worst_anomaly(errors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per-feature values and squared errors of the row with the largest score."""
    worst = errors.agg(F.max_by(
        F.struct("customer_id", "scaled", "rebuilt", "squared_errors"),
        F.struct("anomaly_score", "customer_id")).alias("w"))
    names = F.array(*[F.lit(f) for f in features])
    return worst.select("w.customer_id", F.explode(F.arrays_zip(
        names.alias("feature"), F.col("w.scaled").alias("scaled"),
        F.col("w.rebuilt").alias("rebuilt"),
        F.col("w.squared_errors").alias("error"))).alias("e")).select(
        "customer_id", F.col("e.feature").alias("feature"),
        F.col("e.scaled").alias("scaled_value"), F.col("e.rebuilt").alias("reconstructed_value"),
        F.col("e.error").alias("squared_error_contribution"))



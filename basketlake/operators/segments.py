"""Customer segments: model search, quality measures, profiles and names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.operators import kmeans as means, mixtures as gaussian, models
from basketlake.session import materialize
from basketlake.settings import SEGMENT_NAMES

SEED = 42


def davies_bouldin(points: DataFrame, cluster: str, coordinates: Sequence[str]) -> DataFrame:
    """Davies-Bouldin index of given labels, one row. Only cluster rows are compared in pairs."""
    centres = points.groupBy(cluster).agg(*[F.avg(c).alias(f"m_{c}") for c in coordinates])
    distance = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}"))
                           for c in coordinates), F.lit(0.0)))
    spread = (points.join(F.broadcast(centres), cluster).groupBy(cluster)
              .agg(F.avg(distance).alias("s"), *[F.first(f"m_{c}").alias(f"m_{c}")
                                                 for c in coordinates]))
    own = spread.select(F.struct(F.col(cluster).alias("c"), "s", F.array(
        *[f"m_{c}" for c in coordinates]).alias("m")).alias("a"))
    # A handful of clusters: all of them fit one array next to each cluster.
    every = own.agg(F.collect_list("a").alias("all")).scalar()
    pairs = own.withColumn("b", F.explode(every)).where(F.col("a.c") != F.col("b.c"))
    apart = F.sqrt(F.aggregate(F.zip_with("a.m", "b.m", lambda x, y: (x - y) * (x - y)),
                               F.lit(0.0), lambda t, x: t + x))
    return (pairs.groupBy("a.c").agg(F.max((F.col("a.s") + F.col("b.s")) / apart).alias("r"))
            .agg(F.avg("r").alias("davies_bouldin")))


def _coordinates(points: DataFrame, width: int) -> DataFrame:
    x = vector_to_array("features")
    return points.select("cluster", *[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(width)])


def _measure(labelled: DataFrame, width: int) -> tuple[float, float]:
    """Silhouette and Davies-Bouldin of a labelling with at least two used clusters."""
    used = labelled.select("cluster").distinct().count()
    if used < 2:
        return float("nan"), float("nan")
    silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(labelled)
    flat = _coordinates(labelled, width)
    index = davies_bouldin(flat, "cluster", [f"x{i}" for i in range(width)]).first()[0]
    return float(silhouette), float(index)


def search(train: DataFrame, features: Sequence[str], kmeans: Sequence[int] = tuple(range(3, 9)),
           mixtures: Sequence[int] = tuple(range(2, 9)), kmeans_starts: int = 20,
           mixture_starts: int = 5):
    """Fit all candidates on scaled training rows, each from several starts, and keep its best.

    Returns the preprocessing, the chosen K-means and mixture models, and one report row each.
    K-means wins by silhouette, then Davies-Bouldin; a mixture (diagonal covariances) by BIC, then
    silhouette. All fits of all starts take their steps together.
    """
    prepared = models.fit_pipeline(train, features, None, True)
    points = materialize(models.transform(prepared, train, features).select("customer_id", "features"))
    n, p = points.count(), len(features)
    rows, fitted = [], {}
    values = vector_to_array("features")
    centred = means.fit(points, values, F.col("customer_id"), kmeans, kmeans_starts, seed=SEED) if kmeans else {}
    best = {k: means.best_of(centred, k) for k in kmeans}
    labelled = points
    for k, model in best.items():
        labelled = model.assigned(labelled, values, f"c{k}")
    # several measures read the labels: they are written once
    labelled = materialize(labelled) if best else labelled
    measured = models.side_by_side([lambda k=k: _measure(labelled.select(
        "features", F.col(f"c{k}").alias("cluster")), p) for k in best])
    for (k, model), (silhouette, index) in zip(best.items(), measured, strict=True):
        fitted["kmeans", k] = model
        rows.append(("kmeans", k, silhouette, index, model.cost, None))
    found = gaussian.fit(points, values, F.col("customer_id"), mixtures, mixture_starts, seed=SEED) if mixtures else {}
    for k in mixtures:
        model = gaussian.best_of(found, k)
        silhouette, index = _measure(model.assigned(points, values, "cluster"), p)
        fitted["gmm", k] = model
        rows.append(("gmm", k, silhouette, index, None, model.bic(n)))

    def known(x):
        return x if x == x else -math.inf

    best_kmeans = min((r for r in rows if r[0] == "kmeans"), key=lambda r: (-known(r[2]), r[3]),
                      default=None)
    best_gmm = min((r for r in rows if r[0] == "gmm"), key=lambda r: (r[5], -known(r[2])),
                   default=None)
    chosen = {r[:2] for r in (best_kmeans, best_gmm) if r}
    report = train.sparkSession.createDataFrame(
        [(*r, r[:2] in chosen) for r in rows],
        "algorithm string, components int, silhouette double, davies_bouldin double, "
        "inertia double, bic double, selected boolean")
    pick = {a: fitted[a, k] for a, k in chosen}
    return prepared, pick, report


def assign(rows: DataFrame, features: Sequence[str], prepared: PipelineModel, picked: Mapping) -> DataFrame:
    """(customer_id, partition, kmeans_segment, gmm_segment) for the given rows."""
    out = models.transform(prepared, rows, features).select("customer_id", "partition", "features")
    for name, model in picked.items():
        out = model.assigned(out, vector_to_array("features"), f"{name}_segment")
    return out.select("customer_id", "partition", *[f"{name}_segment" for name in picked])


def profiles(rows: DataFrame, segment: str, features: Sequence[str]) -> DataFrame:
    return rows.groupBy(segment).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features],
                                     F.count(F.lit(1)).alias("customer_count"))


def business_labels(profile: DataFrame, segment: str, names: Sequence[str] = SEGMENT_NAMES
                    ) -> DataFrame:
    """Names segments from best to worst by average-rank shares; one row per segment."""
    whole = Window.partitionBy(F.lit(0))  # one row per segment

    def share(column: str):
        rank = F.rank().over(whole.orderBy(column))
        peers = F.count(F.lit(1)).over(Window.partitionBy(column))
        return (rank + (peers - 1) / 2.0) / F.count(F.lit(1)).over(whole)

    scored = profile.withColumn("__score", F.round(
        -share("recency_days") + share("frequency_orders") + share("net_spend"), 9))
    place = F.row_number().over(whole.orderBy(F.desc("__score"), segment))
    labels = F.array(*[F.lit(n) for n in names])
    return (scored.withColumn("business_label", F.get(labels, place - 1)).drop("__score"))


def projection(train: DataFrame, rows: DataFrame, features: Sequence[str], size: int = 1000
               ) -> DataFrame:
    """Two principal coordinates of a seeded sample of customers (a display sample)."""
    model = models.fit_pipeline(train, features, PCA(k=2, inputCol="features", outputCol="pca"),
                                True)
    xy = vector_to_array("pca")
    sample = rows.orderBy(F.md5(F.concat(F.lit(f"{SEED}|"), "customer_id"))).limit(size)
    return models.transform(model, sample, features).select(
        "customer_id", "partition", F.get(xy, F.lit(0)).alias("pca_1"),
        F.get(xy, F.lit(1)).alias("pca_2"))

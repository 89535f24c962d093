"""Gaussian mixtures with diagonal covariances: any number of fits side by side, one aggregate a step.

Spark ML fits full covariances only. Here a step of expectation and maximization is one pass for all
fits (numbers of components and starts): every block of rows gives, for each fit, the weights of its
components and the sums of differences and squared differences from their present means; a tree of
additions on the executors leaves one array a fit for the driver. A variance is never below ``floor``.
As the largest likelihood of a bounded variance lies at the bound, the likelihood never falls.

Starts are k-means centres of a seeded sample of at most ``START_ROWS`` rows (a bounded choice of where to
begin); every step reads all rows. Rows hold arrays of finite numbers: impute them before. A table without
rows has no mixture and raises ValueError; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.session import shared_folder

FLOOR = 1e-5
START_ROWS = 2_000
BLOCK_ROWS, LEAST_ROWS = 50_000, 2_000
LLOYD_STEPS = 10


@dataclass(frozen=True)
class DiagonalMixture:
    """Weights (k), means and variances (k x p). ``trace`` holds the log-likelihood before every step and at the end."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    trace: tuple[float, ...] = ()

    @property
    def log_likelihood(self) -> float:
        return self.trace[-1]

    @property
    def free_parameters(self) -> int:
        k, p = self.means.shape
        return 2 * k * p + k - 1

    def bic(self, rows: int) -> float:
        return self.free_parameters * math.log(rows) - 2.0 * self.log_likelihood

    def log_densities(self, values: Column) -> Column:
        """An array of log(weight x density), one entry a component; a component without weight has minus infinity."""
        def numbers(found) -> Column:
            return F.array(*[F.lit(float(v)) for v in found])

        # arrays and lambdas: an expression for each component and coordinate outgrows a generated method
        with np.errstate(divide="ignore"):
            known = np.log(self.weights) - 0.5 * np.log(2 * math.pi * self.variances).sum(axis=1)
        parts = F.array(*[F.struct(F.lit(float(c)).alias("known"), numbers(m).alias("mean"), numbers(v).alias("variance"))
                          for c, m, v in zip(known, self.means, self.variances)])

        def apart(part: Column) -> Column:
            shares = F.zip_with(F.zip_with(values, part["mean"], lambda x, m: (x - m) * (x - m)), part["variance"], lambda d, v: d / v)
            return F.aggregate(shares, F.lit(0.0), lambda s, d: s + d)

        return F.transform(parts, lambda part: part["known"] - apart(part) / 2)

    def assigned(self, rows: DataFrame, values: Column, output: str, probabilities: str | None = None,
                 log_density: str | None = None) -> DataFrame:
        """Adds the likeliest component (ties: the smaller), and on request all chances and the log density of the row."""
        told = rows.withColumn("__values", values).withColumn("__logs", self.log_densities(F.col("__values")))
        told = told.withColumn("__top", F.array_max("__logs")).withColumn(
            output, (F.array_position("__logs", F.col("__top")) - 1).cast("int"))
        mass = F.aggregate("__logs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("__top")))
        if log_density:
            told = told.withColumn(log_density, F.col("__top") + F.log(mass))
        if probabilities:
            told = told.withColumn("__mass", mass).withColumn(probabilities, F.transform(
                "__logs", lambda v: F.exp(v - F.col("__top")) / F.col("__mass"))).drop("__mass")
        return told.drop("__values", "__logs", "__top")

    def measured(self, rows: DataFrame, values: Column) -> DataFrame:
        """One row: components, rows, free parameters, log-likelihood and BIC of these parameters on the given rows."""
        logs = self.assigned(rows, values, "__c", log_density="__log").agg(
            F.count(F.lit(1)).alias("n"), F.sum("__log").alias("log_likelihood"))
        return logs.select(
            F.lit(len(self.weights)).alias("components"), "n", F.lit(self.free_parameters).alias("parameters"), "log_likelihood",
            (F.lit(float(self.free_parameters)) * F.log("n") - 2.0 * F.col("log_likelihood")).alias("bic"))


def of_labels(rows: DataFrame, label: str, coordinates: Sequence[str], floor: float = FLOOR) -> DiagonalMixture:
    """The mixture that given labels describe: shares, means and floored variances of their rows."""
    found = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(coordinates)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(coordinates)]).orderBy(label).collect()  # a row a label
    if not found:
        raise ValueError("a mixture needs rows")
    n = np.array([r["n"] for r in found], float)
    pick = [np.array([[r[f"{kind}{i}"] for i in range(len(coordinates))] for r in found], float).reshape(len(found), -1) for kind in "mv"]
    return DiagonalMixture(n / n.sum(), pick[0], np.maximum(pick[1], floor))


def fit(rows: DataFrame, values: Column, key: Column, components: Sequence[int], starts: int = 5, steps: int = 100,
        tolerance: float = 1e-3, floor: float = FLOOR, seed: int = 42) -> dict[tuple[int, int], DiagonalMixture]:
    """(components, start) -> mixture. A fit ends when the mean log-likelihood gains less than ``tolerance``.

    ``key`` names a row; it and the seed choose the sample of the starts, whatever the partitions are.
    """
    spark = rows.sparkSession
    sample = np.array([r[0] for r in rows.select(values.alias("x"), key.alias("k")).orderBy(
        F.xxhash64(F.lit(seed), "k"), "k").limit(START_ROWS).select("x").collect()], float)
    if not len(sample):
        raise ValueError("a mixture needs rows")
    now = {(k, s): _start(sample, k, np.random.default_rng([seed, k, s]), floor) for k in components for s in range(starts)}
    traces: dict[tuple[int, int], list[float]] = {asked: [] for asked in now}
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // BLOCK_ROWS), min(cores, -(-n // LEAST_ROWS)))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    width = sample.shape[1]
    packed = rows.select(values.alias("x")).repartition(parts).mapInArrow(_packed, "x binary")
    blocks = packed.rdd.map(lambda r: np.frombuffer(r["x"], "f8").reshape(-1, width))
    blocks.persist()
    blocks.checkpoint()
    blocks.count()
    try:
        running = set(now)
        for step in range(steps + 1):
            found = _sums(blocks, {asked: now[asked] for asked in running})
            for asked, (total, mass, first, second) in found.items():
                trace = traces[asked]
                trace.append(total)
                if step == steps or (len(trace) > 1 and trace[-1] - trace[-2] < tolerance * n):
                    running.discard(asked)
                else:
                    now[asked] = _maximized(now[asked], n, mass, first, second, floor)
            if not running:
                break
    finally:
        blocks.unpersist()
    return {asked: DiagonalMixture(m.weights, m.means, m.variances, tuple(traces[asked])) for asked, m in now.items()}


def best_of(fitted: Mapping[tuple[int, int], DiagonalMixture], components: int) -> DiagonalMixture:
    """The likeliest of the starts of a number of components; ties go to the earlier start."""
    return max((m for (k, _), m in sorted(fitted.items()) if k == components), key=lambda m: m.log_likelihood)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype="f8")
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["x"])


def _start(sample: np.ndarray, k: int, rng: np.random.Generator, floor: float) -> DiagonalMixture:
    """Centres drawn far apart and moved to the means of their rows a few times."""
    centres = [sample[rng.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = nearest.sum()
        at = rng.choice(len(sample), p=nearest / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[at])
        nearest = np.minimum(nearest, ((sample - centres[-1]) ** 2).sum(axis=1))
    means = np.array(centres)
    for _ in range(LLOYD_STEPS):
        label = np.stack([((sample - m) ** 2).sum(axis=1) for m in means], axis=1).argmin(axis=1)
        means = np.array([sample[label == c].mean(axis=0) if (label == c).any() else means[c] for c in range(k)])
    whole = np.maximum(sample.var(axis=0), floor)
    variances = np.array([np.maximum(sample[label == c].var(axis=0), floor) if (label == c).sum() > 1 else whole for c in range(k)])
    counts = np.bincount(label, minlength=k) + 1.0
    return DiagonalMixture(counts / counts.sum(), means, variances)


def _maximized(m: DiagonalMixture, n: int, mass: np.ndarray, first: np.ndarray, second: np.ndarray, floor: float) -> DiagonalMixture:
    held = mass > 1e-12
    safe = np.where(held, mass, 1.0)[:, None]
    shift = np.where(held[:, None], first / safe, 0.0)
    spread = np.maximum(second / safe - shift ** 2, floor)
    return DiagonalMixture(mass / n, m.means + shift, np.where(held[:, None], spread, m.variances))


def _sums(blocks, asked: Mapping[tuple[int, int], DiagonalMixture]) -> dict:
    """For each fit: log-likelihood, and by component the weight and the sums of differences and their squares."""
    def of(x: np.ndarray) -> dict:
        out = {}
        for name, m in asked.items():
            k, p = m.means.shape
            with np.errstate(divide="ignore"):
                known = np.log(m.weights) - 0.5 * np.log(2 * math.pi * m.variances).sum(axis=1)
            logs = np.stack([known[c] - 0.5 * ((x - m.means[c]) ** 2 / m.variances[c]).sum(axis=1) for c in range(k)], axis=1)
            top = logs.max(axis=1)
            chance = np.exp(logs - top[:, None])
            whole = chance.sum(axis=1)
            chance /= whole[:, None]
            first, second = np.empty((k, p)), np.empty((k, p))
            for c in range(k):
                apart = x - m.means[c]
                first[c], second[c] = chance[:, c] @ apart, chance[:, c] @ (apart * apart)
            out[name] = (float((top + np.log(whole)).sum()), chance.sum(axis=0), first, second)
        return out

    def add(one: dict, two: dict) -> dict:
        return {name: tuple(a + b for a, b in zip(one[name], two[name])) for name in one}

    return blocks.map(of).treeReduce(add)

"""Gradient-boosted trees for any number of models in one loop over binned rows.

Spark ML boosts for squared error and two classes only. Here a model names its loss (squared, logistic,
Tweedie deviance with a log link, or softmax over classes), its target, its row weights (0 leaves a row
out, which is how folds share one table), its depth, rounds, shares of rows and columns. Features are
binned once for all models, and the rows kept as numpy blocks of bounded size in a persisted RDD: hundreds
of short passes with sums of arrays are what DataFrames are slow at. A level of all trees of a round is
one pass: every task sums gradients, curvatures and row counts by (tree node, feature, bin) over its blocks.
Where the sums of all tasks are small, the driver adds them and chooses the splits; else they are added by
tree on the executors, which choose the splits, and the driver sees the chosen ones only. Trees of very many
sums share several passes. Blocks carry the scores of all trees but the last few, which every pass adds for itself: keeping
the blocks anew costs more than a few trees. Every few rounds they are checkpointed in the shared folder, so a
lost executor costs those few rounds of scores at most.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.session import shared_folder

BINS = 64
RENEW = 16
NEAR = 3
LATE = 4  # trees that passes add for themselves, before blocks are kept with them
BLOCK_ROWS, LEAST_ROWS, TASK_ROWS = 50_000, 2_000, 200_000
PASS_BYTES, DRIVER_BYTES = 96_000_000, 16_000_000  # sums of a task in one pass; of all tasks on the driver


@dataclass(frozen=True)
class Boost:
    """One model to fit. ``target`` is the class index for softmax; a weight of 0 leaves a row out.

    Both children of a split hold at least ``min_rows`` rows and ``min_weight`` of summed curvature.
    """

    loss: str
    target: Column
    weight: Column = field(default_factory=lambda: F.lit(1.0))
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    min_rows: int = 1
    min_weight: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    ridge: float = 1.0
    power: float = 1.5
    classes: int = 1
    seed: int = 42


@dataclass(frozen=True)
class Rule:
    """What tasks need to know of a model."""

    loss: str
    power: float
    min_rows: int
    min_weight: float
    row_share: float
    ridge: float
    classes: int
    seed: int


@dataclass(frozen=True)
class Tree:
    """A full binary tree, level by level: node i has children 2i and 2i + 1; feature -1 sends all rows
    left. ``covers`` are the training rows of every node, the leaves' included."""

    features: tuple[np.ndarray, ...]
    bins: tuple[np.ndarray, ...]
    covers: tuple[np.ndarray, ...]
    leaves: np.ndarray


def descend(x: np.ndarray, features: Sequence[np.ndarray], bins: Sequence[np.ndarray]) -> np.ndarray:
    """The node of each row of bins after the given levels."""
    node = np.zeros(len(x), np.int64)
    every = np.arange(len(x))
    for f, b in zip(features, bins):
        at = f[node]
        node = 2 * node + ((at >= 0) & (x[every, at] > b[node]))
    return node


def gradients(loss: str, y: np.ndarray, raw: np.ndarray, k: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the k-th score; ``raw`` has a column for each class."""
    if loss == "squared":
        return raw[:, 0] - y, np.ones(len(y))
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-raw[:, 0]))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    if loss == "tweedie":
        small, large = np.exp((1 - power) * raw[:, 0]), np.exp((2 - power) * raw[:, 0])
        return large - y * small, (2 - power) * large + (power - 1) * y * small
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    p = e[:, k] / e.sum(axis=1)
    return p - (y == k), np.maximum(p * (1 - p), 1e-16)


def deviance(loss: str, y: np.ndarray, raw: np.ndarray, power: float = 1.5) -> np.ndarray:
    """The loss of each row."""
    if loss == "squared":
        return (raw[:, 0] - y) ** 2 / 2
    if loss == "logistic":
        return np.logaddexp(0, raw[:, 0]) - y * raw[:, 0]
    if loss == "tweedie":
        return np.exp((2 - power) * raw[:, 0]) / (2 - power) - y * np.exp((1 - power) * raw[:, 0]) / (1 - power)
    top = raw.max(axis=1)
    return top + np.log(np.exp(raw - top[:, None]).sum(axis=1)) - raw[np.arange(len(y)), y.astype(int)]


def split(sums: np.ndarray, allowed: np.ndarray, boost: Boost | Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, sums of both children) of every node; sums are (3, nodes, features, bins).

    Ties go to the smaller feature, then the smaller bin; a node without a gain keeps its rows.
    """
    one = int(np.argmax(allowed))
    total = sums[:, :, one:one + 1, :].sum(axis=3, keepdims=True)
    left = np.cumsum(sums, axis=3)[..., :-1]
    right = total - left

    def value(s: np.ndarray) -> np.ndarray:
        return s[0] ** 2 / (s[1] + boost.ridge)

    gain = value(left) + value(right) - value(total)
    fits = (left[2] >= boost.min_rows) & (right[2] >= boost.min_rows) & allowed[None, :, None] & (
        np.minimum(left[1], right[1]) >= boost.min_weight)
    gain = np.where(fits, gain, -np.inf)
    nodes = gain.shape[0]
    best = gain.reshape(nodes, -1).argmax(axis=1)
    feature, at = np.divmod(best, gain.shape[2])
    every = np.arange(nodes)
    good = gain[every, feature, at] > 1e-9
    whole = total[:, :, 0, 0]
    children = np.empty((3, 2 * nodes))
    children[:, 0::2] = np.where(good, left[:, every, feature, at], whole)
    children[:, 1::2] = np.where(good, right[:, every, feature, at], 0.0)
    return np.where(good, feature, -1), np.where(good, at, 0), children


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _drawn(key: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """A share of the rows by a hash of their key, the round and the seed, whatever partition they are in."""
    h = key.view(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) < np.uint64(int(share * (2 ** 64 - 1)))


@dataclass(frozen=True)
class BoostedModel:
    """Fitted trees: round by round, one for each class (one for other losses)."""

    boost_loss: str
    power: float
    features: tuple[str, ...]
    medians: np.ndarray
    edges: tuple[np.ndarray, ...]
    starts: np.ndarray
    trees: tuple[tuple[Tree, ...], ...]

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of feature values; missing ones are the median."""
        x = np.where(np.isnan(values), self.medians, values)
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) \
            if self.edges else np.zeros((len(x), 0), np.int64)

    def raw_of(self, values: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(self.binned(values).T)
        raw = np.tile(self.starts, (x.shape[1], 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                raw[:, k] += tree.leaves[_nodes(x, tree.features, tree.bins)]
        return raw

    def scores_of(self, values: np.ndarray) -> np.ndarray:
        """Predictions: the value, the chance of class 1, or the chances of all classes."""
        raw = self.raw_of(values)
        if self.boost_loss == "squared":
            return raw
        if self.boost_loss == "tweedie":
            return np.exp(raw)
        if self.boost_loss == "logistic":
            return 1.0 / (1.0 + np.exp(-raw))
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _column(self, function, kind: str) -> Column:
        names = self.features

        @F.pandas_udf(kind)
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                values = np.array([np.asarray(v, dtype=float) for v in batch], dtype=float).reshape(len(batch), len(names))
                yield pd.Series(list(function(values)))

        return apply(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in names]))

    def score(self) -> Column:
        """The prediction of the only score, as a double."""
        return self._column(lambda v: self.scores_of(v)[:, 0], "double")

    def raw(self) -> Column:
        return self._column(lambda v: self.raw_of(v)[:, 0], "double")

    def chances(self) -> Column:
        """The chances of all classes, as an array."""
        return self._column(self.scores_of, "array<double>")

    def contributions_of(self, values: np.ndarray, k: int = 0) -> tuple[np.ndarray, float]:
        """Shapley values of the raw score, with what training rows did at nodes whose feature is unknown.

        A leaf's value is a game of the features on its path alone: a known feature lets a row through
        or not, an unknown one lets through the share of the training rows. Their Shapley values have a
        closed form, and a tree's are the sums over its leaves; the base is the mean over the shares.
        """
        x = np.ascontiguousarray(self.binned(values).T)
        out, base = np.zeros((len(self.features), x.shape[1])), float(self.starts[k])
        for trees in self.trees:
            base += _tree_contributions(trees[k], x, out)
        return np.ascontiguousarray(out.T), base

    def contributions(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Long form (keys, feature, contribution), with the row's base and raw score beside."""
        names = list(self.features)
        kind = "struct<base:double,raw_score:double,values:array<double>>"

        @F.pandas_udf(kind)
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = np.array([np.asarray(v, dtype=float) for v in batch], dtype=float).reshape(len(batch), len(names))
                found, base = self.contributions_of(values)
                yield pd.DataFrame({"base": base, "raw_score": self.raw_of(values)[:, 0], "values": list(found)})

        told = rows.select(*keys, apply(F.array(*[
            F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in names])).alias("told"))
        return told.select(*keys, F.explode(F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("told.values").alias("contribution"))).alias("e"),
            "told.base", "told.raw_score").select(*keys, "e.feature", "e.contribution", "base", "raw_score")


def _tree_contributions(tree: Tree, x: np.ndarray, out: np.ndarray) -> float:
    """Adds to ``out``, by feature as ``x``. What a leaf gives a row depends only on which of the features on
    its path the row passes: it is found once for each such pattern, and looked up by row."""
    depth, base = len(tree.features), 0.0
    beyond: dict[tuple[int, int], np.ndarray] = {}
    for leaf, value in enumerate(tree.leaves):
        passes: dict[int, np.ndarray] = {}
        shares: dict[int, float] = {}
        reached = tree.covers[depth][leaf] > 0
        for level in range(depth):
            node, right = leaf >> depth - level, leaf >> depth - level - 1 & 1
            f = int(tree.features[level][node])
            if f < 0:
                reached = reached and not right
                continue
            if (level, node) not in beyond:
                beyond[level, node] = x[f] > tree.bins[level][node]
            goes = beyond[level, node] == bool(right)
            share = tree.covers[level + 1][2 * node + right] / max(1.0, tree.covers[level][node])
            passes[f] = passes[f] & goes if f in passes else goes
            shares[f] = shares.get(f, 1.0) * share
        if not reached:
            continue
        base += value * math.prod(shares.values())
        names = list(passes)
        d = len(names)
        patterns = {f: (np.arange(2 ** d) >> i & 1).astype(bool) for i, f in enumerate(names)}
        pattern = sum((passes[f].astype(np.intp) << i for i, f in enumerate(names)), np.zeros(x.shape[1], np.intp))
        for f in names:
            # coefficients, by the number of known others, of the products over known and unknown ones
            known = [np.ones(2 ** d)]
            for other in names:
                if other != f:
                    p, q = patterns[other], shares[other]
                    known = [(known[i] * q if i < len(known) else 0.0) + (known[i - 1] * p if i else 0.0)
                             for i in range(len(known) + 1)]
            weight = sum(c * (math.factorial(i) * math.factorial(d - 1 - i) / math.factorial(d)) for i, c in enumerate(known))
            out[f] += (value * weight * (patterns[f] - shares[f]))[pattern]
    return base


def _start(boost: Boost, mean: Sequence[float]) -> list[float]:
    if boost.loss == "squared":
        return [mean[0]]
    if boost.loss == "logistic":
        p = min(max(mean[0], 1e-6), 1 - 1e-6)
        return [math.log(p / (1 - p))]
    if boost.loss == "tweedie":
        return [math.log(max(mean[0], 1e-9))]
    return [math.log(max(p, 1e-9)) for p in mean]


def _prepared(rows: DataFrame, features: Sequence[str], key: Column, boosts: Sequence[Boost], medians: np.ndarray,
              edges: list[np.ndarray], starts: np.ndarray) -> DataFrame:
    """(key, bins, targets, weights, scores) of every row, packed by row."""
    asked = rows.select(
        key.alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*[b.target.cast("double") for b in boosts]).alias("y"),
        F.array(*[F.coalesce(b.weight.cast("double"), F.lit(0.0)) for b in boosts]).alias("w"))
    model = BoostedModel("", 0.0, tuple(features), medians, tuple(edges), starts, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y, w = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _binary(model.binned(x).astype(np.uint8)), _binary(np.nan_to_num(y)), _binary(w),
                 _binary(np.tile(starts, (n, 1)))], names=["key", "bins", "y", "w", "raw"])

    return asked.mapInArrow(run, "key bigint, bins binary, y binary, w binary, raw binary")


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The different columns, one a row, and which of them each column is: folds share targets and weights."""
    places = {c.tobytes(): None for c in np.ascontiguousarray(columns.T)}
    order = {c: i for i, c in enumerate(places)}
    at = [order[c.tobytes()] for c in np.ascontiguousarray(columns.T)]
    return np.array([np.frombuffer(c) for c in order]).reshape(len(order), len(columns)), at


def _blocks(prepared: DataFrame, width: int, boosts: int, total: int):
    """An RDD of blocks of at most ``BLOCK_ROWS`` rows: keys, bins (by feature), targets, weights, scores."""
    def block(held: list[pa.RecordBatch]) -> bytes:
        rows = pa.Table.from_batches(held)
        keys = rows.column(0).to_numpy()
        bins, *rest = (
            np.frombuffer(b"".join(rows.column(i).to_pylist()), kind).reshape(len(keys), size)
            for i, kind, size in ((1, "u1", width), (2, "f8", boosts), (3, "f8", boosts), (4, "f8", total)))
        return pickle.dumps((keys, np.ascontiguousarray(bins.T), _distinct(rest[0]), _distinct(rest[1]), rest[2]), 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK_ROWS - n))
                n, batch = n + held[-1].num_rows, batch.slice(BLOCK_ROWS - n)
                if n == BLOCK_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], names=["block"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], names=["block"])

    return prepared.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def fit(rows: DataFrame, features: Sequence[str], key: Column, boosts: Sequence[Boost], bins: int = BINS,
        partitions: int | None = None) -> list[BoostedModel]:
    """The fitted model of each boost, all grown together.

    ``key`` is a bigint that names a row; row sampling depends on it and not on partitions. A boost
    without rows of positive weight predicts its start, 0 rows of any kind included.
    """
    spark = rows.sparkSession
    probabilities = [i / bins for i in range(1, bins)]
    doubles = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    cuts = doubles.approxQuantile(list(features), [0.5, *probabilities], 1e-4) if features else []
    medians = np.array([c[0] if c else 0.0 for c in cuts])
    edges = [np.unique(c[1:]) if c else np.empty(0) for c in cuts]
    outputs = [(b, k) for b, boost in enumerate(boosts) for k in range(boost.classes)]
    n, *means = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(boosts[b].weight * ((boosts[b].target == k).cast("double") if boosts[b].loss == "softmax"
                                                            else boosts[b].target.cast("double"))) / F.sum(boosts[b].weight), F.lit(0.0))
                       for b, k in outputs]).first()
    firsts = [outputs.index((b, 0)) for b in range(len(boosts))]
    starts = np.array([s for b, boost in enumerate(boosts) for s in _start(
        boost, [float(means[firsts[b] + k]) for k in range(boost.classes)])])
    cores = spark.sparkContext.defaultParallelism
    waves = -(-n // (TASK_ROWS * cores))
    parts = partitions or max(1, min(cores, -(-n // LEAST_ROWS)) * waves)
    prepared = _prepared(rows, features, key, boosts, medians, edges, starts).repartition(parts, "key")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    width, rules = len(features), [Rule(
        b.loss, b.power, b.min_rows, b.min_weight, b.row_share, b.ridge, b.classes, b.seed) for b in boosts]
    blocks = _blocks(prepared, width, len(boosts), len(starts)).persist()
    blocks.checkpoint()
    blocks.count()
    trees: list[list[list[Tree]]] = [[] for _ in boosts]
    late: list[tuple[int, Tree]] = []
    kept = 0
    try:
        for round_ in range(max((b.rounds for b in boosts), default=0)):
            active = [o for o, (b, _) in enumerate(outputs) if round_ < boosts[b].rounds]
            allowed = {o: _columns(boosts[outputs[o][0]], width, round_, outputs[o][1]) for o in active}
            grown: dict[int, tuple[list, list, list]] = {o: ([], [], []) for o in active}
            last: dict[int, np.ndarray] = {}
            before = blocks
            if len(late) >= LATE:
                blocks, late = _renewed(blocks, late).persist(), []
                if round_ - kept >= RENEW:
                    blocks.checkpoint()
                    kept = round_
            scored = _renewed(blocks, late) if late else blocks
            for level in range(max(boosts[outputs[o][0]].depth for o in active)):
                asked = [o for o in active if level < boosts[outputs[o][0]].depth]
                each = max(1, PASS_BYTES // (24 * 2 ** level * max(1, width) * bins))
                for first in range(0, len(asked), each):
                    found = _level(scored, parts, rules, outputs, {
                        o: (*grown[o][:2], allowed[o]) for o in asked[first:first + each]}, round_, bins)
                    for o, (root, feature, at, last[o]) in found.items():
                        if not level:
                            grown[o][2].append(root)
                        for held, one in zip(grown[o], (feature, at, last[o][2])):
                            held.append(one)
                    if before is not blocks:
                        before.unpersist()
                        before = blocks
            new = []
            for o in active:
                boost = boosts[outputs[o][0]]
                leaves = -boost.rate * last[o][0] / (last[o][1] + boost.ridge)
                new.append((o, Tree(*(tuple(g) for g in grown[o]), leaves)))
            for b in range(len(boosts)):
                own = [t for o, t in new if outputs[o][0] == b]
                if own:
                    trees[b].append(own)
            late = late + new
    finally:
        blocks.unpersist()
    return [BoostedModel(boost.loss, boost.power, tuple(features), medians, tuple(edges),
                         starts[firsts[b]:firsts[b] + boost.classes], tuple(tuple(t) for t in trees[b]))
            for b, boost in enumerate(boosts)]


def _columns(boost: Boost, width: int, round_: int, k: int) -> np.ndarray:
    """The features that a tree may use: a share drawn anew for each tree."""
    allowed = np.ones(width, bool)
    if boost.column_share < 1 and width:
        allowed[:] = False
        rng = np.random.default_rng([boost.seed, round_, k])
        allowed[rng.choice(width, max(1, round(width * boost.column_share)), replace=False)] = True
    return allowed


def _nodes(x: np.ndarray, features: Sequence[np.ndarray], bins: Sequence[np.ndarray]) -> np.ndarray:
    """As ``descend``, for bins by feature."""
    node = np.zeros(x.shape[1], np.int64)
    every = np.arange(x.shape[1])
    for level, (f, b) in enumerate(zip(features, bins)):
        if not level:
            node += (x[f[0]] > b[0]) if f[0] >= 0 else 0
        elif level <= NEAR:  # a comparison a node costs less than looking up each row's feature
            right = np.zeros(x.shape[1], bool)
            for i in np.flatnonzero(f >= 0):
                right |= (node == i) & (x[f[i]] > b[i])
            node = 2 * node + right
        else:
            at = f[node]
            node = 2 * node + ((at >= 0) & (x[at, every] > b[node]))
    return node


def _renewed(blocks, new: list[tuple[int, Tree]]):
    """The blocks with the scores of new trees added."""
    def add(block: tuple) -> tuple:
        raw = block[4].copy()
        for o, tree in new:
            raw[:, o] += tree.leaves[_nodes(block[1], tree.features, tree.bins)]
        return (*block[:4], raw)

    return blocks.map(add)


def _level(blocks, parts: int, rules: Sequence[Rule], outputs: list, grown: dict, round_: int,
           count: int) -> dict[int, tuple]:
    """Of every tree, the rows at its root and the splits of its last level, from the sums of gradients,
    curvatures and rows by (node, feature, bin) over all rows."""
    firsts = {b: o for o, (b, k) in enumerate(outputs) if k == 0}

    def sums(held: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for key, x, (ys, y_at), (ws, w_at), raw in held:
            drawn: dict = {}
            rooted: dict = {}  # rows by (feature, bin) at the root, the same for all trees of the same rows
            for o, (features, bins, allowed) in grown.items():
                b, k = outputs[o]
                rule = rules[b]
                rows = w_at[b], rule.row_share, rule.seed
                if rows not in drawn:
                    used = ws[w_at[b]] > 0
                    if rule.row_share < 1:
                        used = used & _drawn(key, round_, rule.seed, rule.row_share)
                    at = np.flatnonzero(used)
                    drawn[rows] = at, x[:, at], ws[w_at[b]][at]
                at, own, weight = drawn[rows]
                g, h = gradients(rule.loss, ys[y_at[b]][at], raw[at, firsts[b]:firsts[b] + rule.classes], k, rule.power)
                g, h = g * weight, h * weight
                first = _nodes(own, features, bins) * count
                nodes = 2 ** len(features)
                if o not in total:
                    total[o] = np.zeros((3, nodes, len(x), count))
                found = total[o]
                ones = rule.loss == "squared" and bool((weight == 1).all())  # curvatures are row counts
                # a feature at a time: its cells and the sums stay in the cache
                for j in np.flatnonzero(allowed):
                    cells = first + own[j]
                    held_rows = rooted.get((rows, j)) if not features else None
                    if held_rows is None:
                        held_rows = np.bincount(cells, None, nodes * count).reshape(nodes, count)
                        if not features:
                            rooted[rows, j] = held_rows
                    found[0, :, j] += np.bincount(cells, g, nodes * count).reshape(nodes, count)
                    found[1, :, j] += held_rows if ones else np.bincount(cells, h, nodes * count).reshape(nodes, count)
                    found[2, :, j] += held_rows
        yield from total.items()

    def chosen(o: int, found: np.ndarray) -> tuple:
        allowed = grown[o][2]
        return found[2, :, int(np.argmax(allowed))].sum(axis=1), *split(found, allowed, rules[outputs[o][0]])

    by_task = blocks.mapPartitions(sums)
    empty = {o: np.zeros((3, 2 ** len(features), len(allowed), count)) for o, (features, _, allowed) in grown.items()}
    if parts * sum(e.nbytes for e in empty.values()) <= DRIVER_BYTES:
        for o, found in by_task.collect():
            empty[o] += found
        return {o: chosen(o, found) for o, found in empty.items()}
    found = dict(by_task.reduceByKey(np.add, min(len(grown), parts)).map(lambda e: (e[0], chosen(*e))).collect())
    return {o: found[o] if o in found else chosen(o, e) for o, e in empty.items()}

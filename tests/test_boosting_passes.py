"""Blocks are kept once in some trees, which changes no tree; contributions against all orders of features."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark import RDD
from pyspark.sql import functions as F

from basketlake.operators import boosting


def test_blocks_are_kept_once_in_some_trees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, *map(float, rng.integers(0, 9, 3)), float(rng.integers(0, 50))) for i in range(600)],
                                 "k bigint, a double, b double, c double, y double").cache()
    kept, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *a: kept.append(1) or persist(self, *a))

    def fit(late):
        monkeypatch.setattr(boosting, "LATE", late)
        boosts = [boosting.Boost("tweedie", F.col("y"), rounds=9, depth=3, row_share=0.85),
                  boosting.Boost("squared", F.col("y"), rounds=4, depth=5)]
        return boosting.fit(rows, ["a", "b", "c"], F.col("k"), boosts, partitions=2)

    often = fit(1)
    n = len(kept)
    seldom = fit(4)
    assert n == 9 and len(kept) - n == 4  # after rounds 2 and 4 with two trees each, and 8 with one
    for one, two in zip(often, seldom):
        assert len(one.trees) == len(two.trees)
        for (x,), (y,) in zip(one.trees, two.trees):
            assert all(np.array_equal(p, q) for side in ("features", "bins", "covers") for p, q in zip(getattr(x, side), getattr(y, side)))
            assert np.allclose(x.leaves, y.leaves, atol=1e-12)


def test_contributions_are_means_over_all_orders_of_features():
    rng = np.random.default_rng(6)
    tree = boosting.Tree(tuple(np.array(f) for f in ([0], [1, 0], [2, -1, 1, 2])), tuple(rng.integers(2, 6, 2 ** i) for i in range(3)),
                         tuple(np.array(c, float) for c in ([40], [25, 15], [10, 15, 9, 6], [4, 6, 15, 0, 5, 4, 2, 4])), rng.normal(size=8))
    x = rng.integers(0, 8, (3, 50))
    out = np.zeros((3, 50))
    base = boosting._tree_contributions(tree, x, out)

    def value(row, known, level=0, node=0):
        if level == 3:
            return tree.leaves[node]
        f = tree.features[level][node]
        if f < 0 or f in known:
            return value(row, known, level + 1, 2 * node + int(f >= 0 and row[f] > tree.bins[level][node]))
        return sum(tree.covers[level + 1][2 * node + r] / tree.covers[level][node] * value(row, known, level + 1, 2 * node + r) for r in (0, 1))

    for i in range(50):
        orders = list(itertools.permutations(range(3)))
        want = [np.mean([value(x[:, i], o[:o.index(f) + 1]) - value(x[:, i], o[:o.index(f)]) for o in orders]) for f in range(3)]
        assert np.allclose(out[:, i], want) and np.isclose(base, value(x[:, i], ()))

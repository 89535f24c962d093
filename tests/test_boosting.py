"""Boosted trees against a plain loop over all rows, and additive contributions against all subsets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from basketlake.operators import boosting
from basketlake.operators.boosting import Boost

NAMES = ("a", "b", "c")


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    value = np.where(rng.random(n) < 0.4, 0.0, np.exp(x[:, 0] + (x[:, 1] > 0)))
    flag = (x[:, 0] + x[:, 2] + rng.normal(size=n) > 0).astype(int)
    kind = np.digitize(x[:, 1] + rng.normal(size=n) / 2, [-0.5, 0.5])
    rows = [(i, *map(float, x[i]), float(value[i]), int(flag[i]), int(kind[i])) for i in range(n)]
    rows[3] = (3, None, *rows[3][2:])
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, value double, flag int, kind int"), rows


def boosts():
    common = dict(rounds=10, depth=3, rate=0.2, min_rows=4)
    return [Boost("squared", F.col("value"), **common), Boost("logistic", F.col("flag"), weight=F.col("flag") + 1.0, **common),
            Boost("tweedie", F.col("value"), weight=F.when(F.col("id") % 5 != 0, 1.0), **common),
            # weights that differ leave no two splits with one gain
            Boost("softmax", F.col("kind"), weight=1 + F.col("id") / 1000, classes=3, **(common | {"rounds": 6, "depth": 2})),
            Boost("squared", F.col("value"), row_share=0.7, column_share=0.7, **common)]


def plain_fit(x, y, w, boost, starts, bins):
    """The same rule, one node at a time."""
    raw = np.tile(starts, (len(x), 1))
    for _ in range(boost.rounds):
        steps = []
        for k in range(boost.classes):
            g, h = boosting.gradients(boost.loss, y, raw, k, boost.power)
            g, h = g * w, h * w
            step = np.zeros(len(x))

            def grow(rows, depth):
                total, best = (g[rows].sum(), h[rows].sum()), (1e-9, None)
                if depth:
                    for f in range(x.shape[1]):
                        for b in range(bins - 1):
                            right = x[rows, f] > b
                            one, two = rows[~right], rows[right]
                            if min((w[one] > 0).sum(), (w[two] > 0).sum()) < boost.min_rows:
                                continue
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (one, two)) - total[0] ** 2 / (total[1] + 1)
                            if gain > best[0] + 1e-9:
                                best = gain, (one, two)
                if best[1]:
                    for s in best[1]:
                        grow(s, depth - 1)
                else:
                    step[rows] = -boost.rate * total[0] / (total[1] + 1)

            grow(np.arange(len(x)), boost.depth)
            steps.append(step)
        raw = raw + np.stack(steps, axis=1)
    return raw


@pytest.fixture(scope="module")
def fitted(spark):
    frame, rows = table(spark)
    return frame, rows, boosting.fit(frame, NAMES, F.col("id"), boosts(), bins=16, partitions=3)


def test_all_losses_equal_a_plain_loop(fitted):
    _, rows, models = fitted
    values = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    ids = np.array([r[0] for r in rows])
    for boost, model, y, w in zip(boosts(), models[:4], ([r[4] for r in rows], [r[5] for r in rows], [r[4] for r in rows], [r[6] for r in rows]),
                                  (np.ones(len(rows)), np.array([r[5] for r in rows]) + 1.0, (ids % 5 != 0) * 1.0, 1 + ids / 1000)):
        want = plain_fit(model.binned(values), np.array(y, float), w, boost, model.starts, 16)
        assert np.abs(model.raw_of(values) - want).max() < 1e-8, boost.loss


def test_training_deviance_falls_every_round(fitted):
    _, rows, models = fitted
    values = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    for model, column in zip(models[:4], (4, 5, 4, 6)):
        used = np.array([model.boost_loss != "tweedie" or r[0] % 5 != 0 for r in rows])
        y = np.array([r[column] for r in rows], float)[used]
        ids = np.array([r[0] for r in rows])[used]
        weight = {"logistic": 1.0 + y, "softmax": 1 + ids / 1000}.get(model.boost_loss, np.ones(len(y)))
        x, last = model.binned(values)[used], math.inf
        raw = np.tile(model.starts, (len(x), 1))
        for trees in model.trees:
            for k, tree in enumerate(trees):
                raw[:, k] += tree.leaves[boosting.descend(x, tree.features, tree.bins)]
            now = (weight * boosting.deviance(model.boost_loss, y, raw)).sum()
            assert now < last
            last = now


def test_shares_draw_rows_and_columns(fitted, spark):
    frame, rows, models = fitted
    model = models[4]
    used = {int(f) for trees in model.trees for t in trees for level in t.features for f in level if f >= 0}
    assert used == {0, 1, 2}
    assert all(len({int(f) for level in t.features for f in level if f >= 0}) <= 2 for trees in model.trees for t in trees)
    assert all(0.5 < t.covers[0][0] / len(rows) < 0.9 for trees in model.trees for t in trees)
    again = boosting.fit(frame.repartition(7), NAMES, F.col("id"), boosts()[4:], bins=16, partitions=2)[0]
    values = np.array([[r[1] or 0.0, r[2], r[3]] for r in rows])
    assert np.abs(again.raw_of(values) - model.raw_of(values)).max() < 1e-8


def test_scores_in_tables(fitted):
    frame, rows, models = fitted
    got = {r.id: r for r in frame.select("id", models[0].score().alias("s"), models[3].chances().alias("p"),
                                         models[1].score().alias("c"), models[2].score().alias("t")).collect()}
    assert len(got) == len(rows) and all(abs(sum(r.p) - 1) < 1e-9 and 0 < r.c < 1 and r.t > 0 for r in got.values())
    assert np.corrcoef([got[r[0]].s for r in rows], [r[4] for r in rows])[0, 1] > 0.6


def test_contributions_are_the_shapley_values_and_add_up(fitted):
    frame, rows, models = fitted
    model = models[2]
    values = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])[:12]
    found, base = model.contributions_of(values)
    assert np.abs(found.sum(axis=1) + base - model.raw_of(values)[:, 0]).max() < 1e-9

    def expected(tree, x, known, level=0, node=0):
        if level == len(tree.features):
            return tree.leaves[node]
        f = tree.features[level][node]
        if f < 0:
            return expected(tree, x, known, level + 1, 2 * node)
        if f in known:
            return expected(tree, x, known, level + 1, 2 * node + int(x[f] > tree.bins[level][node]))
        share = [tree.covers[level + 1][2 * node + s] / tree.covers[level][node] for s in (0, 1)]
        return sum(p * expected(tree, x, known, level + 1, 2 * node + s) for s, p in enumerate(share))

    x = model.binned(values)
    for i in range(len(x)):
        for f in range(3):
            others = [j for j in range(3) if j != f]
            want = 0.0
            for size in range(3):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / 6
                    want += weight * sum(expected(t[0], x[i], {*s, f}) - expected(t[0], x[i], set(s)) for t in model.trees)
            assert abs(found[i, f] - want) < 1e-9
    long = model.contributions(frame.where("id < 20"), ["id"]).groupBy("id").agg(
        (F.sum("contribution") + F.first("base") - F.first("raw_score")).alias("gap"), F.count(F.lit(1)).alias("n")).collect()
    assert len(long) == 20 and all(abs(r.gap) < 1e-9 and r.n == 3 for r in long)


def test_no_rows_and_constant_features(spark):
    frame, _ = table(spark, 40)
    empty = boosting.fit(frame.where("false"), NAMES, F.col("id"), [Boost("squared", F.col("value"), rounds=2)], bins=8)[0]
    assert empty.raw_of(np.zeros((2, 3))).tolist() == [[0.0], [0.0]]
    flat = boosting.fit(frame.withColumns({n: F.lit(1.0) for n in NAMES}), NAMES, F.col("id"),
                        [Boost("tweedie", F.col("value"), rounds=3)], bins=8)[0]
    assert len({*flat.raw_of(np.random.default_rng(0).normal(size=(5, 3)))[:, 0].tolist()}) == 1


def test_sums_too_large_for_the_driver_are_split_by_the_executors(fitted, spark, monkeypatch):
    frame, rows, models = fitted

    split = boosting.split

    def in_tasks(*asked):
        assert TaskContext.get() is not None, "the driver saw the sums"
        return split(*asked)

    monkeypatch.setattr(boosting, "split", in_tasks)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", -1, raising=False)
    monkeypatch.setattr(boosting, "PASS_BYTES", 20_000, raising=False)  # several passes a level
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)  # several blocks a task
    again = boosting.fit(frame, NAMES, F.col("id"), boosts(), bins=16, partitions=3)
    values = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    for one, two in zip(models, again):
        assert len(one.trees) == len(two.trees) and np.abs(one.raw_of(values) - two.raw_of(values)).max() < 1e-8
        assert all((a == b).all() for s, t in zip(one.trees, two.trees) for u, v in zip(s, t) for a, b in zip(u.covers, v.covers))

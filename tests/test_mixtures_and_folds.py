"""Diagonal mixtures against plain steps, and balanced folds against their bound."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlake.operators import evaluation, folds, mixtures


def clouds(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 1.0], [0.0, 7.0, -2.0]])
    x = centres[np.arange(n) % 3] + rng.normal(size=(n, 3)) * np.array([1.0, 0.5, 0.0])
    rows = [(f"C{i}", [float(v) for v in x[i]]) for i in range(n)]
    rows += rows[:5]  # repeated rows count twice
    return spark.createDataFrame(rows, "k string, x array<double>"), np.vstack([x, x[:5]])


def log_densities(x, m):
    return np.stack([math.log(w) - 0.5 * (np.log(2 * math.pi * v) + (x - c) ** 2 / v).sum(axis=1)
                     for w, c, v in zip(m.weights, m.means, m.variances)], axis=1)


@pytest.fixture(scope="module")
def fitted(spark):
    frame, x = clouds(spark)
    return frame, x, mixtures.fit(frame, F.col("x"), F.col("k"), (1, 3), starts=2, steps=30)


def test_likelihood_never_falls_and_is_that_of_the_parameters(fitted):
    frame, x, found = fitted
    assert set(found) == {(1, 0), (1, 1), (3, 0), (3, 1)}
    for m in found.values():
        assert all(b >= a - 1e-7 for a, b in zip(m.trace, m.trace[1:]))
        logs = log_densities(x, m)
        want = np.logaddexp.reduce(logs, axis=1).sum()
        assert m.log_likelihood == pytest.approx(want, rel=1e-9)
        assert m.variances.min() >= mixtures.FLOOR and m.weights.sum() == pytest.approx(1.0)
    one = found[1, 0]
    assert np.allclose(one.means[0], x.mean(axis=0)) and np.allclose(one.variances[0], np.maximum(x.var(axis=0), 1e-5))


def test_clouds_are_found_and_labelled(fitted):
    frame, x, found = fitted
    best = mixtures.best_of(found, 3)
    got = best.assigned(frame, F.col("x"), "c", "p", "l").collect()
    label = {}
    for r in got:
        label.setdefault(int(r.k[1:]) % 3, set()).add(r.c)
        assert sum(r.p) == pytest.approx(1.0) and r.p[r.c] == max(r.p)
    assert all(len(v) == 1 for v in label.values()) and len(set.union(*label.values())) == 3
    assert sum(r.l for r in got) == pytest.approx(best.log_likelihood)
    told = best.measured(frame, F.col("x")).first()
    assert (told.components, told.n, told.parameters) == (3, len(x), 2 * 3 * 3 + 2)
    assert told.bic == pytest.approx(20 * math.log(len(x)) - 2 * best.log_likelihood) == pytest.approx(best.bic(len(x)))


def test_one_step_equals_a_plain_step(spark):
    frame, x = clouds(spark, 60)
    zero, one = (mixtures.fit(frame, F.col("x"), F.col("k"), (2,), starts=1, steps=s)[2, 0] for s in (0, 1))
    logs = log_densities(x, zero)
    p = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
    means = p.T @ x / p.sum(axis=0)[:, None]
    variances = np.maximum(np.stack([(p[:, [c]] * (x - means[c]) ** 2).sum(axis=0) for c in range(2)]) / p.sum(axis=0)[:, None], 1e-5)
    assert np.allclose(one.weights, p.mean(axis=0)) and np.allclose(one.means, means) and np.allclose(one.variances, variances)


def test_equal_rows_and_no_rows(spark):
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 6, "k string, x array<double>")
    m = mixtures.fit(same, F.col("x"), F.col("k"), (2,), starts=1)[2, 0]
    assert math.isfinite(m.log_likelihood) and np.allclose(m.means, [[1.0, 2.0]] * 2)
    with pytest.raises(ValueError):
        mixtures.fit(same.where("false"), F.col("x"), F.col("k"), (2,))
    with pytest.raises(ValueError):
        mixtures.of_labels(same.where("false"), "k", ["k"])


def snapshots(spark, people, seed=5, hot=0):
    rng = np.random.default_rng(seed)
    rows = [(f"P{i}", int(min(9, max(0, rng.normal(i % 10, 1.5))))) for i in range(people) for _ in range(rng.integers(1, 7))]
    rows += [("HOT", i % 10) for i in range(hot)]
    return spark.createDataFrame([*rows, (None, 3)], "customer_id string, bin int")


@pytest.mark.parametrize("block", [40, 2000])
def test_bins_are_shared_evenly(spark, block):
    table = snapshots(spark, 400)
    dealt = folds.balanced_group_folds(table, "bin", 10, block=block)
    assert dealt.count() == table.count() - 1
    assert evaluation.fold_violations(dealt).first().crossing == 0
    told = folds.fold_balance(dealt, "bin").collect()
    assert len(told) == 10 and all(r.most - r.fewest <= 2 * r.largest_customer for r in told)
    plain = folds.fold_balance(evaluation.grouped_folds(table.where("customer_id IS NOT NULL"), "bin"), "bin").collect()
    assert sum((r.most - r.fewest) for r in told) < sum((r.most - r.fewest) for r in plain)
    again = folds.balanced_group_folds(table.repartition(5), "bin", 10, block=block)
    assert {(r.customer_id, r.fold) for r in again.collect()} == {(r.customer_id, r.fold) for r in dealt.collect()}


def test_a_customer_of_a_third_of_all_rows_and_empty_tables(spark):
    table = snapshots(spark, 100, hot=150).withColumn("place", F.lit("x")).withColumn("part", F.lit(1))
    dealt = folds.balanced_group_folds(table, "bin", 10)
    assert evaluation.fold_violations(dealt).first().crossing == 0 and set(dealt.columns) == {*table.columns, "fold"}
    rest = dealt.where("customer_id <> 'HOT'").groupBy("fold").count().collect()
    assert len(rest) == 5 or min(r["count"] for r in rest) > 0
    assert folds.balanced_group_folds(table.where("false"), "bin", 10).count() == 0
    odd = spark.createDataFrame([("a", None), ("a", 99), ("b", 0)], "customer_id string, bin int")
    assert folds.balanced_group_folds(odd, "bin", 10, 2).select("fold").distinct().count() == 2

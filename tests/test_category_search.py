"""The search over boosted next-category candidates, and segments found with diagonal mixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlake.operators import evaluation, mixtures, models, segments

NAMES = ["a", "b"]
# the first one has too few rows for any split
QUICK = ({"rounds": 1, "leaves": 2, "rate": 0.01, "min_rows": 200}, {"rounds": 8, "leaves": 4, "rate": 0.3, "min_rows": 5})


def customers(spark, n=240):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    kind = np.where(x[:, 0] > 0.8, 7, np.where(x[:, 1] > 0, 2, 11))
    rows = [(f"C{i}", None if i == 5 else float(x[i, 0]), float(x[i, 1]), None if i == 9 else int(kind[i]), "train") for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, a double, b double, next_category_id int, partition string")


@pytest.fixture(scope="module")
def searched(spark):
    table = customers(spark)
    return table, *models.search_next_category(table, NAMES, QUICK, folds=3)


def test_the_winner_has_the_best_mean_macro_f1(searched):
    table, model, report = searched
    rows = report.collect()
    assert [(r.candidate, r.fold) for r in rows] == [(c, f) for c in (0, 1) for f in range(3)]
    assert sum(r.n_rows for r in rows) == 2 * 239
    mean = [np.mean([r.macro_f1 for r in rows if r.candidate == c]) for c in (0, 1)]
    assert mean[1] > mean[0] and all(r.selected == (r.candidate == 1) for r in rows)
    assert model.labels == (2, 7, 11) and len(model.model.trees) == 8


def test_scores_have_the_forest_columns_and_find_classes(searched, spark):
    table, model, _ = searched
    known = table.where("next_category_id IS NOT NULL")
    rows = models.score_next_category(model, known, NAMES).collect()
    assert set(rows[0].asDict()) == {*table.columns, "class_index", "class_probabilities", "predicted_category", "next_category_probability"}
    assert all(abs(sum(r.class_probabilities) - 1) < 1e-9 for r in rows)
    assert np.mean([int(r.predicted_category) == r.next_category_id for r in rows]) > 0.9
    assert all(model.labels[int(r.class_index)] == r.next_category_id for r in rows)
    assert models.score_next_category(model, table, NAMES, labelled=False).count() == 240
    with pytest.raises(Exception, match="not seen in training"):
        models.score_next_category(model, table.withColumn("next_category_id", F.lit(99)), NAMES).collect()
    with pytest.raises(ValueError):
        models.search_next_category(table.where("false"), NAMES, QUICK)


def test_macro_f1_against_a_plain_count(spark):
    pairs = [(0, 0, 1), (0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 0, 1), (0, 0, 2), (3, 4, 2)]
    got = {r.g: r for r in evaluation.macro_f1(spark.createDataFrame(pairs, "y int, z int, g int"), "y", "z", ["g"]).collect()}
    for g, r in got.items():
        own = [(y, z) for y, z, k in pairs if k == g]
        f1 = []
        for c in {v for p in own for v in p}:
            tp, both = sum(p == (c, c) for p in own), sum(p[0] == c for p in own) + sum(p[1] == c for p in own)
            f1.append(2 * tp / both)
        assert r.n_rows == len(own) and r.macro_f1 == pytest.approx(np.mean(f1))
        assert r.accuracy == pytest.approx(np.mean([y == z for y, z in own]))


def test_segments_are_chosen_among_diagonal_mixtures(spark):
    table = customers(spark)
    prepared, picked, report = segments.search(table, NAMES, kmeans=(3,), mixtures=(2, 3), kmeans_starts=1, mixture_starts=2)
    assert isinstance(picked["gmm"], mixtures.DiagonalMixture)
    rows = [r for r in report.collect() if r.algorithm == "gmm"]
    assert [r.components for r in rows if r.selected] == [min(rows, key=lambda r: r.bic).components]
    out = segments.assign(table, NAMES, prepared, picked).collect()
    assert len(out) == 240 and {r.gmm_segment for r in out} <= set(range(3)) and all(r.kmeans_segment is not None for r in out)

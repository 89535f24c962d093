"""Hard negatives against all pairs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlake.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, part string"


def rows_of(n: int, dims: int, seed: int, copies: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.2, 0.8])) / math.sqrt(dims)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4)), "r", "p"))
    hot = rows[5][1]
    rows += [(n + i, hot, i % 3, "r", "p") for i in range(copies)]
    return rows


def plain(rows, scale=256, most=5):
    good = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(scale * x) for x in v]))
    out = Counter()
    for i, (anchor, label, v) in enumerate(good):
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), other, own) for j, (other, own, w) in enumerate(good)
                  if j != i and len(w) == len(v)]
        positives = sorted((s, other) for s, other, own in scored if own == label)[:most]
        for s, positive in positives:
            fits = sorted((t, other) for t, other, own in scored
                          if own != label and 80 * -s <= 100 * -t <= 100 * -s)[:most]
            out.update((anchor, positive, r, other, -s, -t) for r, (t, other) in enumerate(fits, 1))
    return out


def result(spark, rows, tmp_path, small: bool, monkeypatch):
    if small:
        for name, value in (("ROWS", 60), ("ANCHORS", 3), ("ROW_BLOCK", 17), ("ANCHOR_BLOCK", 2)):
            monkeypatch.setattr(negatives, name, value)
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, path).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("dims", [1, 3, 64])
def test_all_pairs_give_the_same(spark, tmp_path, monkeypatch, dims, small):
    rows = rows_of(700, dims, dims, copies=150)
    got = result(spark, rows, tmp_path, small, monkeypatch)
    assert got == plain(rows) and (dims == 1 or len(got) > 20)


def test_awkward_rows(spark, tmp_path, monkeypatch):
    rows = rows_of(210, 5, 9)
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1, "r", "p"), (400, [nan] * 5, 1, "r", "p"), (500, [inf, 0.0, 0.0, 0.0, 0.0], 1, "r", "p"),
             (600, [0.1] * 5, None, "r", "p"), (None, [0.1] * 5, 1, "r", "p"), (700, [0.1, None, 0.1, 0.1, 0.1], 1, "r", "p"),
             (800, [], 1, "r", "p"), (801, [], 1, "r", "p"), (802, [], 2, "r", "p"), (900, [0.5, 0.5], 1, "r", "p"),
             (901, [0.5, 0.5], 1, "r", "p"), (902, [0.5, 0.5], 2, "r", "p"), (1000, [0.0] * 5, 1, "r", "p"),
             *[(100, [0.2] * 5, 3, "r", "p")] * 3, *[(-100, [-0.3] * 5, 2, "r", "p")] * 2]
    assert result(spark, rows, tmp_path / "t", False, monkeypatch) == plain(rows)
    assert not result(spark, [], tmp_path / "e", False, monkeypatch)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 29, 2 ** 29, 4)], i % 2) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.hard_negatives(vectors, F.col("label"), F.col("vec_id") % 10 == 0, scale=1).collect()
    assert got
    ints = {i: [int(x) for x in v] for i, v, _ in rows}
    for r in got:
        assert r.positive_score == sum(a * b for a, b in zip(ints[r.anchor_id], ints[r.positive_id]))
        assert r.negative_score == sum(a * b for a, b in zip(ints[r.anchor_id], ints[r.negative_id]))


def test_threshold_join_keeps_every_pair_over_its_threshold():
    rng = np.random.default_rng(6)
    for trial in range(30):
        dims = int(rng.integers(1, 40))
        scale = rng.exponential(size=dims) ** 2 * 300
        x, y = (np.floor(rng.normal(size=(n, dims)) * scale) for n in (90, 20))
        order, edges = negatives._slabs(x)
        rows, anchors = negatives.Block(x, order, edges), negatives.Block(y, order, edges)
        scores = x @ y.T
        low = np.quantile(scores, rng.choice([0.1, 0.6, 0.95, 0.999]), axis=0)
        r, c, s = negatives.threshold_join(rows, anchors, edges, low)
        want = {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= low))}
        assert len(r) == len(want) and set(zip(r.tolist(), c.tolist(), s.tolist())) == want

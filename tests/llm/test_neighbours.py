"""Near vectors against all pairs: recall, precision, counts, components, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from basketlake.llm import neighbours, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def table(spark, path, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash")
                                   for i, v in rows], SCHEMA)
    frame.repartition(4).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return str(path)


def plain(rows, threshold=0.9):
    """{id: (links, component)} by all pairs in double precision."""
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.linalg.norm(good[a]), good[b] / np.linalg.norm(good[b])
                if x @ y >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    label = {}
    for start in sorted(links):
        todo = [start] if start not in label else []
        while todo:
            node = todo.pop()
            if node not in label:
                label[node] = start
                todo += links[node]
    return {i: (len(links[i]), label[i]) for i in links}, sum(map(len, links.values())) // 2


def clustered(n, dimensions, seed, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 3, dimensions))
    vectors = [centres[rng.integers(len(centres))] + noise * rng.normal(size=dimensions) for _ in range(n)]
    return list(enumerate(v.tolist() for v in vectors))


def test_given_table_is_found_whole(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, _ = plain(rows)
    got = {r.vec_id: r for r in queries.op3_embedding_near_dedup(spark, folder).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("dimensions,noise", [(64, 0.25), (24, 0.3), (96, 0.32)])
def test_recall_at_the_threshold(spark, tmp_path, dimensions, noise):
    rows = clustered(700, dimensions, 3, noise)
    want, total = plain(rows)
    got = queries.op3_embedding_near_dedup(spark, table(spark, tmp_path, rows)).collect()
    assert total > 100
    assert all(r.n_links <= want[r.vec_id][0] for r in got)  # no pair below the threshold
    assert sum(r.n_links for r in got) / 2 >= 0.9 * total


def test_odd_and_equal_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, None), (1, []), (2, [0.0] * 4), (3, [1.0, nan, 0, 0]), (4, [inf, 1, 1, 1]), (5, [None, 1.0, 1, 1]),
            (6, base), (7, base), (8, [2 * x for x in base]), (9, [-x for x in base]), (10, base + [1.0]),
            (11, base + [1.0]), (12, [1e30, 2e30, 3e30, 4e30]), (13, [-0.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op3_embedding_near_dedup(spark, table(spark, tmp_path, rows)).collect()}
    assert got == {i: (0, i) for i in (0, 1, 2, 3, 4, 5, 9, 13)} | {6: (3, 6), 7: (3, 6), 8: (3, 6), 12: (3, 6), 10: (1, 10), 11: (1, 10)}


def test_tiles_give_the_same_pairs_once(spark):
    rows = clustered(300, 16, 9, 0.1)
    frame = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], 16) for i, v in rows],
                                  "class_id bigint, vector array<float>, dimensions int")
    whole = sorted((r.a, r.b) for r in neighbours.linked_pairs(frame, 0.9).collect())
    tiles = sorted((r.a, r.b) for r in neighbours.linked_pairs(frame, 0.9, tile=9).collect())
    assert len(whole) > 100 and len(set(whole)) == len(whole) and tiles == whole


def test_edge_tables(spark, tmp_path):
    assert queries.op3_embedding_near_dedup(spark, table(spark, tmp_path / "e", [])).count() == 0
    rows = queries.op3_embedding_near_dedup(spark, table(spark, tmp_path / "t", [(None, [1.0]), (3, [2.0]), (3, [2.0])])).collect()
    assert [(r.n_links, r.component_id) for r in rows] == [(2, 3)] * 3
    assert sorted(r.kept for r in rows) == [False, True, True]

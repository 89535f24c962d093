"""Fingerprints against sets of paragraphs, and the order of documents."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from basketlake.llm import fingerprints, queries
from tests.llm.helpers import alike, awkward_texts, documents, stored


def prose(n, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choices(["Alpha", "Beta", "Éa", "é", "gamma", "漢字"], k=rng.randint(3, 9))) + rng.choice(". ! \n".split(" "))
    return ["".join(line() + rng.choice([" ", "\n"]) for _ in range(rng.choice([1, 3, 10, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("per_bucket", [7, 100_000])
def test_documents_against_sets(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (per_bucket,))
    texts = awkward_texts() + prose(40, 8)
    ids = [3 * i + (i % 5) for i in range(len(texts))]
    assert len(set(ids)) == len(ids)
    rows = queries.op4_document_fingerprints(spark, stored(documents(spark, texts, ids), tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    by_id = dict(zip(ids, (t or "" for t in texts)))
    order = sorted(by_id, reverse=True)
    prints = {}
    for i, following in zip(order, order[1:] + order[:1]):
        text, then, r = by_id[i], by_id[following], got[i]
        third = len(text) // 3
        edited = text[:len(text) - third] + then[:third]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(text, edited)) and r.near_next == pytest.approx(alike(text, then))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert (edited == text) <= (r.edited_fingerprint == r.fingerprint)


def test_every_size_of_sketch_recovers_the_difference(spark):
    rng = random.Random(1)
    rows = []
    for common, left, right in [(0, 0, 0), (50, 0, 0), (5, 3, 2), (100, 12, 9), (0, 60, 70), (30, 400, 1), (2000, 900, 1100)]:
        keys = [rng.getrandbits(64) - 2 ** 63 for _ in range(common + left + right)]
        rows.append((keys[:common + left], keys[:common] + keys[common + left:], left, right))
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, l int, r int")
    a, b = F.col("a"), F.col("b")
    out = frame.select("l", "r", fingerprints.recovered(a, fingerprints.cells(a), b, fingerprints.cells(b)).alias("x"),
                       fingerprints._blockwise(a, b, F.lit(11), F.lit(0), lambda x, y: fingerprints._result(
                           F.lit(False), F.lit(0), F.lit(0))).alias("y")).collect()
    assert all((x.x.left, x.x.right) == (x.l, x.r) and x.x.done for x in out)
    assert all((x.y.left, x.y.right) == (x.l, x.r) for x in out if x.y.done)
    assert sum(x.y.done for x in out) >= 6


def test_small_differences_peel_from_the_base_sketch(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        keys = [rng.getrandbits(64) - 2 ** 63 for _ in range(40)]
        rows.append((keys[:39], keys[1:]))
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    out = frame.select(fingerprints.peel(fingerprints.subtract(
        fingerprints.cells(F.col("a")), fingerprints.cells(F.col("b")))).alias("x")).collect()
    assert sum(r.x.done for r in out) > 190
    assert all((r.x.left, r.x.right) == (1, 1) for r in out if r.x.done)


def test_edge_tables(spark, tmp_path):
    assert queries.op4_document_fingerprints(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0
    one = queries.op4_document_fingerprints(spark, stored(documents(spark, ["a.\nb."], [4]), tmp_path / "o")).first()
    assert one.near_next == 1.0 and one.n_chars == 5
    rows = queries.op4_document_fingerprints(spark, stored(documents(spark, ["a", "a", None], [None, 7, 7]), tmp_path / "t")).collect()
    assert len(rows) == 3

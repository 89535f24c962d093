"""Quality classifier: held-out accuracy, gradients, and rows that must come through."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basketlake.llm import quality, queries
from tests.llm.helpers import awkward_texts, documents, stored


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeinrstlo", k=rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(20, 90))
        good = rng.random() < 0.75
        if not good:
            body = [w + "$$$" for w in body] if i % 2 else [w.upper() + "!!" for w in body]
        texts.append(" ".join(body))
        labels.append(int(good))
    return texts, labels


def folder_with(spark, path, texts, labels):
    stored(documents(spark, texts), path)
    rows = [(i, q, 0) for i, q in enumerate(labels)] + [(None, 1, 0), (3, None, 0), (10 ** 9, 1, 0)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_held_out_documents(spark, tmp_path):
    texts, labels = corpus(600, 4)
    extra = awkward_texts()
    rows = queries.op6_quality_classifier(spark, folder_with(spark, tmp_path, texts + extra, labels)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts) + len(extra)))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < len(texts)]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert len(held) > 60 and right / len(held) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    texts, labels = corpus(200, 5)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    a = queries.op6_quality_classifier(spark, folder_with(spark, tmp_path / "a", texts, labels)).collect()
    flipped = [1 - q if h else q for q, h in zip(labels, held)]
    b = queries.op6_quality_classifier(spark, folder_with(spark, tmp_path / "b", texts, flipped)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_score_is_the_softmax_of_the_mean_vector():
    settings = quality.Training(per_class=50, buckets=1 << 10)
    features = quality.Features(settings)
    texts, labels = corpus(80, 6)
    examples = [quality.example(features.of_text(t.encode()), q) for t, q in zip(texts, labels)]
    values, bias = quality.fit(examples, settings)
    got = quality.text_scores(pa.array(texts), features, values, bias, {})
    for text, score in zip(texts, got):
        mean = values[features.of_text(text.encode())].astype(float).mean()
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + bias))), rel=1e-4)
    assert np.mean([(s >= 0.5) == q for s, q in zip(got, labels)]) > 0.95


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1]])
def test_missing_classes(spark, tmp_path, labels):
    rows = queries.op6_quality_classifier(spark, folder_with(spark, tmp_path, ["a b", None, "c", "d"], labels)).collect()
    # without both classes every text falls to the class there is; rows of unknown ids add class 1
    assert len(rows) == 4 and {r.predicted for r in rows} <= {0, 1}


def test_empty_tables(spark, tmp_path):
    assert queries.op6_quality_classifier(spark, folder_with(spark, tmp_path, [], [])).count() == 0


def test_scores_of_any_characters(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    monkeypatch.setattr(quality, "MEMO", 30)  # emptied between blocks
    settings = quality.Training(buckets=1 << 10)
    rng = random.Random(8)
    letters = "aZ9<>éßЖ中\U0001f600\u0000"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(50)] + \
        [None, "", " \n", "中", "a", "a a a a a a", "x" * 30_000] + [t for t in awkward_texts() if t]
    values = np.random.default_rng(3).normal(size=settings.buckets).astype(np.float32)
    got = quality.text_scores(pa.array(texts), quality.Features(settings), values, 0.25, {})
    for text, score in zip(texts, got, strict=True):
        at = quality.Features(settings).of_text((text or "").encode())
        mean = values[at].astype(float).mean() if len(at) else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(mean + 0.25))), rel=1e-6)

"""Scores against a plain n-gram model, and the automaton's probabilities against one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketlake.llm import lm, queries
from tests.llm.helpers import awkward_texts, documents, stored


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["</s>"]


def plain_scores(texts, held, order, prior):
    counts = [Counter() for _ in range(order + 1)]
    for text, out in zip(texts, held):
        if not out:
            seq = ["<s>", *tokens(text)]
            for k in range(1, order + 1):
                counts[k].update(tuple(seq[i:i + k]) for i in range(len(seq) - k + 1))
    words = {g: c for g, c in counts[1].items() if g != ("<s>",)}
    n, v = sum(words.values()), len(words)

    def p(history, word):
        if not history:
            return (words.get((word,), 0) + 0.1) / (n + 0.1 * (v + 1))
        h = counts[len(history)][history]
        return (counts[len(history) + 1][(*history, word)] + prior * p(history[1:], word)) / (h + prior)

    out = []
    for text in texts:
        seq = ["<s>", *tokens(text)]
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1):i]), seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10(p((), w)) for w in seq[1:])
        out.append((len(seq) - 1, sum((w,) in words for w in seq[1:]), n, base, score))
    return out


def test_documents_against_the_plain_model(spark, tmp_path):
    texts = awkward_texts() + ["Éa THE the", "the THE"]
    rows = queries.op1_lm_scoring(spark, stored(documents(spark, texts), tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    for i, want in enumerate(plain_scores(texts, held, 2, 20.0)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], *want[:3])
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_any_order(spark, order):
    texts = ["a b c a b d", "a b c", "c a b c d", None, "z z z", "b c a"]
    docs = documents(spark, texts)
    rows = lm.score_documents(docs, F.col("doc_id") == 2, order=order, prior=3.0).collect()
    want = plain_scores(texts, [i == 2 for i in range(6)], order, 3.0)
    assert len(rows) == 6
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_copies_of_training_texts_score_higher_than_words_alone(spark, tmp_path):
    rows = queries.op1_lm_scoring(spark, stored(documents(spark), tmp_path)).collect()
    copies = [r for r in rows if 67 <= r.doc_id < 92]
    assert all(r.score > r.base_score for r in copies)


def test_edge_tables(spark, tmp_path):
    assert queries.op1_lm_scoring(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0
    rows = queries.op1_lm_scoring(spark, stored(documents(spark, ["a", "a", None], [None, 7, 7]), tmp_path / "t")).collect()
    assert len(rows) == 3
    alone = lm.score_documents(documents(spark, ["a b"]), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.score == pytest.approx(0.0, abs=1e-9)

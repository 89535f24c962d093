"""Paragraphs of texts without line or sentence ends, against the same rule in Python."""

from __future__ import annotations

import random

import pytest

from basketlake.llm import queries
from tests.llm.helpers import alike, awkward_texts, documents, stored
from tests.llm.test_fingerprints import prose


def one_line_texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinrstéß", k=rng.randint(1, 9))) for _ in range(2000)]
    plain = [" ".join(rng.choices(words, k=k)) for k in (60, 150, 400, 3000)]
    unspaced = ["".join(rng.choices("漢字仮名交文日本語😀", k=k)) for k in (300, 2000)]
    return [*plain, *unspaced, "spam " * 100, "Ñíue " * 2000, "x" * 5000,
            "! ".join(plain[0].split(" ")), "? ".join(plain[1].split(" "))]


@pytest.mark.parametrize("texts", [one_line_texts(), awkward_texts() + prose(40, 8)], ids=["one_line", "all"])
def test_long_paragraphs_are_cut_by_content(spark, tmp_path, texts):
    rows = queries.op4_document_fingerprints(spark, stored(documents(spark, texts), tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text, then = text or "", texts[i - 1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + then[:third]
        assert got[i].near_edited == pytest.approx(alike(text, edited))
        assert got[i].near_next == pytest.approx(alike(text, then))
        if len(text.split()) >= 50 or len(text) >= 300:
            assert got[i].near_edited > 0

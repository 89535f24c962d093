"""Stages over documents with columns named like the helpers' own."""

from __future__ import annotations

from basketlake.llm import repeats, simhash
from pyspark.sql import functions as F
from tests.llm.helpers import documents


def test_columns_of_any_name_stay_as_they_are(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [words, words, None, "other text here now", "x " + words]).withColumns({
        "chunk": F.col("doc_id").cast("int") + 100, "fp": F.concat(F.lit("fp"), "doc_id"), "part": F.lit(True),
        "quality_classifier_score": F.lit("q"), "carried": F.col("doc_id") * 2, "a b": F.lit(1.5)})
    own = {r.doc_id: r.asDict() for r in docs.collect()}
    for stage, kept in ((repeats.without_repeats, {0, 1, 2, 3, 4}), (simhash.one_of_each, None)):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = {r.doc_id: r.asDict() for r in out.collect()}
        assert kept is None or set(rows) == kept
        assert all({**r, "text": 0} == {**own[i], "text": 0} for i, r in rows.items())
        if kept is None:
            assert 0 in rows and 1 not in rows and 3 in rows
        else:
            assert rows[0]["text"] == words and rows[1]["text"] == "" and rows[4]["text"] == "x"

"""Documents of one id, or without one, in buckets of bounded size and in order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketlake.llm import fingerprints


@pytest.mark.parametrize("ids", [[None], [5], [None, -2 ** 63], [None, 5, *range(10)]], ids=str)
def test_repeated_ids_fill_several_buckets(spark, ids):
    rows = spark.createDataFrame([(ids[i % 2] if len(ids) > 1 and i % 3 else ids[i % len(ids)], f"text {i}.")
                                  for i in range(2000)], "doc_id bigint, text string").repartition(4)
    dealt = fingerprints.in_buckets(rows, 50).select("doc_id", "tie", "bucket", "text").collect()
    held: dict = {}
    for r in dealt:
        held[r.bucket] = held.get(r.bucket, 0) + 1
    assert max(held.values()) <= 200
    order = sorted(dealt, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert [r.bucket for r in order] == sorted(r.bucket for r in dealt)
    after = {r.text: r.after_text for r in fingerprints.with_next(rows, 50).select("text", "after_text").collect()}
    assert after == {a.text: b.text for a, b in zip(order, order[1:] + order[:1])}

"""One-cell blocks settle most digests of unlike sets, and all that both sets have."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from basketlake.llm import fingerprints


def test_few_digests_go_on_to_larger_sketches(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - 2 ** 63 for _ in range(3000)]
    frame = spark.createDataFrame([(keys[:1000], keys[1000:2000]), (keys[:2000], keys[500:2000][::-1])],
                                  "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    sent = lambda x, y: fingerprints._result(F.lit(False), F.size(x) * 10_000, F.size(y) * 10_000)
    apart, alike = frame.select(fingerprints._lone(a, b, F.lit(12), F.lit(0), sent).alias("x"),
                                fingerprints.recovered(a, fingerprints.cells(a), b, fingerprints.cells(b)).alias("y")).collect()
    assert apart.x.left // 10_000 + apart.x.right // 10_000 < 1000  # of 2000
    assert apart.x.left % 10_000 + apart.x.left // 10_000 == 1000
    assert alike.x.left // 10_000 < 300 and alike.x.left % 10_000 > 400
    assert (apart.y.left, apart.y.right, alike.y.left, alike.y.right) == (1000, 1000, 500, 0)

"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from basketlake.llm import queries, simhash
from tests.llm.helpers import awkward_texts, documents, stored


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=4):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


def test_documents_against_all_pairs(spark, tmp_path):
    texts = awkward_texts()
    got = {r.doc_id: r for r in queries.op9_simhash_near_dedup(spark, stored(documents(spark, texts), tmp_path)).collect()}
    values = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{v:016x}" for v in values]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(values)


def test_links_join_exactly_what_all_pairs_join(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        v = rng.choice(values)
        for _ in range(rng.randint(1, 6)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    for tile in (2048, 7):
        edges = {(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash.links(frame, 4, tile).collect()}
        at = {v: i for i, v in enumerate(values)}
        a = np.array([at[x] for x, _ in edges] + list(range(len(values))))
        b = np.array([at[y] for _, y in edges] + list(range(len(values))))
        moved, root = simhash.forest(a, b)
        label = list(range(len(values)))
        for m, r in zip(moved, root):
            label[m] = int(r)
        assert label == plain_components(values)


def test_count_vectors_bound_the_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        gap = sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))
        assert gap <= (a ^ b).bit_count()
    assert np.bitwise_or.reduce(np.array(simhash.block_masks(4), np.uint64)) == np.uint64(2 ** 64 - 1)


def test_edge_rows(spark, tmp_path):
    assert queries.op9_simhash_near_dedup(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0
    rows = queries.op9_simhash_near_dedup(spark, stored(documents(spark, ["a b", "a b", None], [None, 5, None]), tmp_path / "t")).collect()
    assert len(rows) == 3 and {r.component_id for r in rows if r.fingerprint != "0" * 16} == {5}
    assert [r.component_id for r in rows if r.fingerprint == "0" * 16] == [None]

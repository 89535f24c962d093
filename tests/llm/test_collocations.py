"""Collocations against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from basketlake.llm import collocations, queries
from tests.llm.helpers import awkward_texts, documents, stored


def plain(rows, least=30, most_words=4, top=2000, share=80, scale=2_000_000):
    """The contract by dictionaries of whole phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    longer = Counter()
    for (lang, words), c in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longer[lang, words[i:i + k]] = max(longer[lang, words[i:i + k]], c)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= share * a:
            continue
        score, k = min((scale * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i, phrase.decode(), -a, left, right, n[lang], -score)
                  for lang, found in out.items()
                  for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1))


def rows_of(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def many(seed: int, count: int):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "漢", "x\x1cy", "\xa0", "a-b", "not", "a"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "; ", "\r", "!", "\x0b"]
    fixed = ["New York City", "not a the of", "of the of the of the"]
    out = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts += [rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed), rng.choices(marks, [12, 1, 1, 2, 1, 1, 1, 1, 1, 1])[0]]
        out.append((rng.choice(["en", "en", "en", "de", None, ""]), "".join(parts)))
    return out


def frame(spark, rows):
    full = [(i, t, lang, 1, "x", "y") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, chunk int, codes string, f string").repartition(5)


@pytest.mark.parametrize("chunk_bytes", [500, 12_000_000])
@pytest.mark.parametrize("least, words, top", [(30, 4, 2000), (3, 5, 25), (7, 2, 3)])
def test_phrases_equal_plain_counting(spark, chunk_bytes, least, words, top):
    rows = many(3, 250) + [(None, None), ("en", ""), ("only", "...")]
    got = rows_of(collocations.collocations(frame(spark, rows), least, words, top, chunk_bytes=chunk_bytes))
    assert got and got == plain(rows, least, words, top)


def test_query_reads_the_whole_table(spark, tmp_path):
    texts = awkward_texts()
    got = rows_of(queries.op12_phrase_collocations(spark, stored(documents(spark, texts), tmp_path / "t")))
    assert got == plain([("en", t) for t in texts])
    assert queries.op12_phrase_collocations(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0


def test_dense_and_sparse_tiles_agree():
    rng = np.random.default_rng(2)
    x, y = (np.minimum(rng.zipf(1.3, 5000) - 1, 3000).astype(np.int32) for _ in range(2))
    want = Counter(zip(x.tolist(), y.tolist()))
    for dense in (1, 40, 1 << 30):
        a, b, counts, place = collocations.count_pairs(x, y, 4, dense)
        assert Counter({(i, j): c for i, j, c in zip(a.tolist(), b.tolist(), counts.tolist())}) == want
        assert (a[place] == x).all() and (b[place] == y).all()


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("en", "p q " * 40)]
    got = rows_of(collocations.collocations(frame(spark, rows), 30, 2, scale=900_000_000_000_000_000))
    assert got == plain(rows, 30, 2, scale=900_000_000_000_000_000)

"""Substring dedup against all windows in one dictionary."""

from __future__ import annotations

import hashlib
import random
import re

from basketlake.llm import queries, repeats
from tests.llm.helpers import awkward_texts, documents, stored


def plain(rows, window=20):
    """(words, removed, kept) of each (id, text), with the earliest start of every window."""
    first, out = {}, []
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), " ".join(kept)))
    return out


def hard_texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=rng.randint(15, 200))) for _ in range(25)]
    out = list(base)
    for _ in range(60):  # pieces of others, around and below the window, at any place
        a, b = rng.choice(base).split(), rng.choice(base).split()
        i, n = rng.randrange(len(a)), rng.randint(15, 60)
        out.append(" ".join(b[:rng.randrange(len(b))] + a[i:i + n] + rng.choices(words, k=rng.randint(0, 20))))
    out += ["x " * 50, "x y " * 40, "x y z q " * 30 + "end", "x " * 20, "x " * 19]
    return out


def test_documents_against_all_windows(spark, tmp_path, monkeypatch):
    texts = awkward_texts() + hard_texts()
    got = {r.doc_id: r for r in queries.op7_substring_dedup(spark, stored(documents(spark, texts), tmp_path)).collect()}
    for i, (n, gone, kept) in enumerate(plain(list(enumerate(texts)))):
        assert (got[i].n_words, got[i].n_removed) == (n, gone), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_many_chunks_and_short_windows(spark, monkeypatch):
    from basketlake.llm import chunks
    texts = hard_texts()
    for window in (20, 5):
        docs = documents(spark, texts, [7 * i % len(texts) for i in range(len(texts))]).select("doc_id", "text")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        monkeypatch.setattr(chunks.chunked, "__defaults__", (1500,))
        got = {r.doc_id: r for r in repeats.repeated_words(docs, window).collect()}
        for (i, _), (n, gone, _) in zip(rows, plain(rows, window)):
            assert (got[i].n_words, got[i].n_removed) == (n, gone)


def test_rows_and_columns_stay(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = documents(spark, [text, "new " + text + " words", None, "  two  spaces "])
    out = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert [out[i].text for i in range(4)] == [text, "new words", None, "  two  spaces "]
    assert out[1].shard == "clash" and set(out[1].asDict()) == set(docs.columns)


def test_edge_rows(spark, tmp_path):
    assert queries.op7_substring_dedup(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0
    text = " ".join(f"a{i}" for i in range(25))
    rows = queries.op7_substring_dedup(spark, stored(documents(spark, [text] * 4 + [None], [5, 5, 2, None, None]), tmp_path / "t")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [
        (False, 2, 0), (False, 5, 25), (False, 5, 25), (True, 0, 0), (True, 0, 25)]

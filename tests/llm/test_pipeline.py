"""The pipeline stage by stage against brute force, each stage on its own input."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from basketlake.llm import secrets
from tests.llm.helpers import awkward_texts, documents
from tests.llm.test_quality import corpus, folder_with
from tests.llm.test_repeats import hard_texts, plain
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens_and_packing import check_places


def inputs():
    texts, labels = corpus(160, 7)
    return texts + awkward_texts() + hard_texts() + ["see token = abcdefgh12345 there"], labels


def rows(frame):
    return {r.doc_id: r.asDict() for r in frame.collect()}


def test_every_stage_on_its_own_input(spark, tmp_path):
    texts, labels = inputs()
    folder = folder_with(spark, tmp_path, texts, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup",
                                                      "secret_scans", "best_fit_packing"]

    def step(name, frame):
        out = stages[name](spark, frame, folder)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    before, kept = rows(docs), step("quality_classifier", docs)
    after = rows(kept)
    assert kept.columns == docs.columns and all(before[i] == r for i, r in after.items())
    judged = [i for i in range(len(labels)) if (i in after) != bool(labels[i])]
    assert len(judged) <= 3  # clean documents stay, bad ones go

    once = step("simhash_near_dedup", kept)
    ids = sorted(after)
    groups = plain_components([plain_fingerprint(after[i]["text"]) for i in ids])
    assert once.columns == docs.columns and rows(once) == {ids[g]: after[ids[g]] for g in set(groups)}

    cut, held = step("substring_dedup", once), rows(once)
    ids = sorted(held)
    want = {}
    for i, (_, gone, text) in zip(ids, plain([(i, held[i]["text"]) for i in ids])):
        text = text if gone else held[i]["text"]
        want[i] = held[i] | {"text": text, "n_chars": held[i]["n_chars"] if text is None else len(text)}
    assert cut.columns == docs.columns and rows(cut) == want

    clean, seen = step("secret_scans", cut), rows(cut)
    out = rows(clean)
    assert clean.columns == docs.columns and out.keys() == seen.keys()
    for i, r in seen.items():
        assert out[i]["text"] == (None if r["text"] is None else secrets.redacted(r["text"], secrets.scan(r["text"])[1]))
    assert sum("[secret]" in (r["text"] or "") for r in out.values()) == 1

    packed = step("best_fit_packing", clean).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == out.keys()
    for i, r in out.items():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        for p in pieces[i]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
        assert sum(p.length for p in pieces[i]) == len(ids)
    check_places(packed, 1024)


def test_run_is_the_stages_in_turn(spark, tmp_path):
    texts, labels = inputs()
    folder = folder_with(spark, tmp_path, texts, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))


def test_null_and_repeated_ids_stay_apart(spark, tmp_path):
    folder = folder_with(spark, tmp_path / "x", ["a"], [1])
    docs = documents(spark, ["alpha beta", "gamma delta epsilon", "gamma delta epsilon", "zeta eta", "zeta eta"],
                     [None, None, None, 4, 4])
    out = corpus_pipeline.simhash_near_dedup(spark, docs, folder).collect()
    assert sorted((r.text, r.doc_id) for r in out) == [("alpha beta", None), ("gamma delta epsilon", None), ("zeta eta", 4)]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_with(spark, tmp_path, [], [])).count() == 0

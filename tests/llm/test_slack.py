"""Minimum-bin-slack packing against exhaustive subset sums, the tokenizers library and exact round trips."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from basketlake.llm import packing, queries, slack  # noqa: E402
from tests.llm.helpers import awkward_texts, documents, stored  # noqa: E402


def test_nearest_multiset_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        counts = Counter(items)
        lengths = sorted(counts, reverse=True)
        taken = slack.nearest_multiset(lengths, [counts[n] for n in lengths], room)
        assert sum(n * c for n, c in taken.items()) == best
        assert all(c <= counts[n] for n, c in taken.items())


def test_powers_of_two_cover_a_window():
    for lengths in ([5, 6], [1], [31], [8, 8], [3, 3, 3, 3]):
        window = [(i, 0, n, False) for i, n in enumerate(lengths)]
        out = slack.powers_of_two(window, 32)
        sizes = [sum(p[2] for p in w) for w in out]
        assert sum(sizes) == sum(lengths) and all(s & s - 1 == 0 for s in sizes) and len(set(sizes)) == len(sizes)
        for i, n in enumerate(lengths):
            parts = sorted((p[1], p[2]) for w in out for p in w if p[0] == i)
            assert [a for a, _ in parts] == [0, *np.cumsum([b for _, b in parts])[:-1]] and sum(b for _, b in parts) == n


def check_packing(rows, ids_of, capacity):
    """Every id in exactly one piece, checksums right, sequences gapless and without padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids_of[doc])
            part = ids_of[doc][r.start:r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[doc])
    sizes = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & at - 1 == 0
        sizes.append(at)
    assert sum(s < capacity for s in sizes) <= capacity.bit_length()
    return sizes


def test_documents_follow_the_tokenizers_library(spark, tmp_path):
    texts = awkward_texts() + ["a b <|endoftext|> c", "one\n\n\ntwo  three \t four"]
    rows = queries.op11_min_slack_packing(spark, stored(documents(spark, texts), tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(rows, {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}, 2048)


@pytest.mark.parametrize("group_items", [15, 20_000])
def test_windows_fill_over_several_levels(spark, group_items):
    texts = [t for t in awkward_texts() if t is not None] * 2
    encoder = packing.rank_file_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = slack.pack_documents(documents(spark, texts), encoder, 64, group_items).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(rows, {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}, 64)


def test_documents_stay_whole_where_a_multiset_fills_the_window():
    rng = random.Random(8)
    pieces = [(i, 0, rng.randint(1, 300), False) for i in range(4000)]
    filled, rest = slack.windows(pieces, 2048, False)
    assert all(sum(p[2] for p in w) == 2048 for w in filled)
    cut = {p[0] for w in filled for p in w if p[3]}
    assert len(cut) <= 3 and sum(p[2] for p in rest) < 2048
    # equal lengths that fill no window are cut, and nothing is padded
    filled, rest = slack.windows([(i, 0, 1500, False) for i in range(64)], 2048, True)
    assert sum(p[2] for w in filled for p in w) == 64 * 1500 and not rest
    assert all(n & n - 1 == 0 for n in (sum(p[2] for p in w) for w in filled))


def test_rows_that_need_care(spark, tmp_path):
    assert queries.op11_min_slack_packing(spark, stored(documents(spark, [], []), tmp_path / "e")).count() == 0
    rows = queries.op11_min_slack_packing(spark, stored(
        documents(spark, ["x y", "x y", None, "", "x y"], [None, None, 4, 4, 3]), tmp_path / "t")).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 2 and {r.doc_id for r in rows} == {None, 3, 4}
    places = defaultdict(int)
    for r in rows:
        places[r.sequence_id] += r.length
    assert all(n & n - 1 == 0 for n in places.values())


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        slack.pack_documents(documents(spark, ["x"]), None, 100)

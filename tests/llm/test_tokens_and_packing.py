"""Byte-level BPE against tiktoken, packing against the tokenizers library and exact bounds."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from basketlake.llm import bpe, packing, queries  # noqa: E402
from tests.llm.helpers import awkward_texts, documents, stored  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "B", "é", "1", "²", " ", "\n", "\t", "\x1c", "\x85", "  ", "'s", "'", "ll", "!", "漢",
             "😀", "́", "\r", "\x0b", "ſ", "the", " the ", "<|endoftext|>"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(n)] + ["a" * 3000, "xyz!" * 500, "漢字" * 900]


def test_documents_encode_as_tiktoken_does(spark, tmp_path):
    texts = awkward_texts() + fuzz(300, 1)
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, stored(documents(spark, texts), tmp_path)).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(RANKS))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_long_matches_encode_as_tiktoken_does():
    rng = random.Random(7)
    words = [t.decode() for t in bpe.load_ranks(RANKS) if t.isalpha() and t.isascii() and len(t) > 2][:5000]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(RANKS))
    tree = bpe.SegmentTreeBpe(bpe.load_ranks(RANKS))
    for size in (33_000, 40_000, 140_000):
        match = "".join(rng.choices(words, k=size))[:size]
        assert tree.merge_long(match.encode()) == library.encode_ordinary(match)


def test_pieces_are_independent_of_what_stands_beside_them():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    memo = packing.piece_memo(packing.rank_file_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                                        public_tokenizers.PATTERN, special))
    texts = fuzz(400, 9) + ["a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "x\n\n\n", "\u3000\xa0 \u2003y",
                            "a<|endoftext|>b <|endoftext|", "  <|endoftext|>\n"]
    for text, values in zip(texts, bpe.text_values(texts, memo, 500)):
        assert np.frombuffer(b"".join(values), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_memo_stays_small():
    memo = bpe.SegmentMemo(lambda pieces: [p.encode() for p in pieces], limit=100_000)
    rng = random.Random(1)
    for turn in range(40):
        texts = ["\n\n".join("".join(rng.choices("abcdefgh", k=rng.choice([5, 3000]))) for _ in range(20)) for _ in range(20)]
        assert [b"".join(v).decode() for v in bpe.text_values(texts, memo)] == texts
        held = sum(map(len, memo.raw)) + sum(map(len, memo.spaced))
        assert memo.size <= 100_000 + 400 * 300 and held <= memo.size + 20 * 20 * 3000
    memo.learn([], [])
    assert max(map(len, [*memo.raw, *memo.spaced], ), default=0) <= bpe.LONG_PIECE


def test_short_and_long_trees_agree():
    tree = bpe.SegmentTreeBpe(bpe.load_ranks(RANKS))
    rng = random.Random(5)
    matches = [bytes(rng.choices(b"abcdehilnorst \xc3\xa9", k=rng.randint(2, 64))) for _ in range(400)]
    for match in matches:
        size = 1 << max(1, (len(match) - 1).bit_length())
        ids = tree.merge_short([match], size)[0]
        assert ids == tree.merge_long(match)
        assert tree.decode(ids) == match


def test_pieces_follow_the_tokenizers_library(spark, tmp_path):
    texts = awkward_texts() + [t for t in fuzz(200, 2)]
    got = defaultdict(list)
    for r in queries.op2_best_fit_packing(spark, stored(documents(spark, texts), tmp_path)).collect():
        got[r.doc_id].append(r)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        rows = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [r.length for r in rows][1:] == [1024] * (len(rows) - 1) and rows[0].length <= 1024
        for r in rows:
            part = ids[r.start:r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in rows) == len(ids)
    check_places(itertools.chain(*got.values()), 1024)


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def exact_bins(sizes, capacity):
    """Smallest number of bins by exhaustive search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[at]}.values():
            place(at + 1, rooms[:i] + [rooms[i] - sizes[at]] + rooms[i + 1:])
        place(at + 1, rooms + [capacity - sizes[at]])

    place(0, [])
    return best[0]


def test_bounds_never_pass_the_exact_answer():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        _, _, room = packing.best_fit_decreasing(sizes, capacity)
        assert bound <= exact_bins(sizes, capacity) <= len(room)


def pieces(spark, sizes):
    rows = [(i, i, 0, 0, s, 0) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, packing.PIECE)


def test_exchange_reaches_the_bound_of_all_pieces(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 64) for _ in range(3000)] + [64] * 20
    packed = packing.pack_pieces(pieces(spark, sizes), 64, group_items=150).collect()
    assert sorted(r.doc_id for r in packed) == list(range(len(sizes)))
    bound = packing.lower_bound(np.bincount(sizes, minlength=65), 64)
    alone = sum(len(packing.best_fit_decreasing(sizes[i::20], 64)[2]) for i in range(20))
    bins = check_places(packed, 64)
    together = len(packing.best_fit_decreasing([s for s in sizes if s < 64], 64)[2]) + sizes.count(64)
    assert bound <= bins <= together + 3 and bins < alone - 20


@pytest.mark.parametrize("sizes", [[], [1024], [600] * 40, [1] * 5])
def test_small_and_uniform_inputs(spark, sizes):
    packed = packing.pack_pieces(pieces(spark, sizes), 1024, group_items=10).collect()
    assert len(packed) == len(sizes)
    assert check_places(packed, 1024) == packing.lower_bound(np.bincount(sizes, minlength=1025), 1024)


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    empty = stored(documents(spark, [], []), tmp_path / "empty")
    assert queries.op10_byte_bpe(spark, empty).count() == 0
    assert queries.op2_best_fit_packing(spark, empty).count() == 0
    twice = stored(documents(spark, ["x y", "x y", None], [None, None, 4]), tmp_path / "twice")
    assert queries.op10_byte_bpe(spark, twice).count() == 3
    assert queries.op2_best_fit_packing(spark, twice).count() == 3

"""Byte-level BPE by a segment tree over byte positions, and decoding.

A leaf of the tree holds the rank of the pair that starts at a live byte position, so its root is the
leftmost pair of the lowest rank. A merge rewrites the leaves of the merged position, of the absorbed
one and of the live neighbour to the left, each in a logarithmic number of nodes. Short matches are
merged side by side, one tree a row of a numpy array; a long match has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.int32(2 ** 31 - 1)
SHORT = 64
FLUSH = 300_000
# What a piece that is remembered may be long, what its entries cost beside their characters, and all of them
LONG_PIECE, ENTRY_BYTES, MEMO_BYTES = 64, 250, 160_000_000
_CLOSE_SPACES = re.compile(r"\s\s")
# Characters with the Unicode property White_Space (fixed values)
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = re.compile(f"[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class PairRanks:
    """Rank of the token that two tokens make together: an open-addressing table for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = dict(pairs)
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        values = np.array([v for _, v in pairs], dtype=np.int32)
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            taken, first = np.unique(slots[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[at], values[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they make no token; a negative right id is no token."""
        keys = left.astype(np.int64) << 32 | np.where(right < 0, 0, right)
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        at = slots[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            open_, at = open_[go], at[go]
        out[right < 0] = NONE
        return out


class SegmentTreeBpe:
    """Encodes pretokenized matches as the rank file's own library does, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.rank_of = ranks, PairRanks(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def encode(self, matches: list[bytes]) -> list[list[int]]:
        """Ids of each match: its own rank if it has one, else the merges of its bytes."""
        out: list[list[int] | None] = [None] * len(matches)
        by_size: dict[int, list[int]] = {}
        for at, match in enumerate(matches):
            whole = self.ranks.get(match)
            if whole is not None:
                out[at] = [whole]
            elif not match:
                out[at] = []
            elif len(match) > SHORT:
                out[at] = self.merge_long(match)
            else:
                by_size.setdefault(1 << max(1, (len(match) - 1).bit_length()), []).append(at)
        for size, places in by_size.items():
            for i in range(0, len(places), 50_000):
                part = places[i:i + 50_000]
                for at, ids in zip(part, self.merge_short([matches[p] for p in part], size)):
                    out[at] = ids
        return out

    def merge_short(self, matches: list[bytes], size: int) -> list[list[int]]:
        """One tree of ``size`` leaves a match, all merged step by step together."""
        n, shift = len(matches), size.bit_length() - 1
        padded = np.frombuffer(b"".join(m.ljust(size, b"\0") for m in matches), np.uint8).reshape(n, size)
        lengths = np.fromiter(map(len, matches), np.int64, n)
        places = np.arange(size, dtype=np.int32)
        ids = np.where(places < lengths[:, None], self.first[padded], np.int32(-1))
        after = np.where(places + 1 < lengths[:, None], places + 1, np.int32(size))
        before = np.broadcast_to(places - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE)
        ranks = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        tree[:, size:-1] = np.where(ranks < NONE, ranks << shift | places[:-1], NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root & (size - 1), root >> shift
            gone = after[rows, at]
            beyond = after[rows, gone]
            left = before[rows, at]
            ids[rows, at], ids[rows, gone], after[rows, at] = rank, -1, beyond
            inner = beyond < size
            before[rows[inner], beyond[inner]] = at[inner]
            has_left = left >= 0
            self._set(tree, rows, gone, np.full(len(rows), NONE), size, shift)
            self._set(tree, rows, at, self.rank_of(rank, ids[rows, beyond]), size, shift)
            again = rows[has_left]
            self._set(tree, again, left[has_left],
                      self.rank_of(ids[again, left[has_left]], rank[has_left]), size, shift)
            rows = rows[tree[rows, 1] < NONE]
        ids = ids[:, :size]
        live = ids >= 0
        flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _set(tree, rows, at, ranks, size, shift) -> None:
        node = at + size
        tree[rows, node] = np.where(ranks < NONE, ranks << shift | at, NONE)
        for _ in range(shift):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_long(self, match: bytes) -> list[int]:
        """The same tree for a single match of any length, in plain integers."""
        n, none, pairs = len(match), 1 << 62, self.rank_of.pairs  # above every rank and place
        shift = max(1, (n - 1).bit_length())
        size = 1 << shift
        ids = [int(self.first[b]) for b in match]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def pair(at: int) -> int:
            then = after[at]
            rank = pairs.get(ids[at] << 32 | ids[then]) if then < n else None
            return none if rank is None else rank << shift | at

        while tree[1] < none:
            at, rank = tree[1] & (size - 1), tree[1] >> shift
            gone = after[at]
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            ids[at], ids[gone] = rank, -1
            put(gone, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def segments(text: str, special: re.Pattern | None = None) -> tuple[list[str], list[str]]:
    """Pieces of a text that can be matched apart: first those as they are, then those after a space.

    Where no two white-space characters touch, the text is cut before every space and line end; a piece
    that starts without a line end then stands for itself after a space (the first one: without).
    Otherwise it is cut before the last character of every run of white space, and before the run.
    Strings that ``special`` finds are pieces of their own, and what stands between them is cut alone.
    """
    if special is not None and special.search(text):
        return [p for i, part in enumerate(special.split(text)) if part
                for p in ([part] if i % 2 else _PIECES.findall(part))], []
    if _CLOSE_SPACES.search(text):
        return _PIECES.findall(text), []
    first, *spaced = text.replace("\n", " \n").split(" ")
    return [first], spaced


class SegmentMemo:
    """Values of distinct short pieces, each computed once; emptied when it holds more than so many bytes.

    Longer pieces are computed for the texts at hand and forgotten after them. ``special`` strings are
    looked for before anything else, the longest first.
    """

    def __init__(self, compute, special: Iterable[str] = (), limit: int = MEMO_BYTES):
        self.compute, self.limit, self.size = compute, limit, 0
        self.raw: dict = {}
        self.spaced: dict = {}
        self.passing: list[tuple[dict, str]] = []
        names = sorted(special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def learn(self, raw: Iterable[str], spaced: Iterable[str]) -> None:
        for held, piece in self.passing:
            held.pop(piece, None)
        self.passing = []
        if self.size > self.limit:
            self.raw, self.spaced, self.size = {}, {}, 0
        plain = [p for p in set(raw) if p not in self.raw]
        after = [p for p in set(spaced) if p not in self.spaced]
        values = self.compute(plain + [p if p[:1] == "\n" else " " + p for p in after])
        for held, pieces, own in ((self.raw, plain, values), (self.spaced, after, values[len(plain):])):
            held.update(zip(pieces, own))
            for piece, value in zip(pieces, own):
                if len(piece) > LONG_PIECE:
                    self.passing.append((held, piece))
                else:
                    self.size += ENTRY_BYTES + 4 * len(piece) + len(value)

    def values(self, raw: list[str], spaced: list[str]) -> list:
        return [*map(self.raw.__getitem__, raw), *map(self.spaced.__getitem__, spaced)]


def text_values(batch_texts: list[str], memo: SegmentMemo, flush: int = FLUSH) -> Iterator[list]:
    """For each text the values of its pieces, learning a bounded number of pieces at a time."""
    held: list[tuple[list[str], list[str]]] = []
    size = 0

    def release() -> Iterator[list]:
        memo.learn((p for raw, _ in held for p in raw), (p for _, spaced in held for p in spaced))
        for raw, spaced in held:
            yield memo.values(raw, spaced)

    for text in batch_texts:
        held.append(segments(text, memo.special))
        size += len(held[-1][0]) + len(held[-1][1]) + len(text) // 16
        if size >= flush:
            yield from release()
            held, size = [], 0
    yield from release()


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the comma-joined ids, digest of the bytes decoded from them.

    Every match of the pattern in the whole text is encoded by itself. A null text counts as empty
    (no ids); repeated rows and null ids are encoded like any other; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matcher, bpe = regex.compile(pattern), SegmentTreeBpe(load_ranks(ranks_path))

        names = [str(i) for i in range(max(bpe.bytes_of, default=0) + 1)]
        bytes_of = {names[i]: raw for i, raw in bpe.bytes_of.items()}

        def compute(pieces: list[str]) -> list[str]:
            cut = list(map(matcher.findall, pieces))
            distinct = list({m for ms in cut for m in ms})
            ids = {m: ",".join(map(names.__getitem__, own))
                   for m, own in zip(distinct, bpe.encode([m.encode() for m in distinct]))}
            return [ids[ms[0]] if len(ms) == 1 else ",".join(map(ids.__getitem__, ms)) for ms in cut]

        memo = SegmentMemo(compute)
        for batch in batches:
            rows = []
            for values in text_values([v.as_py() or "" for v in batch.column(1)], memo):
                joined = ",".join(filter(None, values))
                ids = joined.split(",") if joined else []
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                             hashlib.sha256(b"".join(map(bytes_of.__getitem__, ids))).hexdigest()))
            n, ids, raw = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, ENCODED)

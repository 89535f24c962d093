"""Substring dedup by a relative Lempel-Ziv parse against an index of all documents.

The reference is the whole corpus, indexed in blocks by key range. A document is factored greedily:
at each word the factor goes on as long as the window of ``window`` words that starts there occurs
earlier (in a smaller id, or before in the same document); where no window does, the word is a literal.
Windows on both sides of a factor's end are looked up by themselves, so nothing is missed at its
boundary. Words of factors (all at least ``window`` long) are duplicates.

Only windows that can repeat are looked up. Each window has an anchor, the smallest hash of the
8-word grams in it; equal windows have equal anchors. Chunks first ask which of their anchors occur
more than once, then ask about the windows of those anchors alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.chunks import (by_part, chunked, distinct, from_planes, joined, pack_keys, planes,
                                   ranges, table, unpack_keys, word_hashes)
from basketlake.llm.common import carried, texts

GRAM = 8
ANCHORS = "part int, chunk int, keys binary, counts binary"
WINDOWS = "part int, chunk int, keys binary, ids binary, starts binary"
ANSWER = "chunk int, step int, part int, bits binary"
LAST_ID = 2 ** 63 - 1


class Windows:
    """Windows of all texts of a chunk: keys, anchors, first words, and the documents' word lists."""

    def __init__(self, column: pa.Array, window: int, keep_words: bool = False):
        self.words: list[list[bytes]] = []
        hashes, sizes = [], []
        for text in texts(column):
            words, h = word_hashes(text)
            hashes.append(h)
            sizes.append(len(h))
            if keep_words:
                self.words.append(words)
        self.sizes = np.array(sizes, np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(hashes) if hashes else np.array([], np.uint64)
        gram = min(GRAM, window)
        counts = np.maximum(self.sizes - window + 1, 0)
        # first word of every window, among all words of the chunk
        self.at = np.repeat(self.firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.doc = np.repeat(np.arange(len(sizes)), counts)
        if not len(self.at):
            self.keys = self.anchors = np.array([], np.uint64)
            return
        short = flat
        for step in range(1, gram):
            short = joined(short[:-1], flat[step:])  # key of the gram that starts at each word
        long = flat
        for step in range(1, window):
            long = joined(long[:-1], flat[step:])
        spans = np.lib.stride_tricks.sliding_window_view(short, window - gram + 1)
        self.anchors = np.concatenate([spans[self.at[i:i + 1_000_000]].min(axis=1)
                                       for i in range(0, len(self.at), 1_000_000)])
        self.keys = long[self.at]

    @property
    def starts(self) -> np.ndarray:
        """First word of every window within its document."""
        return self.at - self.firsts[self.doc]


def _ids(column: pa.Array) -> np.ndarray:
    """Ids, with nulls after all others."""
    return np.array([LAST_ID if v is None else v for v in column.to_pylist()], np.int64)


def _ask_anchors(window: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks()
        found = Windows(batch.column("text").combine_chunks(), window)
        # windows of one anchor side by side are one occurrence
        fresh = np.ones(len(found.anchors), bool)
        fresh[1:] = (found.anchors[1:] != found.anchors[:-1]) | (found.doc[1:] != found.doc[:-1])
        repeated = np.bincount(distinct(found.anchors)[1], weights=fresh) if len(fresh) else np.array([])
        values = distinct(found.anchors)[0]
        # two windows of one run may still be equal where words repeat with a short period
        close = np.zeros(len(values), bool)
        if len(values):
            order = np.argsort(found.keys, kind="stable")
            same = found.keys[order][1:] == found.keys[order][:-1]
            close[np.searchsorted(values, found.anchors[order[1:][same]])] = True
        counts = np.where(close, 2, np.minimum(repeated, 2)) if len(values) else np.array([])
        ends = ranges(values, parts)
        keep = [p for p in range(parts) if ends[p + 1] > ends[p]]
        return table(ANCHORS, {
            "part": keep, "chunk": [batch.column("chunk")[0].as_py()] * len(keep),
            "keys": [pack_keys(values[ends[p]:ends[p + 1]]) for p in keep],
            "counts": [counts[ends[p]:ends[p + 1]].astype(np.uint8).tobytes() for p in keep]})
    return run


def _bits(rows: pa.Table, step: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    return table(ANSWER, {"chunk": rows.column("chunk").to_pylist(), "step": [step] * rows.num_rows,
                          "part": rows.column("part").to_pylist(),
                          "bits": [flags[a:b].astype(np.uint8).tobytes() for a, b in zip(ends, ends[1:])]})


def _answer_anchors(rows: pa.Table) -> pa.Table:
    """Whether each asked anchor has two occurrences or more, anywhere."""
    keys = [unpack_keys(raw) for raw in by_part(rows, "keys")]
    counts = np.concatenate([np.frombuffer(raw, np.uint8) for raw in by_part(rows, "counts")])
    values, at = distinct(np.concatenate(keys))
    totals = np.bincount(at, weights=counts, minlength=len(values))[at]
    return _bits(rows, 1, totals > 1, [len(k) for k in keys])


def _answers(rows: pa.Table, step: int) -> np.ndarray:
    found = sorted((part, raw) for s, part, raw in zip(rows.column("step").to_pylist(),
                   rows.column("part").to_pylist(), by_part(rows, "bits")) if s == step)
    return np.frombuffer(b"".join(raw for _, raw in found), np.uint8).astype(bool)


def _earliest(found: Windows, ids: np.ndarray, chosen: np.ndarray):
    """Of the chosen windows: sorted distinct keys, each window's place, and each key's first (id, start)."""
    values, at = distinct(found.keys[chosen])
    id_, start = ids[found.doc[chosen]], found.starts[chosen]
    order = np.lexsort((start, id_, at))
    head = order[np.searchsorted(at[order], np.arange(len(values)))]
    return values, at, id_[head], start[head]


def _repeating(found: Windows, answers: pa.Table) -> np.ndarray:
    values, at = distinct(found.anchors)
    return np.flatnonzero(_answers(answers, 1)[at]) if len(values) else np.array([], np.int64)


def _ask_windows(window: int, parts: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks()
        out = {n: [] for n in ("part", "chunk", "keys", "ids", "starts")}
        if batch.num_rows:
            found = Windows(batch.column("text").combine_chunks(), window)
            values, _, ids, starts = _earliest(found, _ids(batch.column("doc_id")), _repeating(found, right))
            ends = ranges(values, parts)
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if b > a:
                    for n, v in (("part", p), ("chunk", batch.column("chunk")[0].as_py()),
                                 ("keys", pack_keys(values[a:b])), ("ids", planes(ids[a:b])),
                                 ("starts", planes(starts[a:b]))):
                        out[n].append(v)
        return table(WINDOWS, out)
    return run


def _answer_windows(rows: pa.Table) -> pa.Table:
    """Whether each asked window occurs before the place that its chunk names."""
    keys = [unpack_keys(raw) for raw in by_part(rows, "keys")]
    ids = np.concatenate([from_planes(raw) for raw in by_part(rows, "ids")]).view(np.int64)
    starts = np.concatenate([from_planes(raw) for raw in by_part(rows, "starts")]).view(np.int64)
    values, at = distinct(np.concatenate(keys))
    order = np.lexsort((starts, ids, at))
    head = order[np.searchsorted(at[order], np.arange(len(values)))][at]
    earlier = (ids[head] < ids) | ((ids[head] == ids) & (starts[head] < starts))
    return _bits(rows, 2, earlier, [len(k) for k in keys])


def factors(repeats: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, length) of one document from the sorted starts of its repeats."""
    if not len(repeats):
        return []
    cuts = np.flatnonzero(np.diff(repeats) > 1)
    heads, tails = repeats[np.append(0, cuts + 1)], repeats[np.append(cuts, len(repeats) - 1)]
    return list(zip(heads.tolist(), (tails - heads + window).tolist()))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, length in spans:
        out += words[at:max(at, start)]
        at = max(at, start + length)
    return out + words[at:] if spans else words


def _remove(window: int, columns: list[str], whole: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks()
        found = Windows(batch.column("text").combine_chunks(), window, keep_words=True)
        ids = _ids(batch.column("doc_id"))
        chosen = _repeating(found, right)
        _, at, first_id, first_start = _earliest(found, ids, chosen)
        id_, start = ids[found.doc[chosen]], found.starts[chosen]
        later = _answers(right, 2)[at] if len(at) else np.array([], bool)
        later |= (first_id[at] < id_) | ((first_id[at] == id_) & (first_start[at] < start))
        docs, starts = found.doc[chosen][later], start[later]
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        edges = np.searchsorted(docs, np.arange(batch.num_rows + 1))
        n, removed, kept = [], [], []
        for i, words in enumerate(found.words):
            rest = kept_words(words, factors(starts[edges[i]:edges[i + 1]], window))
            n.append(len(words))
            removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
        if whole:
            original = batch.column("text").to_pylist()
            text = [o if not r else k.decode() for o, r, k in zip(original, removed, kept)]
            at = columns.index("text")
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(text, batch.column("text").type)
            return pa.Table.from_arrays(arrays, names=columns)
        return pa.table({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})
    return run


def _removal(docs: DataFrame, window: int, whole: bool) -> DataFrame:
    dealt, parts = chunked(docs, docs.columns, "text")
    asked = dealt.select("doc_id", "text", "chunk") if not whole else dealt
    anchors = asked.groupBy("chunk").applyInArrow(_ask_anchors(window, parts), ANCHORS)
    repeated = anchors.groupBy("part").applyInArrow(_answer_anchors, ANSWER)
    windows = asked.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(
        _ask_windows(window, parts), WINDOWS)
    earlier = windows.groupBy("part").applyInArrow(_answer_windows, ANSWER)
    answers = repeated.unionByName(earlier)
    schema = docs.schema if whole else "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return asked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _remove(window, docs.columns, whole), schema)


def repeated_words(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, judged on the input alone.

    Null and empty texts have no words. Rows of one id count as one document: a window is a repeat
    if it starts earlier under that id; equal rows keep or lose the same words, and none of them is
    earlier than another. Null ids come after all ids. An empty table gives an empty result.
    """
    return _removal(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), window, False)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The same rows and columns (doc_id, text and any others) without the repeated words.

    A text that loses words becomes its kept words joined by one space; others stay as they are, nulls
    and empty texts too. Rows of one id count as one document. Other columns may have any names. An
    empty table stays empty.
    """
    packed, back = carried(docs)
    return back(_removal(packed, window, True))

"""Language-model scores by a weighted backoff automaton over smoothed word n-grams.

Counts of all n-grams of the training documents are gathered exactly. Order k is smoothed towards
order k - 1 with a Dirichlet prior of weight m:

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),  p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

Every seen history is a state; a seen continuation is an arc with log10 p(w | h); every state has a
failure arc to its suffix h' with weight log10 m / (c(h) + m). A text is scored by one traversal from
left to right that carries the state, adding the weights of the arcs and failures it takes; the sum
over all words at any state is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.chunks import (by_part, chunked, distinct, from_planes, joined, pack_keys, planes,
                                   ranges, table, unpack_keys, word_hashes)
from basketlake.llm.common import texts

END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)
ADD = 0.1
SLICE = 1 << 16  # tokens of a text that are Python numbers at once
QUESTION = "level int, part int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, level int, part int, counts binary"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each start mark, words, end mark; and the texts' first places."""
    parts, sizes = [], []
    for text in texts(column):
        hashes = word_hashes(text, lower=True)[1]
        parts += [[START], hashes, [END]]
        sizes.append(len(hashes) + 2)
    tokens = np.concatenate(parts).astype(np.uint64) if parts else np.array([], np.uint64)
    return tokens, np.cumsum([0, *sizes])[:-1].astype(np.int64)


def grams(tokens: np.ndarray, firsts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length k, the places where a gram of k tokens of one text ends, and its key there."""
    depth = np.arange(len(tokens)) - np.repeat(firsts, np.diff(np.append(firsts, len(tokens))))
    keys = tokens
    for k in range(1, order + 1):
        if k > 1:
            keys = np.concatenate([keys[:1], joined(keys[:-1], tokens[1:])])
        yield np.flatnonzero(depth >= k - 1), keys


def _ask(order: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks()
        tokens, firsts = sequences(batch.column("text").combine_chunks())
        sizes = np.diff(np.append(firsts, len(tokens)))
        training = np.repeat(~np.array(batch.column("held_out").to_pylist(), bool), sizes)
        out = {n: [] for n in ("level", "part", "chunk", "keys", "counts")}
        for level, (places, keys) in enumerate(grams(tokens, firsts, order), 1):
            values, at = distinct(keys[places])
            counts = np.bincount(at, weights=training[places], minlength=len(values))
            ends = ranges(values, parts)
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if b > a:
                    for n, v in (("level", level), ("part", p), ("chunk", batch.column("chunk")[0].as_py()),
                                 ("keys", pack_keys(values[a:b])), ("counts", planes(counts[a:b]))):
                        out[n].append(v)
        return table(QUESTION, out)
    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Totals over all chunks of the keys of one range, for each chunk in the order it asked."""
    keys = [unpack_keys(raw) for raw in by_part(rows, "keys")]
    counts = np.concatenate([from_planes(raw) for raw in by_part(rows, "counts")]).astype(np.float64)
    values, at = distinct(np.concatenate(keys))
    totals = np.bincount(at, weights=counts, minlength=len(values))[at]
    ends = np.cumsum([0, *map(len, keys)])
    return table(ANSWER, {"chunk": rows.column("chunk").to_pylist(), "level": rows.column("level").to_pylist(),
                          "part": rows.column("part").to_pylist(),
                          "counts": [planes(totals[a:b]) for a, b in zip(ends, ends[1:])]})


class BackoffAutomaton:
    """States, arcs and failure arcs of the n-grams that occur in some texts, with their totals.

    ``levels`` has for each gram length the codes of the grams that end at all places (-1: none) and
    the total by code. A state is a seen gram of fewer than ``order`` tokens, the root the empty one.
    The arc from the state of k tokens that ends before a place, with the token there, is the gram of
    k + 1 tokens that ends at the place, so weights lie in one array a length, addressed by its code;
    the last element of each stands for -1.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], scale: float, weight: float):
        self.codes, self.seen, self.weight, self.fail = [], [], [], [None]
        self.top = len(levels) - 1
        for codes, totals in levels:
            if not self.codes:
                p = (totals + ADD) / scale
            else:
                places = np.flatnonzero(codes >= 0)
                one = np.empty(len(totals), np.int64)
                one[codes[places]] = places  # a place of each gram
                before = histories[self.codes[-1][one - 1]]
                p = (totals + weight * 10.0 ** self.weight[-1][self.codes[-1][one]]) / (before + weight)
            histories = totals
            self.codes.append(codes)
            self.seen.append(np.append(totals > 0, False))
            self.weight.append(np.append(np.log10(p), np.nan))
            self.fail.append(np.append(np.log10(weight / (totals + weight)), np.nan))

    def score(self, start: int, end: int) -> float:
        """One traversal of the tokens after the start mark at ``start``: their log10 probability."""
        top = self.top
        state, total = int(self.seen[0][self.codes[0][start]]) if top else 0, 0.0  # tokens of the state's gram
        for first in range(start, end - 1, SLICE):
            last = min(end, first + SLICE + 1)
            here = [codes[first:last] for codes in self.codes]
            seen = [known[at].tolist() for known, at in zip(self.seen, here)]
            weight = [arcs[at].tolist() for arcs, at in zip(self.weight, here)]
            fail = [None] + [arcs[at].tolist() for arcs, at in zip(self.fail[1:], here[:top])]
            for i in range(1, last - first):
                while state and not seen[state][i]:
                    total += fail[state][i - 1]
                    state -= 1
                total += weight[state][i]
                state = min(state + 1, top) if seen[state][i] else 0
        return total


def _score(order: int, tokens_seen: int, distinct_seen: int, weight: float):
    scale = tokens_seen + ADD * (distinct_seen + 1)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks()
        tokens, firsts = sequences(batch.column("text").combine_chunks())
        rows = sorted(zip(right.column("level").to_pylist(), right.column("part").to_pylist(), range(len(right))))
        levels = []
        for level, (places, keys) in enumerate(grams(tokens, firsts, order), 1):
            codes = np.full(len(tokens), -1, np.int32)
            codes[places] = distinct(keys[places])[1]
            totals = [from_planes(right.column("counts")[i].as_py()) for at, _, i in rows if at == level]
            levels.append((codes, np.concatenate([*totals, np.array([], np.uint64)]).astype(np.float64)))
        automaton = BackoffAutomaton(levels, scale, weight)
        codes, totals = levels[0]
        known = totals[codes]
        logs = np.log10((known + ADD) / scale)
        ends = np.append(firsts, len(tokens)).tolist()
        base, seen, scores = [], [], []
        for a, b in zip(ends, ends[1:]):
            base.append(float(logs[a + 1:b].sum()))
            seen.append(int((known[a + 1:b] > 0).sum()))
            scores.append(automaton.score(a, b))
        return pa.table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                         "n_tokens": pa.array([b - a - 1 for a, b in zip(ends, ends[1:])], pa.int64()),
                         "n_known": pa.array(seen, pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(scores, pa.float64())})
    return run


def vocabulary(docs: DataFrame, parts: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the rows that are not held out, end marks included."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            values, at = distinct(np.concatenate(held))
            counts, ends = np.bincount(at), ranges(values, parts)
            keep = [p for p in range(parts) if ends[p + 1] > ends[p]]
            return pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int32()),
                 pa.array([pack_keys(values[ends[p]:ends[p + 1]]) for p in keep], pa.binary()),
                 pa.array([int(counts[ends[p]:ends[p + 1]].sum()) for p in keep], pa.int64())],
                names=["part", "keys", "n"])

        for batch in batches:
            for text in texts(batch.column(0)):
                held += [word_hashes(text, lower=True)[1], np.array([END])]
                if len(held) > 2000 and sum(map(len, held)) > 1_500_000:
                    yield packed()
                    held = []
        if held:
            yield packed()

    def count(rows: pa.Table) -> pa.Table:
        values = distinct(np.concatenate([unpack_keys(raw) for raw in by_part(rows, "keys")]))[0]
        return pa.table({"v": pa.array([len(values)], pa.int64()),
                         "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    asked = docs.where(~F.col("held_out")).select("text").mapInArrow(words, "part int, keys binary, n bigint")
    found = asked.groupBy("part").applyInArrow(count, "v bigint, n bigint").agg(F.sum("n"), F.sum("v")).first()
    return found[0] or 0, found[1] or 0


def score_documents(docs: DataFrame, held_out, order: int = 2, prior: float = 20.0, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Scores of every row's whole text under the model of all rows that are not held out.

    ``held_out`` is a boolean column of the ids. A null text is empty: its end mark is scored. Rows
    with null ids and repeated rows are learnt from and scored like any other. With no training rows
    every token has the probability of an unseen one. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       held_out.alias("held_out"))
    dealt, parts = chunked(rows, ["doc_id", "text", "held_out"], "text")
    n, v = vocabulary(rows, parts)
    asked = dealt.groupBy("chunk").applyInArrow(_ask(order, parts), QUESTION)
    answers = asked.groupBy("level", "part").applyInArrow(_answer, ANSWER)
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, n, v, prior), SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("bigint"))

"""Hard negatives by threshold joins with suffix-norm bounds.

Anchors and rows meet in blocks of a grid. Inside a block the dimensions are ordered by their energy
and cut into slabs, which are the lists of an inverted index: a row enters the list of a slab only if
the norm of its components from there on, times the largest anchor norm, can still reach the lowest
threshold of the block; the omitted rest is added when a pair is verified. Partial scores accumulate
slab by slab, and a pair is dropped once its partial score plus the product of both remaining norms is
under the anchor's threshold. Thresholds start near the top of what is wanted and are lowered for the
anchors whose windows are not full, until they are or the floor is reached. Every block gives its own
best rows, of which the best of all blocks are taken; nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm.common import tasks, written

ROWS, ANCHORS = 65_536, 32_768
ROW_BLOCK, ANCHOR_BLOCK = 4096, 256
SLABS = 8
POSITIVE = "anchor bigint, other bigint, score bigint"
NEGATIVE = "anchor bigint, positive_score bigint, negative_id bigint, negative bigint, negative_score bigint"


def usable(vector: Column) -> Column:
    """Vectors that are not null and hold finite components only."""
    doubles = vector.cast("array<double>")
    return F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Block:
    """Rows or anchors with their components in the block's order of dimensions, and remaining norms."""

    def __init__(self, values: np.ndarray, order: np.ndarray, edges: list[int]):
        self.values = values[:, order]
        squares = np.cumsum((self.values[:, ::-1].astype(np.float64) ** 2), axis=1)[:, ::-1] if values.shape[1] else None
        # rest[e]: norm of the components from edge e on, a little up so that rounding never drops a pair
        self.rest = [np.sqrt(squares[:, e]) * (1 + 1e-9) if squares is not None and e < values.shape[1]
                     else np.zeros(len(values)) for e in edges]


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Integer vectors of one length; in floating point where every product sum is exact in it."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1)


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """As floats if all inner products stay below 2^53, else as 64-bit integers."""
    dims = parts[0].shape[1]
    most = [float(np.abs(p.astype(np.float64)).max(initial=0.0)) for p in parts]
    return [p.astype(np.float64) for p in parts] if dims * most[0] * most[1] < 2.0 ** 53 else list(parts)


def threshold_join(rows: Block, anchors: Block, edges: list[int], low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, anchor, score) with a score of at least the anchor's ``low``."""
    n, q = len(rows.values), len(anchors.values)
    # scores are whole numbers: one less covers the rounding of the bounds
    needed = low - 1 - 1e-12 * np.abs(np.where(np.isfinite(low), low, 0.0))
    floor, widest = needed.min(initial=np.inf), anchors.rest[0].max(initial=0.0)
    partial = np.zeros((n, q), rows.values.dtype)
    alive = None
    taken = np.full(n, edges[-1])  # where the indexed part of a row ends
    for slab, (a, b) in enumerate(zip(edges, edges[1:])):
        # rows whose remaining norm cannot reach the lowest threshold alone are not in further lists
        inside = rows.rest[slab] * widest >= floor if slab else np.ones(n, bool)
        taken = np.where(~inside & (taken > a), a, taken)
        listed = np.flatnonzero(inside)
        if alive is None:
            if len(listed) == n:
                partial += rows.values[:, a:b] @ anchors.values[:, a:b].T
            elif len(listed):
                partial[listed] += rows.values[listed, a:b] @ anchors.values[:, a:b].T
        elif len(alive[0]):
            r, c = alive
            at = inside[r]
            partial[r[at], c[at]] += np.einsum("ij,ij->i", rows.values[r[at], a:b], anchors.values[c[at], a:b])
        # a listed row has all slabs to b; an unlisted one only those before its end
        row_rest = np.where(inside, rows.rest[slab + 1], np.nan)
        for e in np.unique(taken[~inside]):
            at = ~inside & (taken == e)
            row_rest[at] = rows.rest[edges.index(e)][at]
        if alive is None:
            bound = np.where(inside[:, None], row_rest[:, None] * anchors.rest[slab + 1], 0.0)
            if not inside.all():
                out = np.flatnonzero(~inside)
                ends = np.array([edges.index(e) for e in taken[out]])
                bound[out] = row_rest[out, None] * np.stack(anchors.rest)[ends]
            left = partial + bound >= needed
            if left.sum() * 8 < left.size:
                alive = np.nonzero(left)
        else:
            r, c = alive
            own = np.where(inside[r], anchors.rest[slab + 1][c], 0.0)
            if not inside.all():
                stack = np.stack(anchors.rest)
                ends = np.searchsorted(edges, taken[r])
                own = np.where(inside[r], own, stack[ends, c])
            left = partial[r, c] + row_rest[r] * own >= needed[c]
            alive = r[left], c[left]
    r, c = np.nonzero(partial + _rests(rows, anchors, edges, taken) >= needed) if alive is None else alive
    score = partial[r, c]
    for e in np.unique(taken):
        if e < edges[-1]:
            at = np.flatnonzero(taken[r] == e)
            score[at] += np.einsum("ij,ij->i", rows.values[r[at], e:], anchors.values[c[at], e:])
    good = score >= low[c]
    return r[good], c[good], score[good].astype(np.int64)


def _rests(rows: Block, anchors: Block, edges: list[int], taken: np.ndarray) -> np.ndarray:
    """Bound of the omitted parts of all pairs."""
    if (taken == edges[-1]).all():
        return np.zeros((1, 1))
    ends = np.searchsorted(edges, taken)
    rest = np.stack(rows.rest)[ends, np.arange(len(taken))]
    return rest[:, None] * np.stack(anchors.rest)[ends]


def _slabs(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Dimensions by falling energy, and the edges of the slabs."""
    order = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    dims = values.shape[1]
    return order, sorted({*range(0, dims, max(1, -(-dims // SLABS))), dims})


def _blocks(left: pa.Table, right: pa.Table, row_block: int, anchor_block: int) -> Iterator[tuple]:
    """(row slice, anchor slice, blocks, edges) of all small blocks of one cell of the grid."""
    rows, anchors = exact(matrix(left.column("vector"), left.num_rows), matrix(right.column("vector"), right.num_rows))
    order, edges = _slabs(rows)
    for q in range(0, len(anchors), anchor_block):
        own = Block(anchors[q:q + anchor_block], order, edges)
        for r in range(0, len(rows), row_block):
            yield slice(r, r + row_block), q, Block(rows[r:r + row_block], order, edges), own, edges


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, number: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((number, ids, -score, group))
    sorted_ = group[order]
    first = np.searchsorted(sorted_, sorted_)
    return order[np.arange(len(order)) - first < most]


def _positives(most: int, row_block: int, anchor_block: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            ids, number = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            anchor = right.column("row").to_numpy()
            for r, q, rows, anchors, edges in _blocks(left, right, row_block, anchor_block):
                names, places = number[r], ids[r]
                top = anchors.rest[0] * rows.rest[0].max(initial=0.0)
                open_ = np.arange(len(anchors.values))
                for step in (0.8, 0.5, 0.3, 0.15, None):
                    own = Block.__new__(Block)
                    own.values, own.rest = anchors.values[open_], [x[open_] for x in anchors.rest]
                    low = np.full(len(open_), -np.inf) if step is None else top[open_] * step
                    a, c, score = threshold_join(rows, own, edges, low)
                    c = open_[c]
                    other = names[a] != anchor[q + c]
                    a, c, score = a[other], c[other], score[other]
                    full = np.bincount(c, minlength=len(anchors.values)) >= most
                    done = full[c] if step is not None else np.ones(len(c), bool)
                    a, c, score = a[done], c[done], score[done]
                    keep = _best(c, score, places[a], names[a], most)
                    out.append((anchor[q + c[keep]], names[a[keep]], score[keep], places[a[keep]]))
                    open_ = open_[~full[open_]]
                    if not len(open_):
                        break
        who, other, score, place = map(np.concatenate, zip(*out))
        keep = _best(who, score, place, other, most)
        who, other, score = who[keep], other[keep], score[keep]
        return pa.table({"anchor": pa.array(who, pa.int64()), "other": pa.array(other, pa.int64()),
                         "score": pa.array(score, pa.int64())})
    return run


def _negatives(most: int, low_percent: int, row_block: int, anchor_block: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 5]
        if left.num_rows and right.num_rows:
            ids, number = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            labels, anchor_label = left.column("label").to_numpy(), right.column("label").to_numpy()
            anchor = right.column("row").to_numpy()
            windows = right.column("windows").combine_chunks()
            counts = np.diff(windows.offsets.to_numpy())
            tops = windows.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(counts)])
            for r, q, rows, anchors, edges in _blocks(left, right, row_block, anchor_block):
                names, places, own_label = (v[r] for v in (number, ids, labels))
                n = len(anchors.values)
                # the block's windows: anchor within it, and its highest score
                part = slice(ends[q], ends[q + n])
                at, high = np.repeat(np.arange(n), counts[q:q + n]), tops[part]
                open_ = np.arange(len(at))
                for step in (95, 90, 85, low_percent):
                    step = max(step, low_percent)
                    # the lowest threshold among an anchor's open windows; scores are whole numbers
                    low = np.full(n, np.inf)
                    np.minimum.at(low, at[open_], -(-step * high[open_] // 100).astype(np.float64))
                    asked = np.flatnonzero(low < np.inf)
                    own = Block.__new__(Block)
                    own.values, own.rest = anchors.values[asked], [x[asked] for x in anchors.rest]
                    a, c, score = threshold_join(rows, own, edges, low[asked])
                    c = asked[c]
                    other = own_label[a] != anchor_label[q + c]
                    a, c, score = a[other], c[other], score[other]
                    window, pair = _spread(at, open_, c)
                    fits = (score[pair] <= high[window]) & (100 * score[pair] >= step * high[window])
                    window, pair = window[fits], pair[fits]
                    full = np.bincount(window, minlength=len(at)) >= most
                    done = full[window] if step > low_percent else np.ones(len(window), bool)
                    window, pair = window[done], pair[done]
                    keep = _best(window, score[pair], places[a[pair]], names[a[pair]], most)
                    window, pair = window[keep], pair[keep]
                    out.append((anchor[q + at[window]], high[window], places[a[pair]], names[a[pair]], score[pair]))
                    open_ = open_[~full[open_]]
                    if not len(open_) or step == low_percent:
                        break
        who, high, ids_, names_, score_ = map(np.concatenate, zip(*out))
        window = np.unique(np.stack([who, high]), axis=1, return_inverse=True)[1].ravel()
        keep = _best(window, score_, ids_, names_, most)
        who, high, ids_, names_, score_ = who[keep], high[keep], ids_[keep], names_[keep], score_[keep]
        return pa.table({"anchor": pa.array(who, pa.int64()), "positive_score": pa.array(high, pa.int64()),
                         "negative_id": pa.array(ids_, pa.int64()), "negative": pa.array(names_, pa.int64()),
                         "negative_score": pa.array(score_, pa.int64())})
    return run


def _spread(at: np.ndarray, open_: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, pair) for every pair and every open window of its anchor; windows are sorted by anchor."""
    owner = at[open_]
    first, last = np.searchsorted(owner, c), np.searchsorted(owner, c, side="right")
    held = last - first
    pair = np.repeat(np.arange(len(c)), held)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(held) - held, held)
    return open_[first[pair] + step], pair


def _grid(rows: DataFrame, anchors: DataFrame, keys: list[str], n: int, m: int, run, schema: str) -> DataFrame:
    """Every group of rows with every group of anchors (of equal keys), each pair of groups in one task.

    Groups are dealt by a hash of the row's number, so their size is bounded whatever labels or
    copies rows hold; a row travels once for each of the few groups of anchors.
    """
    parts, groups = max(tasks(rows.sparkSession), -(-n // ROWS)) if n else 1, max(1, -(-m // ANCHORS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    by = [*keys, "part", "group"]
    return dealt.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256, positives: int = 5,
                   negatives: int = 5, low_percent: int = 80, vec_id: str = "vec_id",
                   vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``is_anchor`` are columns of the table. Scores are inner products of the components
    floor(scale x). An anchor's positives are its first rows of the same label; their negatives are
    the first rows of other labels with scores from ``low_percent`` percent of the positive's score
    up to that score. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors
    are compared with those of the same length only; empty ones score 0. Repeated rows are rows of
    their own, and an anchor's equal is one of its other rows. No anchors, or an empty table, give no
    rows. Scores must fit 64 bits.
    """
    own = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                         F.col(vector).cast("array<double>").alias("vector"),
                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    good = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = written(good.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", F.size("vector").alias("dimensions"),
        F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("vector")), "negative-rows")
    anchors = rows.where("anchor").drop("anchor")
    plain = rows.drop("anchor")
    n, m = (rows.count(), anchors.count())
    near = _grid(plain, anchors.select("row", "label", "dimensions", "vector"), ["dimensions", "label"], n, m,
                 _positives(positives, ROW_BLOCK, ANCHOR_BLOCK), POSITIVE)
    ids = plain.select(F.col("row").alias("other"), F.col("vec_id").alias("positive_id"))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "other")
    chosen = written(near.join(ids, "other").withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= positives).select("anchor", "other", "positive_id", F.col("score").alias("positive_score")),
        "positives")
    windows = chosen.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_set("positive_score")).alias("windows"))
    asking = anchors.select("row", "label", "dimensions", "vector").join(windows, "row")
    hard = _grid(plain, asking, ["dimensions"], n, m, _negatives(negatives, low_percent, ROW_BLOCK, ANCHOR_BLOCK),
                 NEGATIVE)
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative")
    best = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(chosen, ["anchor", "positive_score"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

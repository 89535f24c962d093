"""SimHash near-duplicates through segment popcounts.

A fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within d bits lie
within d in the grid of counts. The segments form d + 2 blocks; within distance d at least two blocks
have equal counts, so a range join over the grid is an equality join over the counts of two blocks.
Members of a cell are compared by Manhattan distance, the rest bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake.llm.common import carried, components, tasks, texts, written

LOW_BITS = 0x5555555555555555
TILE = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bits set in more than half of the XXH64 of all word shingles, repeats included."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:max(1, len(tokens) - words + 1)].tolist()
    ends = ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(distance: int) -> list[int]:
    """Masks of distance + 2 blocks of whole two-bit segments, of nearly equal width."""
    edges = [32 * i // (distance + 2) for i in range(distance + 3)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def cells(classes: DataFrame, distance: int) -> DataFrame:
    """(cell_table, cell, fp): every fingerprint once in each pair of blocks, keyed by its counts."""
    counts = F.expr(f"((fp ^ shiftrightunsigned(fp, 1)) & {LOW_BITS}L)"
                    f" | shiftleft(fp & shiftrightunsigned(fp, 1) & {LOW_BITS}L, 1)")
    pairs = [a | b for a, b in combinations(block_masks(distance), 2)]
    keys = [F.struct(F.lit(i).alias("cell_table"), F.col("counts").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("cell"))
            for i, m in enumerate(pairs)]
    return classes.select("fp", counts.alias("counts")).select("fp", F.explode(F.array(*keys)).alias("k")).select(
        "k.cell_table", "k.cell", "fp")


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """Adds (left, right) tiles: a cell over the tile size is compared tile by tile.

    A member of a cell of t tiles goes to the t pairs that hold its own tile, so every two members
    meet in some pair, and no pair holds more than about two tiles.
    """
    large = members.groupBy("cell_table", "cell").agg(F.count(F.lit(1)).alias("held")).where(
        F.col("held") > tile).select("cell_table", "cell", F.ceil(F.col("held") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    marked = members.join(large, ["cell_table", "cell"], "left").withColumn(
        "tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return marked.select("cell_table", "cell", "fp", "own", other.alias("other")).select(
        "cell_table", "cell", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value it reaches) that join the same values as the edges (a, b)."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new[label]]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


class Linker:
    """Compares members of one cell and tile pair, given sorted runs, and keeps a forest of links."""

    def __init__(self, distance: int, most: int = 500_000):
        self.distance, self.most, self.held, self.size = distance, most, [], 0

    def compare(self, run: np.ndarray, fp: np.ndarray) -> None:
        """Links within runs of equal ``run`` numbers; one shift of the whole array at a time."""
        counts = fp - ((fp >> np.uint64(1)) & np.uint64(LOW_BITS))
        unary = counts | ((counts >> np.uint64(1)) & np.uint64(LOW_BITS))
        left = np.arange(len(fp))
        for step in range(1, len(fp)):
            left = left[left + step < len(fp)]
            left = left[run[left] == run[left + step]]
            if not len(left):
                break
            near = left[np.bitwise_count(unary[left] ^ unary[left + step]) <= self.distance]
            near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= self.distance]
            if len(near):
                self.held.append((fp[near], fp[near + step]))
                self.size += len(near)
                if self.size > self.most:
                    self.shrink()

    def shrink(self) -> None:
        if self.held:
            self.held = [forest(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])
            self.most = max(self.most, 2 * self.size)

    def links(self) -> pa.RecordBatch:
        self.shrink()
        a, b = self.held[0] if self.held else (np.array([], np.uint64),) * 2
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(classes: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Edges that join exactly the fingerprints within ``distance`` bits, as forests of cells."""
    spark = classes.sparkSession
    keys = ["cell_table", "cell", "left", "right"]
    dealt = tiled(cells(classes, distance), tile).repartition(tasks(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, tail = Linker(distance), None
        for batch in batches:
            block = pa.Table.from_batches([batch])
            block = pa.concat_tables([tail, block]) if tail is not None else block
            part = [block.column(k).to_numpy() for k in keys]
            fp = block.column("fp").to_numpy().view(np.uint64)
            fresh = np.zeros(len(fp), bool)
            for column in part:
                fresh[1:] |= column[1:] != column[:-1]
            number = np.cumsum(fresh)
            last = int(np.searchsorted(number, number[-1])) if len(number) else 0
            linker.compare(number[:last], fp[:last])
            tail = block.slice(last)
            if linker.size > 200_000:
                yield linker.links()
        if tail is not None:
            linker.compare(np.zeros(len(tail), np.int64), tail.column("fp").to_numpy().view(np.uint64))
        yield linker.links()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _with_fingerprint(docs: DataFrame, words: int, text: str) -> DataFrame:
    """All columns and the fingerprint as column ``fp`` (must not be there yet)."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in texts(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))],
                                             names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root): classes of equal fingerprints, their least id, and what links lead to."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(links(classes.select("fp"), distance), "links")
    return classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id among the documents that links lead to.

    Equal fingerprints are one class, compared once, so copies form no pairs. Documents without
    words (null, empty) have fingerprint zero and link like any other. Null ids never are a
    component's id unless all of its ids are null; repeated rows stay rows. An empty table gives none.
    """
    prints = written(_with_fingerprint(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), words, "text").select(
        "doc_id", "fp"), "prints")
    named = _named(prints, distance)
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(roots, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The same columns, and of each component the row with the smallest id alone.

    Null ids stand after all others; of rows that repeat an id and a fingerprint one stays. Null and
    empty texts are alike. Other columns may have any names. An empty table stays empty.
    """
    packed, back = carried(docs)
    tagged = written(_with_fingerprint(packed, words, "text"), "tagged")
    prints = tagged.select("doc_id", "fp")
    named = _named(prints, distance)
    first = F.struct(F.col("first").isNull().alias("missing"), "first", "fp")
    keepers = named.groupBy("root").agg(F.min(first).alias("k")).select(
        F.col("k.first").alias("keep_id"), F.col("k.fp").alias("keep_fp"))
    kept = tagged.join(keepers, (F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return back(kept.dropDuplicates(["fp", "doc_id"]))

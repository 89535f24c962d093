"""Phrase collocations by direct-address tiles of frequency-ranked ids, level by level.

Level 1 are the words. Items of a level that occur often enough are ranked by falling frequency, and
every text becomes a sequence of those ranks. Two items of level k that start at neighbouring words
overlap in all but their ends, so a pair of them is a phrase of k + 1 words: pairs are counted in square
tiles of the id plane. Tiles with many occurrences near the origin are counted densely (one bincount
cell a pair), the others as sorted coordinates; the frequent pairs are ranked again and are the items
of the next level. Texts are worked on in chunks; a chunk keeps its own codes for what it holds and
learns the ids of the frequent ones by a join, so no dictionary is broadcast or held whole anywhere.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm.common import removed, texts, written, written_at

CHUNK_BYTES = 12_000_000
TILE_BITS = 10
DENSE = 1 << 18
BREAK = b"."
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"........." + b" ")
WORDS = "chunk bigint, lang string, key string, code int, held bigint, codes binary"
# pairs come in order of their ranks: small differences, and few bytes
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
PAIRS = "chunk bigint, x bigint, y bigint, code int, held bigint, codes binary"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with a break mark (which no word can be) where pieces end."""
    return text.lower().translate(_TABLE).replace(BREAK, b" . ").split()


def packed(codes: np.ndarray) -> bytes:
    """Bytes of 32-bit codes, all first bytes before all second ones: the high ones compress."""
    return np.ascontiguousarray(codes.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def dictionaries(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of one lang: one row a distinct word, and one row with the codes of all words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[str, tuple[defaultdict, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (known, parts) in held.items():
                chunk = next(numbers)
                del known[BREAK]
                codes = np.concatenate(parts)
                counts = np.bincount(codes[codes >= 0], minlength=len(known))
                n = len(known)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(chunk, pa.int64()), n + 1), pa.repeat(pa.scalar(lang, pa.string()), n + 1),
                     pa.array([*known, None], pa.binary()).cast(pa.string()),
                     pa.array([*range(n), None], pa.int32()), pa.array([*counts.tolist(), None], pa.int64()),
                     pa.array([None] * n + [packed(codes)], pa.binary())],
                    names=["chunk", "lang", "key", "code", "held", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if lang not in held:
                    known = defaultdict(itertools.count().__next__)
                    known[BREAK] = -1
                    held[lang] = known, []
                known, parts = held[lang]
                words = tokens(text)
                words.append(BREAK)
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(text)
                if size >= chunk_bytes:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, WORDS)


def count_pairs(x: np.ndarray, y: np.ndarray, tile_bits: int = TILE_BITS,
                dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of non-negative ranks as (x, y, count), and the place of each occurrence among them."""
    import pandas as pd

    side = 1 << tile_bits
    at, tiles = pd.factorize((x.astype(np.int64) >> tile_bits) << 32 | y.astype(np.int64) >> tile_bits)
    occurrences = np.bincount(at, minlength=len(tiles))
    place = np.empty(len(x), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    known = 0
    for t in np.flatnonzero(occurrences >= dense):
        rows = np.flatnonzero(at == t)
        cells = (x[rows] & side - 1).astype(np.int64) << tile_bits | y[rows] & side - 1
        counts = np.bincount(cells, minlength=side * side)
        cell = np.flatnonzero(counts)
        number = np.empty(side * side, np.int64)
        number[cell] = known + np.arange(len(cell))
        place[rows] = number[cells]
        found.append(((tiles[t] >> 32 << tile_bits) + (cell >> tile_bits),
                      ((tiles[t] & 0xFFFFFFFF) << tile_bits) + (cell & side - 1), counts[cell]))
        known += len(cell)
    rows = np.flatnonzero(occurrences[at] < dense) if len(x) else np.empty(0, np.int64)
    pairs, inverse, counts = np.unique(x[rows].astype(np.int64) << 32 | y[rows], return_inverse=True, return_counts=True)
    place[rows] = known + inverse
    found.append((pairs >> 32, pairs & 0xFFFFFFFF, counts))
    return *(np.concatenate(c) for c in zip(*found)), place


def _next_level(last: bool):
    """From a chunk's codes of one level, and the ids of its frequent items, to the pairs of the next."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        codes = np.concatenate([unpacked(v.as_py()) for v in left.column("codes")] or [np.empty(0, np.int32)])
        code, ids = right.column("code").to_numpy(), right.column("id").to_numpy()
        # ranks of the items that the chunk holds, the most frequent of all chunks first
        order = np.lexsort((ids, -right.column("f").to_numpy()))
        ids = ids[order]
        rank = np.full(max(int(codes.max(initial=-1)), int(code.max(initial=-1))) + 2, -1, np.int32)
        rank[code[order]] = np.arange(len(order))
        items = rank[codes]  # code -1 reads the last entry, which is -1
        starts = np.flatnonzero((items[:-1] >= 0) & (items[1:] >= 0))
        x, y, counts, place = count_pairs(items[starts], items[starts + 1])
        n = len(x)
        keep = 0 if last or not n else 1
        raw = []
        if keep:
            after = np.full(len(codes), -1, np.int32)
            after[starts] = place
            raw = [packed(after)]
        none = [None] * keep
        return pa.table({
            "chunk": pa.repeat(pa.scalar(chunk, pa.int64()), n + keep),
            "x": pa.concat_arrays([pa.array(ids[x], pa.int64()), pa.array(none, pa.int64())]),
            "y": pa.concat_arrays([pa.array(ids[y], pa.int64()), pa.array(none, pa.int64())]),
            "code": pa.concat_arrays([pa.array(np.arange(n), pa.int32()), pa.array(none, pa.int32())]),
            "held": pa.concat_arrays([pa.array(counts, pa.int64()), pa.array(none, pa.int64())]),
            "codes": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(raw, pa.binary())])})
    return run


def counted(state: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Every chunk's row of the items that occur ``least`` times in all chunks, with that frequency ``f``
    and an id that the rows of one item share; ``own`` marks one row of each."""
    # rows are numbered once they have met: the numbers need not travel with them
    rows = state.where("codes is null").select("chunk", *keys, "code", "held").repartition(*keys).withColumn(
        "row", F.monotonically_increasing_id())
    alike = Window.partitionBy(*keys)
    return rows.withColumn("f", F.sum("held").over(alike)).withColumn("id", F.min("row").over(alike)).where(
        F.col("f") >= least).select("chunk", *keys, "code", "f", "id", (F.col("row") == F.col("id")).alias("own"))


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, top: int = 2000, share: int = 80,
                 scale: int = 2_000_000, lang: str = "lang", text: str = "text",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of 2 to ``most_words`` words.

    A phrase counts all its contiguous occurrences within pieces of the whole texts (a); at least
    ``least`` make it a candidate. Its score is the smallest of floor(scale a / (l + r)) over its cuts
    in two parts that occur l and r times. A candidate inside a longer one with at least ``share``
    percent of its occurrences is dropped. n counts all words of the lang.

    A null lang is ``und``, a null or empty text has no words; repeated rows count as often as they
    are there; ids and other columns are not read. Ties are ordered by a, then the phrase's bytes. A
    lang without candidates, and an empty table, give no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    state, path = written_at(dictionaries(rows, chunk_bytes), "phrase-words", compression="zstd")
    keys = ["lang", "key"]
    n = written(state.where("codes is null").groupBy("lang").agg(F.sum("held").alias("n")), "phrase-totals")
    found = None
    for words in range(1, most_words + 1):
        spent = [path]
        if words < most_words:
            items, items_path = written_at(counted(state, keys, least), f"phrase-items{words}", **COMPACT)
            frequent = items.where("own").select(*keys, "f", "id")
            spent.append(items_path)
        else:  # no text learns these, so any number will do
            frequent = state.groupBy(*keys).agg(F.sum("held").alias("f")).where(F.col("f") >= least).withColumn(
                "id", F.monotonically_increasing_id())
        if words == 1:
            level = frequent.select(
                "lang", "id", "f", F.col("key").alias("phrase"), F.col("key").alias("final"),
                F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
        else:
            frequent = written(frequent, f"phrase-frequent{words}")
            first = below.select("lang", F.col("id").alias("x"), F.col("phrase").alias("start"), "heads", F.col("f").alias("head"))
            rest = below.select(F.col("id").alias("y"), "final", "tails", F.col("f").alias("tail"))
            level = frequent.join(first, "x").join(rest, "y").select(
                "lang", "id", "f", F.concat_ws(" ", "start", "final").alias("phrase"), "final",
                F.concat("heads", F.array("head")).alias("heads"), F.concat(F.array("tail"), "tails").alias("tails"))
            if words > 2:
                longer = frequent.select(F.col("x").alias("id"), "f").union(
                    frequent.select(F.col("y").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
                found = _kept(below, longer, share, found)
        below = written(level, f"phrase-level{words}")
        if words < most_words:
            learnt = items.select("chunk", "code", "f", "id")
            codes = state.where("codes is not null").select("chunk", "codes")
            state, path = written_at(codes.groupBy("chunk").cogroup(learnt.groupBy("chunk")).applyInArrow(
                _next_level(words + 1 == most_words), PAIRS), f"phrase-pairs{words + 1}", **COMPACT)
            keys = ["x", "y"]
        for old in spent:
            removed(docs.sparkSession, old)
    found = below if found is None else found.unionByName(below)
    cut = F.expr(f"""array_min(transform(sequence(0, size(heads) - 1), i -> named_struct(
        'score', (cast({scale} as decimal(19,0)) * cast(f as decimal(18,0))) div
                 (cast(heads[i] as decimal(20,0)) + cast(tails[i] as decimal(20,0))),
        'i', i, 'l', heads[i], 'r', tails[i])))""")
    scored = found.withColumn("cut", cut).select(
        "lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").cast("bigint").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _kept(level: DataFrame, longer: DataFrame, share: int, found: DataFrame | None) -> DataFrame:
    """The phrases of a level that no longer phrase covers, after those found so far.

    A phrase inside a candidate of several more words lies in one of a single word more that occurs at
    least as often as the candidate, so the next level decides.
    """
    left = level.join(longer, "id", "left").where(F.expr(
        f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(f as decimal(20,0)) * {share}")).drop("longer")
    return left if found is None else found.unionByName(left)

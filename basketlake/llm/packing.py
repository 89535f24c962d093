"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents are cut into pieces of at most ``capacity`` ids. Full pieces are sequences by themselves.
The others are dealt by length to groups of bounded size, each packed by best-fit decreasing and given a lower
bound: the largest sum of a dual-feasible function over its lengths. Groups whose bins exceed their
bound exchange their documents over new groups and pack again; then bins that are not full are
exchanged among all groups. Rounds end when all bins together meet the bound of all lengths, or when
a round saves none.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.bpe import SegmentMemo, load_ranks, text_values
from basketlake.llm.common import written
from basketlake.llm.sharding import numbered

PIECE = ("key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
PACKED = PIECE + ", sequence_id bigint, offset bigint, waste bigint, gap bigint"
END_ID = 2


def added_tokens(json_path: str) -> dict[str, int]:
    """Strings and ids of the tokens that a tokenizer file adds to its vocabulary."""
    with open(json_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def rank_file_encoder(ranks_path: str, pattern: str,
                      special: dict[str, int] | None = None) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """Makes, in a worker, a function from pieces of text to their ids as little-endian integers.

    A piece that is a string of ``special`` has its id; the pieces of a text must be cut at those
    strings. Without it they are ordinary text.
    """
    special = special or {}

    def make() -> Callable[[list[str]], list[bytes]]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path),
                                   special_tokens={})._core_bpe.encode_ordinary

        def little(ids: list[int]) -> bytes:
            packed = array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            return packed.tobytes()

        return lambda pieces: [little([special[p]] if p in special else encode(p)) for p in pieces]

    make.special = tuple(special)
    return make


def piece_memo(make_encoder) -> SegmentMemo:
    return SegmentMemo(make_encoder(), getattr(make_encoder, "special", ()))


def cut(raw: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc) of the pieces of one document's ids; only the first may be shorter."""
    total = len(raw) // 4
    first = total if total <= capacity else total % capacity or capacity
    starts = [0, *range(first, total, capacity)] if total else []
    ends = [*starts[1:], total]
    return [(s, e - s, zlib.crc32(raw[4 * s:4 * e])) for s, e in zip(starts, ends)]


def pieces_of(docs: DataFrame, make_encoder, capacity: int = 1024, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """The pieces of every row's whole text and its end id, each with a key of its own."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(make_encoder)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rows = [], []
            for i, values in enumerate(text_values([v.as_py() or "" for v in batch.column(1)], memo)):
                for p, (start, length, crc) in enumerate(cut(b"".join(values) + end, capacity)):
                    ids.append(i)
                    rows.append((key, p, start, length, crc))
                    key += 1
            keys, piece, start, length, crc = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).take(pa.array(ids, pa.int64())),
                 pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                names=["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, PIECE)


def lower_bound(counts: np.ndarray, capacity: int, steps: int = 60) -> int:
    """Bins that any packing needs: the best sum of dual-feasible functions of the lengths.

    ``counts[s]`` items have length s. One family drops lengths below t and rounds lengths over
    capacity - t up to a whole bin; the other rounds a length down to multiples of capacity / k
    unless it is a multiple of capacity / (k + 1). Both, and the second after the first, keep the
    values of any items that fit a bin together at one bin or less.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    thresholds = np.arange(0, capacity // 2 + 1)
    kept = np.where(sizes > capacity - thresholds[:, None], capacity,
                    np.where(sizes >= thresholds[:, None], sizes, 0))
    best = max(best, int((-(-(kept * counts).sum(axis=1) // capacity)).max()))
    for k in range(1, steps + 1):
        scaled = (k + 1) * kept
        # in units of capacity * k, so that both branches are whole numbers
        rounded = np.where(scaled % capacity == 0, kept * k, scaled // capacity * capacity)
        best = max(best, int((-(-(rounded * counts).sum(axis=1) // (capacity * k))).max()))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the room left in each bin; longest first, tightest bin first.

    Bins are kept by the room they have left, and a bit set of rooms finds the tightest that fits.
    """
    where, offsets = [0] * len(lengths), [0] * len(lengths)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[at]
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[left].pop()
            if not by_room[left]:
                rooms &= ~(1 << left)
        else:
            chosen, left = len(room), capacity
            room.append(capacity)
        where[at], offsets[at] = chosen, capacity - left
        left -= size
        room[chosen] = left
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return where, offsets, room


def _pack_group(capacity: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        where, offsets, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        first = turn << 56 | table.column("part")[0].as_py() << 24
        out = table.select(["key", "doc_id", "piece", "start", "length", "ids_crc32"])
        for name, values in (("sequence_id", [first + b for b in where]), ("offset", offsets),
                             ("waste", [room[b] for b in where]), ("gap", [len(room) - bound] * len(where))):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out
    return run


def _bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def _histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces by length: capacity numbers, whatever the number of pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return counts


def _dealt(pieces: DataFrame, histogram: np.ndarray, parts: int) -> DataFrame:
    """Pieces dealt in turn by length: every part gets the lengths of all in nearly equal shares."""
    starts = np.cumsum(histogram) - histogram
    firsts = F.array(*[F.lit(int(n)) for n in starts])
    rows = pieces.select("key", "doc_id", "piece", "start", "length", "ids_crc32")
    slots = numbered(rows, "length", ["key"], buckets=max(16, int(histogram.sum()) // 100_000))
    return slots.withColumn("part", F.pmod(F.element_at(firsts, (F.col("length") + 1).cast("int")) + F.col("slot"),
                                           F.lit(parts))).drop("slot")


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_items: int = 50_000,
                most_rounds: int = 8) -> DataFrame:
    """Every piece with a sequence and its place there, gapless from 0; as few sequences as found.

    ``pieces`` must be a stored table (keys are read again). No group holds more than about 16 times
    ``group_items`` pieces, however many there are; hot documents do not matter, since pieces are
    dealt by key. An empty table gives an empty result.
    """
    whole = pieces.where(F.col("length") == capacity).selectExpr(
        "*", "-key - 1 as sequence_id", "cast(0 as bigint) as offset", "cast(0 as bigint) as waste",
        "cast(0 as bigint) as gap")
    short = pieces.where(F.col("length") < capacity)
    histogram = _histogram(short, capacity)
    bound, settled, total = lower_bound(histogram, capacity), [whole], 0
    moving, held, size = short, int(histogram.sum()), group_items
    open_bins: int | None = None
    previous: DataFrame | None = None
    loosened = False
    for turn in range(most_rounds):
        if not held:
            break
        dealt = _dealt(moving, histogram, -(-held // size))
        packed = written(dealt.groupBy("part").applyInArrow(_pack_group(capacity, turn), PACKED), f"packed{turn}")
        bins = _bins(packed)
        saved = open_bins is None or bins < open_bins
        if not saved:
            packed, bins = previous, open_bins  # what was there before stays
            if loosened:
                break
        previous = packed
        if total + bins <= bound:
            break
        # groups above their bound exchange all their pieces, over fewer and larger groups; once none
        # is, or that saves nothing, bins that are not full are exchanged among all groups
        loosened = not saved or packed.where("gap > 0").isEmpty()
        rule = F.col("waste") > 0 if loosened else F.col("gap") > 0
        kept = packed.where(~rule)
        settled.append(kept)
        total += _bins(kept)
        previous = moving = packed.where(rule)
        open_bins = _bins(moving)
        histogram = _histogram(moving, capacity)
        held = int(histogram.sum())
        size = min(2 * size, 16 * group_items)
    if previous is not None:
        settled.append(previous)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, make_encoder, capacity: int = 1024, group_items: int = 50_000,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences.

    A null text is an empty one (its end id alone); repeated rows and null ids are packed like any
    other; only the two named columns are read.
    """
    return pack_pieces(written(pieces_of(docs, make_encoder, capacity, doc_id, text), "pieces"),
                       capacity, group_items)

"""Packing by minimum bin slack: every window takes the multiset of remaining lengths nearest to its room.

Documents are cut into full windows and a rest. The rests of a group of bounded size are a multiset of
lengths. A window starts with the longest one; a subset-sum table over the remaining lengths, a bit set
of reachable sums built up length by length, gives the sum nearest to the room that is left, and walking
back through the bit sets gives how many of each length make it. Where no multiset fills the room,
the longest document left is cut to fill it. What a group's last window holds goes to the groups of the
next level, and at the last level to windows of powers of two, which take no padding: no token of
padding is left at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.bpe import text_values
from basketlake.llm.common import written
from basketlake.llm.packing import piece_memo

END_ID = 1
PIECE = ("key bigint, doc_id bigint, text_hash bigint, text_check int, start bigint, length bigint, "
         "ids_crc32 bigint, doc_tokens bigint")
NAMES = [f.split()[0] for f in PIECE.split(", ")]
PACKED = PIECE + ", sequence_id bigint, offset bigint"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, whole text (null: empty) and hashes of both, by which equal rows can be found again."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("text_hash"),
                       F.hash("text", F.lit(7)).alias("text_check"))


def pieces_of(rows: DataFrame, make_encoder, capacity: int) -> DataFrame:
    """Full windows and the rest of every row's ids and its end id; each piece has a key of its own."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(make_encoder)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, keys, start, length, crc, whole = [], [], [], [], [], []
            for i, values in enumerate(text_values([v.as_py() or "" for v in batch.column(1)], memo)):
                raw = b"".join(values) + end
                total = len(raw) // 4
                for a in range(0, total, capacity):
                    n = min(capacity, total - a)
                    owner.append(i)
                    keys.append(key)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * a:4 * (a + n)]))
                    whole.append(total)
                    key += 1
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *(batch.column(c).take(at) for c in (0, 2, 3)),
                 *(pa.array(c, pa.int64()) for c in (start, length, crc, whole))], names=NAMES)

    return rows.mapInArrow(run, PIECE)


def nearest_multiset(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How many of each length to take for the largest sum that is not over ``room``.

    ``lengths`` falls. Each length enters the table in parts of 1, 2, 4, ... copies; a bit set of
    reachable sums is kept before each part, and the table ends early once the room itself is reached.
    """
    reach, mask, goal = 1, (1 << room + 1) - 1, 1 << room
    parts: list[tuple[int, int, int]] = []
    for length, count in zip(lengths, counts):
        if length > room:
            continue
        count, size = min(count, room // length), 1
        while count > 0:
            copies = min(size, count)
            parts.append((length, copies, reach))
            reach |= reach << length * copies & mask
            count -= copies
            size *= 2
        if reach & goal:
            break
    best = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, copies, before in reversed(parts):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + copies
            best -= length * copies
    return taken


class Remaining:
    """Pieces that are not packed yet, by length: (row, start, length, whether cut here)."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]]):
        self.by_length: dict[int, list] = {}
        for piece in reversed(pieces):
            self.by_length.setdefault(piece[2], []).append(piece)
        self.lengths = sorted(self.by_length, reverse=True)

    def take(self, length: int) -> tuple[int, int, int, bool]:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            del self.by_length[length]
            self.lengths.remove(length)
        return piece

    def put(self, piece: tuple[int, int, int, bool]) -> None:
        if piece[2] not in self.by_length:
            self.by_length[piece[2]] = []
            self.lengths = sorted(self.by_length, reverse=True)
        self.by_length[piece[2]].append(piece)


def windows(pieces: list[tuple[int, int, int, bool]], capacity: int, last: bool) -> tuple[list[list], list]:
    """Filled windows of pieces, and the pieces of a window that stays open (none if ``last``)."""
    left, out = Remaining(pieces), []
    while left.lengths:
        window = [left.take(left.lengths[0])]
        room = capacity - window[0][2]
        taken = nearest_multiset(left.lengths, [len(left.by_length[n]) for n in left.lengths], room) if room else {}
        for length, copies in taken.items():
            window += [left.take(length) for _ in range(copies)]
            room -= length * copies
        if room and left.lengths:
            # every piece left is longer than the room, or it would have been taken
            row, start, length, _ = left.take(left.lengths[0])
            window.append((row, start, room, True))
            left.put((row, start + room, length - room, True))
            room = 0
        if room:
            return (out + powers_of_two(window, capacity), []) if last else (out, window)
        out.append(window)
    return out, []


def powers_of_two(window: list[tuple[int, int, int, bool]], capacity: int) -> list[list]:
    """The pieces cut into windows whose lengths are the powers of two that make up their total."""
    total = sum(p[2] for p in window)
    sizes = [1 << b for b in reversed(range(capacity.bit_length())) if total >> b & 1]
    out, pieces = [], list(reversed(window))
    for size in sizes:
        own, room = [], size
        while room:
            row, start, length, cut = pieces.pop()
            if length > room:
                pieces.append((row, start + room, length - room, True))
                length, cut = room, True
            own.append((row, start, length, cut))
            room -= length
        out.append(own)
    return out


def _pack_group(capacity: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        first = level << 56 | table.column("part")[0].as_py() << 24
        rows = table.select(NAMES).combine_chunks()
        start, length, key = (rows.column(n).to_pylist() for n in ("start", "length", "key"))
        order = sorted(range(len(key)), key=lambda i: (key[i], start[i]))
        filled, rest = windows([(i, start[i], length[i], False) for i in order], capacity, last)
        row, starts, lengths, cut, sequence, offset = [], [], [], [], [], []
        for number, window in enumerate(filled):
            at = 0
            for i, a, n, is_cut in window:
                row.append(i)
                starts.append(a)
                lengths.append(n)
                cut.append(is_cut)
                sequence.append(first + number)
                offset.append(at)
                at += n
        for i, a, n, is_cut in rest:
            row.append(i)
            starts.append(a)
            lengths.append(n)
            cut.append(is_cut)
            sequence.append(None)
            offset.append(None)
        out = rows.take(pa.array(row, pa.int64()))
        crc = pa.array([None if c else v for c, v in zip(cut, out.column("ids_crc32").to_pylist())], pa.int64())
        for name, values in (("start", pa.array(starts, pa.int64())), ("length", pa.array(lengths, pa.int64())),
                             ("ids_crc32", crc)):
            out = out.set_column(NAMES.index(name), name, values)
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64()))
    return run


def pack_pieces(pieces: DataFrame, capacity: int, group_items: int) -> DataFrame:
    """Every piece (those that had to be cut: in parts without a checksum) with its window and place.

    ``pieces`` must be a stored table. Groups are dealt by a hash of the pieces' keys and hold about
    ``group_items``; a level leaves less than one window a group to the next.
    """
    settled = pieces.where(F.col("length") == capacity).selectExpr("*", "-key - 1 as sequence_id", "cast(0 as bigint) as offset")
    moving = pieces.where(F.col("length") < capacity)
    held, level = moving.count(), 0
    while held:
        groups = -(-held // group_items)
        dealt = moving.withColumn("part", F.pmod(F.xxhash64("key", "start", F.lit(level)), F.lit(groups)))
        packed = written(dealt.groupBy("part").applyInArrow(_pack_group(capacity, level, groups == 1), PACKED),
                         f"slack{level}")
        settled = settled.unionByName(packed.where("sequence_id is not null"))
        moving = packed.where("sequence_id is null").drop("sequence_id", "offset")
        held, level = (moving.count() if groups > 1 else 0), level + 1
    return settled


def cut_checksums(rows: DataFrame, cuts: DataFrame, make_encoder) -> DataFrame:
    """(text_hash, text_check, start, length, cut_crc32) of the pieces cut while packing.

    Only the documents that were cut are encoded again, each distinct one once.
    """
    key = ["text_hash", "text_check"]
    wanted = cuts.select(*key).distinct()
    found = rows.join(wanted, key, "left_semi").groupBy(*key).agg(F.min("text").alias("text"))
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(make_encoder)
        for batch in batches:
            ids = [b"".join(v) + end for v in text_values([t.as_py() for t in batch.column(2)], memo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=[*key, "ids"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(raw.as_py()) for raw in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())],
                                             names=[*key, "start", "length", "cut_crc32"])

    ids = found.mapInArrow(encode, "text_hash bigint, text_check int, ids binary")
    own = cuts.select(*key, "start", "length").distinct().join(ids, key).select(
        *key, "start", "length", F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"))
    return own.mapInArrow(check, "text_hash bigint, text_check int, start bigint, length bigint, cut_crc32 bigint")


def pack_documents(docs: DataFrame, make_encoder, capacity: int = 2048, group_items: int = 20_000,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Windows hold ``capacity`` ids (a power of two), but for a few whose lengths are smaller powers of
    two. A null text is an empty one: its end id alone. Repeated rows and null ids are packed like any
    other; only the two named columns are read. An empty table gives an empty result.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    rows = keyed(docs, doc_id, text)
    packed = pack_pieces(written(pieces_of(rows, make_encoder, capacity), "slack-pieces"), capacity, group_items)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cuts = packed.where("ids_crc32 is null")
    if cuts.isEmpty():
        return packed.select(*columns)
    checks = cut_checksums(rows, cuts, make_encoder)
    mended = cuts.drop("ids_crc32").join(checks, ["text_hash", "text_check", "start", "length"]).withColumnRenamed(
        "cut_crc32", "ids_crc32")
    return packed.where("ids_crc32 is not null").select(*columns).unionByName(mended.select(*columns))

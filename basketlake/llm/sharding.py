"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level a document draws an exponential variate for each child, -ln(u) / weight with u hashed
from the document id and the child's name, and descends into the smallest. A child is taken with
probability weight / sum of weights, and changing one weight changes only that child's draw, so rows
move only into (or out of) the subtrees whose weights change. A new shard opens a region of its own:
it is the only subtree whose weight changes, so growing takes rows into the new shard and nowhere else.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlake.llm.common import written

OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(count: int, base: int = 40, rack: int = 5, region: int = 10) -> list[Leaf]:
    """``base`` shards in racks and regions; each later shard is a region of one rack and one shard."""
    leaves = [Leaf(f"region{s // region}", f"rack{s // rack}", s) for s in range(min(count, base))]
    return leaves + [Leaf(f"grown{s}", f"grown{s}", s) for s in range(base, count)]


def _draw(key: Column, name: str, weight: float) -> Column:
    hashed = F.xxhash64(key, F.lit(name))
    unit = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    return -F.log(unit) / F.lit(float(weight))


def _winner(key: Column, level: str, children: dict[object, float]) -> Column:
    drawn = [F.struct(_draw(key, f"{level}:{name}", weight).alias("draw"), F.lit(name).alias("name"))
             for name, weight in sorted(children.items(), key=str)]
    return F.array_min(F.array(*drawn))["name"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that a key falls to; a null key is a key like any other. Weights of 0 take no rows."""
    regions: dict[str, float] = defaultdict(float)
    racks: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[tuple[str, str], dict[int, float]] = defaultdict(dict)
    for leaf in leaves:
        if leaf.weight > 0:
            regions[leaf.region] += leaf.weight
            racks[leaf.region][leaf.rack] += leaf.weight
            shards[leaf.region, leaf.rack][leaf.shard] = leaf.weight
    region = _winner(key, "region", regions)

    def rack_in(name: str) -> Column:
        rack = _winner(key, f"rack:{name}", racks[name])
        chosen = F.lit(None).cast("int")
        for inner in racks[name]:
            chosen = F.when(rack == inner, _winner(key, f"shard:{name}:{inner}", shards[name, inner])
                            ).otherwise(chosen)
        return chosen

    out = F.lit(None).cast("int")
    for name in regions:
        out = F.when(region == name, rack_in(name)).otherwise(out)
    return out


def numbered(frame: DataFrame, group: str, order: list[str], buckets: int = 1024,
             groups: int | None = None) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each group, without sorting a whole group in one task.

    Rows are counted by (group, hash bucket of the order columns); the few counts give each bucket
    its first number, and only a bucket's rows are ranked together. Equal rows take any order.
    ``groups``, where given, bounds the counts, which are then broadcast.
    """
    rows = frame.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(group, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order))
    # groups x buckets rows at most: the broadcast does not grow with the documents
    firsts = F.broadcast(firsts) if groups and groups * buckets <= 100_000 else firsts
    return rows.withColumn("rank", rank).join(firsts, [group, "bucket"]).withColumn(
        "slot", F.col("first") + F.col("rank") - 1).drop("bucket", "first", "rank")


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row; other columns are left.

    Null texts have no bytes (size 16, crc of nothing); a null id is a key of its own; repeated rows
    stay rows and take neighbouring slots. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), leaves)).withColumn(
        "grown_shard", shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"))
    return numbered(written(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"],
                    groups=len(grown or leaves))

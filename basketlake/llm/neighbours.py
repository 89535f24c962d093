"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected to principal axes and rotated so that their signs lose least
(iterative quantisation, fitted on a bounded sample); signs are the bits of a code. Each code is cut
into substrings, one table each. A vector lies in the cells of all values within one bit of its
substring, so two vectors meet wherever a substring differs in at most two bits. Pairs that meet are
reranked by the cosine of the original vectors in double precision. Every vector is indexed; the
length of substrings follows the logarithm of their number, and the number of tables follows from the
chance that a pair at the threshold shares a cell, so the expected recall does not fall with size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import components, tasks, written

SAMPLE = 10_000
MISS = 0.02
TILE = 2048


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # squares of extreme numbers stay finite
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Vectors with a direction: not null or empty, all components finite, not all zero."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))


def fit_rotations(sample: np.ndarray, bits: int, rotations: int, rounds: int = 40, seed: int = 5):
    """(mean, [projection]): each projection is the principal axes times a learnt rotation.

    Rounds alternate between the nearest binary codes of the rotated sample and the orthogonal
    rotation that brings the sample nearest to its codes. Rotations differ by their random starts.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    projected = centred @ axes
    found = []
    for _ in range(rotations):
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ codes)
            rotation = left @ right
        found.append(axes @ rotation)
    return mean, found


def layout(vectors: int, dimensions: int, threshold: float) -> tuple[int, int, int]:
    """(code bits, substring bits, rotations) for so many vectors.

    A bit differs with chance angle / pi; a tenth more is allowed for the centring. Tables are added
    until a pair at the threshold is missed by all with a chance of at most ``MISS``.
    """
    bits = min(64, dimensions)
    width = min(bits, max(16, math.ceil(math.log2(max(2, vectors)))))
    p = min(0.5, 1.1 * math.acos(max(-1.0, min(1.0, threshold))) / math.pi)
    meets = sum(math.comb(width, k) * p ** k * (1 - p) ** (width - k) for k in range(min(2, width) + 1))
    tables = 1 if meets >= 1 else math.ceil(math.log(MISS) / math.log(1 - meets))
    return bits, width, max(1, math.ceil(tables / (bits // width)))


def _codes(classes: DataFrame, model, bits: int) -> DataFrame:
    """(class_id, code0, code1, ...): one signed 64-bit code for each rotation."""
    names = [f"code{i}" for i in range(len(model[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projections = model
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column(1)) - mean
            codes = [((rows @ p >= 0) * weights).sum(axis=1, dtype=np.uint64).view(np.int64) for p in projections]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, codes)], names=["class_id", *names])

    return classes.select("class_id", "vector").mapInArrow(
        run, "class_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def _members(codes: DataFrame, bits: int, width: int) -> DataFrame:
    """(cell_table, cell, class_id, codes): a vector at every value within a bit of each substring."""
    names = [c for c in codes.columns if c != "class_id"]
    per = bits // width
    mask = (1 << width) - 1
    subs = [F.struct(F.lit(r * per + t).alias("cell_table"),
                     F.shiftrightunsigned(F.col(n), t * width).bitwiseAND(F.lit(mask).cast("bigint")).alias("sub"))
            for r, n in enumerate(names) for t in range(per)]
    flips = F.array(*[F.lit(f).cast("bigint") for f in [0, *(1 << i for i in range(width))]])
    rows = codes.withColumn("s", F.explode(F.array(*subs))).withColumn("flip", F.explode(flips))
    return rows.select("s.cell_table", F.col("s.sub").bitwiseXOR(F.col("flip")).alias("cell"), "class_id", *names)


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """Splits cells over the tile size into pairs of tiles, in which every two members meet once."""
    large = members.groupBy("cell_table", "cell").agg(F.count(F.lit(1)).alias("held")).where(
        F.col("held") > tile).select("cell_table", "cell", F.ceil(F.col("held") / tile).cast("int").alias("tiles"))
    marked = members.join(large, ["cell_table", "cell"], "left").withColumn(
        "tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    spread = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return spread.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop(
        "tiles", "other")


def candidates(codes: DataFrame, bits: int, width: int, most_bits: int, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b) that share a cell and differ in at most ``most_bits`` of the first code.

    A pair is given out by one cell only: in the first table where its substrings are within two
    bits, the smallest value that is within one bit of both.
    """
    spark = codes.sparkSession
    names = [c for c in codes.columns if c != "class_id"]
    keys = ["cell_table", "cell", "left", "right"]
    dealt = _tiled(_members(codes, bits, width), tile).repartition(tasks(spark), *keys).sortWithinPartitions(*keys)
    per, mask = bits // width, np.uint64((1 << width) - 1)

    def pairs(block: pa.Table, run_: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, own = block.column("class_id").to_numpy(), block.column("own").to_numpy()
        left_tile, right_tile = block.column("left").to_numpy(), block.column("right").to_numpy()
        at_table, cell = block.column("cell_table").to_numpy(), block.column("cell").to_numpy().view(np.uint64)
        code = [block.column(n).to_numpy().view(np.uint64) for n in names]
        left, found, held = np.arange(len(ids)), [], 0
        for step in range(1, len(ids)):
            left = left[left + step < len(ids)]
            left = left[run_[left] == run_[left + step]]
            if not len(left):
                break
            right = left + step
            near = np.bitwise_count(code[0][left] ^ code[0][right]) <= most_bits
            # in a pair of two tiles, members of one tile have met in the pair of that tile with itself
            near &= (left_tile[left] == right_tile[left]) | (own[left] != own[right])
            a, b = left[near], right[near]
            first = np.full(len(a), -1)
            wanted = np.zeros(len(a), np.uint64)
            for t in range(len(names) * per):
                shift = np.uint64(t % per * width)
                x, y = (code[t // per][a] >> shift) & mask, (code[t // per][b] >> shift) & mask
                d = x ^ y
                low = d & (~d + np.uint64(1))
                met = (first < 0) & (np.bitwise_count(d) <= 2)
                first[met] = t
                common = np.where(np.bitwise_count(d) == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
                wanted[met] = common[met]
            good = (first == at_table[a]) & (wanted == cell[a])
            if good.any():
                found.append((np.minimum(ids[a[good]], ids[b[good]]), np.maximum(ids[a[good]], ids[b[good]])))
                held += int(good.sum())
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            block = pa.Table.from_batches([batch])
            block = pa.concat_tables([tail, block]) if tail is not None else block
            if not block.num_rows:
                continue
            fresh = np.zeros(block.num_rows, bool)
            for k in keys:
                column = block.column(k).to_numpy()
                fresh[1:] |= column[1:] != column[:-1]
            number = np.cumsum(fresh)
            last = int(np.searchsorted(number, number[-1]))
            yield from pairs(block.slice(0, last), number[:last])
            tail = block.slice(last)
        if tail is not None:
            yield from pairs(tail, np.zeros(tail.num_rows, np.int64))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _close(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose original vectors have at least that cosine, in double precision."""
    vectors = classes.select("class_id", "vector")
    both = pairs.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.einsum("ij,ij->i", unit_rows(batch.column(2)), unit_rows(batch.column(3)))
            keep = pa.array(np.flatnonzero(cosine >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def linked_pairs(classes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """Links between classes (class_id, vector, dimensions); vectors of other lengths never link."""
    found = None
    for row in classes.groupBy("dimensions").count().collect():  # one row a vector length
        own = classes.where(F.col("dimensions") == row["dimensions"])
        bits, width, rotations = layout(row["count"], row["dimensions"], threshold)
        sample = own.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vector").toArrow()
        model = fit_rotations(unit_rows(sample.column("vector").combine_chunks()), bits, rotations)
        codes = written(_codes(own, model, bits), "codes")
        # three deviations above the mean number of differing bits at the threshold
        p = 1.1 * math.acos(threshold) / math.pi
        most = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
        close = _close(candidates(codes, bits, width, most, tile), own, threshold)
        found = close if found is None else found.unionByName(close)
    return found if found is not None else classes.sparkSession.createDataFrame([], "a bigint, b bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
                 tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class, compared once; a member's links are the rest of its class and all
    members of linked classes. Rows without a usable direction have no links and are their own
    component, kept. Null ids are never another row's component id; repeated rows are separate
    vectors, kept if their id is the component's. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    good = rows.where(usable(F.col("vector")))
    classes = written(good.groupBy("vector").agg(
        F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("first")).select(
        F.monotonically_increasing_id().alias("class_id"), "vector", F.size("vector").alias("dimensions"),
        "members", "first"), "vectors")
    pairs = written(linked_pairs(classes, threshold, tile), "pairs")
    sizes = classes.select("class_id", "members")
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(
        pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    linked = both.join(sizes.toDF("other", "others"), "other").groupBy("class_id").agg(F.sum("others").alias("linked"))
    roots = components(pairs, "vector-links").toDF("class_id", "root")
    named = classes.join(linked, "class_id", "left").join(roots, "class_id", "left").withColumn(
        "root", F.coalesce("root", "class_id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select(
        "vector", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = good.join(labels, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                                        F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Shared pieces: table access, written intermediate tables, words, chunks and components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.session import shared_folder

MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


_RUNS: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; removed when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _RUNS:
        path = f"{shared_folder(spark)}/llm-{application}-{uuid.uuid4().hex[:8]}"
        _RUNS[application] = path

        def remove() -> None:
            jvm = spark.sparkContext._jvm
            if jvm is not None and spark.sparkContext._jsc is not None:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

        def quietly() -> None:
            try:
                remove()
            except Exception:  # noqa: BLE001  the session may already be gone
                pass

        atexit.register(quietly)
    return _RUNS[application]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_at(frame: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the cluster's shared folder, where its lineage ends, and its path.

    Once it is written nothing reads its shuffles again, so their files are removed then.
    """
    spark = frame.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path), path


def written(frame: DataFrame, name: str) -> DataFrame:
    return written_at(frame, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def carried(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The named columns with all others in one struct, so that no name clashes; and the way back."""
    columns = docs.columns
    others = [c for c in columns if c not in own]
    if not others:
        return docs, lambda out: out.select(*columns)
    packed = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried"))
    return packed, lambda out: out.select(*[
        F.col(c) if c in own else F.col(f"carried.`{c}`").alias(c) for c in columns])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, nulls as empty, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (splitmix); every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX
    h = h ^ (h >> np.uint64(27))
    h = h * MIX_2
    return h ^ (h >> np.uint64(31))


def utf8_crc(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node that an edge touches; root is the smallest node it reaches.

    ``edges`` has columns a and b of one orderable type. Large-star and small-star rounds: each is an
    aggregate by node and a join on it, so no neighbourhood is gathered in a task, and the number of
    rounds grows with the logarithm of the longest path. Each round is a written table. Without
    edges the result is empty; self-loops and repeated edges are ignored.
    """
    hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    stars = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("x"), "a", "m")
        stars = written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)
        now = stars.agg(F.count(F.lit(1)), hashed).first()
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))

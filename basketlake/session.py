"""Session defaults and the shared folder where stage tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "basketlake", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Adaptive execution on, UTC clock; cluster sizing stays with the cluster's own defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Without one, only a session inside a single process may use a folder of this machine: executors
    elsewhere would write to folders that the others cannot see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="basketlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small, often reused table: survives lost executors, cuts lineage."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, where its lineage ends.

    It is computed once and read by column; a checkpoint computes its last stage twice, to count and to write.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/basketlake/stored-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


FIT_PARTITIONS = "spark.basketlake.fit.partitions"


def training_rows(frame: DataFrame) -> DataFrame:
    """Rows for a tree fit, materialized once, in a number of partitions that a setting fixes.

    Bagging is seeded by partition, so the number must not follow the size of the cluster for a fit
    to be the same on any; set ``spark.basketlake.fit.partitions`` (default 8) to the data.
    """
    n = int(frame.sparkSession.conf.get(FIT_PARTITIONS, "8"))
    return materialize(frame.repartition(n))

"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pin_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps mean UTC here, so the session zone has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app: str = "quillwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC time.

    Shuffle partition count is left to the cluster; pass it in ``conf`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one of our own only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillwatch-ckpt-")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, lineage cut."""
    path = f"{checkpoint_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to all tasks that can run, if fewer of the reading tasks have any.

    A file is cut by bytes but read by row group, so one with few groups leaves most of its tasks
    empty. To count those with rows no column is read.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    filled = rows.select(F.spark_partition_id().alias("task")).distinct().count()
    if filled >= tasks:
        return rows
    # tasks of a third of a round, so that the last ones are short
    return rows.repartition(3 * tasks, F.xxhash64(*keys))


@contextmanager
def kept(frame: DataFrame) -> Iterator[DataFrame]:
    """The rows computed once inside the block; a cache that the caller holds stays."""
    level = frame.storageLevel
    if level.useMemory or level.useDisk:
        yield frame
        return
    frame.persist()
    try:
        yield frame
    finally:
        frame.unpersist()

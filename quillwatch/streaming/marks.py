"""Where a watch starts: the newest row that earlier runs have taken in, kept on disk.

    <root>/run=<tag>/start/             the mark that a run began behind
    <root>/run=<tag>/epochs/number=N/   the newest (event_time, event_id) up to epoch N

A run is told by its checkpoint. An epoch sees the marks of lower epochs only, so one that is
replayed writes the same mark again. Each mark includes the earlier ones; two are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.plans.changes import drop_before, set_path, written

MARK = "at timestamp, id string"


def _newest(rows: DataFrame) -> DataFrame:
    """One row (at, id): the greatest, both null without rows."""
    return rows.where(F.col("at").isNotNull()).agg(F.max(F.struct("at", "id")).alias("m")).select(
        "m.at", "m.id"
    )


def mark_of(rows: DataFrame) -> DataFrame:
    """The newest (event_time, event_id) of audit rows, whatever becomes of them."""
    key = F.col("event_id").cast("string") if "event_id" in rows.columns else F.lit("")
    return _newest(rows.select(F.col("event_time").cast("timestamp").alias("at"), key.alias("id")))


class Marks:
    """Marks of one run below ``root``, and the mark it starts behind."""

    def __init__(self, spark: SparkSession, root: str, checkpoint: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        tag = hashlib.sha256(checkpoint.rstrip("/").encode("utf-8")).hexdigest()[:16]
        self.folder = f"{self.root}/run={tag}"
        self.epochs = f"{self.folder}/epochs"

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(MARK).parquet(*paths)

    def newest(self) -> DataFrame:
        """The newest mark of all runs."""
        jvm = self.spark._jvm
        runs = jvm.org.apache.hadoop.fs.Path(f"{self.root}/run=*")
        fs = runs.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = []
        for status in fs.globStatus(runs) or []:
            folder = status.getPath().toString()
            numbers = written(self.spark, f"{folder}/epochs")
            paths += [set_path(f"{folder}/epochs", n) for n in numbers[-1:]]
            if not numbers and self._exists(f"{folder}/start/_SUCCESS"):
                paths.append(f"{folder}/start")
        if not paths:
            return self.spark.createDataFrame([(None, None)], MARK)
        return _newest(self._read(*paths))

    def start(self, since: str | None) -> tuple[object, str | None]:
        """Mark that this run begins behind.

        An explicit ``since`` wins and is kept for later restarts; else the start that this
        checkpoint had before; else the newest mark of all runs.
        """
        path = f"{self.folder}/start"
        if since is not None:
            chosen = self.spark.range(1).select(
                F.lit(since).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("id")
            )
            chosen.write.mode("overwrite").parquet(path)
        elif not self._exists(f"{path}/_SUCCESS"):
            # read before writing: the folder is one of those that are read
            row = self.newest().first()
            self.spark.createDataFrame([(row["at"], row["id"])], MARK).write.mode(
                "overwrite"
            ).parquet(path)
        row = self._read(path).first()
        return (row["at"], row["id"]) if row else (None, None)

    def before(self, epoch: int) -> object | None:
        """Newest event time of the epochs before one."""
        earlier = [n for n in written(self.spark, self.epochs) if n < epoch]
        if not earlier:
            return None
        row = self._read(set_path(self.epochs, earlier[-1])).first()
        return row["at"] if row else None

    def advance(self, rows: DataFrame, epoch: int) -> None:
        """Write the mark of an epoch: the newest of its rows and of the mark before it."""
        mark = mark_of(rows)
        earlier = [n for n in written(self.spark, self.epochs) if n < epoch]
        paths = [set_path(self.epochs, n) for n in earlier[-1:]]
        if not paths and self._exists(f"{self.folder}/start/_SUCCESS"):
            paths = [f"{self.folder}/start"]
        if paths:
            mark = _newest(mark.unionByName(self._read(*paths)))
        mark.write.mode("overwrite").parquet(set_path(self.epochs, epoch))
        drop_before(self.spark, self.epochs, epoch - 1)


def later_than(rows: DataFrame, at: object | None, key: str | None) -> Column:
    """Rows strictly behind a mark; rows without a time are kept, to be quarantined."""
    if at is None:
        return F.lit(True)
    time = F.col("event_time").cast("timestamp")
    later = time > F.lit(at)
    if key and "event_id" in rows.columns:
        later = later | ((time == F.lit(at)) & (F.col("event_id").cast("string") > key))
    return F.coalesce(later, F.lit(True))

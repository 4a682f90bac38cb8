"""Incidents kept up to date from a stream of alerts, equal to a batch over all of them.

The table holds one row per cluster of an actor. The cells of new alerts and the clusters they
can reach are chained together as the batch operator chains cells: a cluster is a longer cell.
A late alert between two clusters joins them; the cluster that starts later is withdrawn, and
with it its incident id. Names are kept by the time they were seen at, so they follow their
cluster without being written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillwatch.operators.incidents import (
    CLUSTER,
    INCIDENT_FIELDS,
    KEY,
    _cells,
    _clustered,
    _keyed,
    cell_names,
    cluster_measures,
    incident_id_of,
    incident_rows,
)
from quillwatch.plans.changes import read_sets, set_path, written

_FIELDS = [part.split()[0] for part in CLUSTER.split(", ")]
_NAMES = "source_system string, database string, actor string, kind string, name string, at bigint"


class IncidentTable:
    """Clusters and their names below ``root``; ``window_minutes`` belongs to the table."""

    def __init__(self, spark: SparkSession, root: str, *, window_minutes: int = 30) -> None:
        self.spark, self.root, self.window_minutes = spark, root.rstrip("/"), window_minutes

    def clusters(self, before: int | None = None) -> DataFrame:
        """Live clusters, of the change sets below ``before`` only."""
        rows = read_sets(self.spark, self.root, "clusters", f"{CLUSTER}, live boolean", before)
        return (
            rows.groupBy(*KEY, "start")
            .agg(F.max_by(F.struct(*_FIELDS[4:], "live"), "number").alias("row"))
            .where("row.live")
            .select(*KEY, "start", *(f"row.{c}" for c in _FIELDS[4:]))
        )

    def incidents(self) -> DataFrame:
        """One row per incident, without arrays; see ``names``."""
        return incident_rows(self.clusters(), self.window_minutes).select(*INCIDENT_FIELDS)

    def names(self) -> DataFrame:
        """``incident_id, kind, name`` of all incidents."""
        seen = read_sets(self.spark, self.root, "names", _NAMES).drop("number")
        spans = self.clusters().select(*KEY, "start", "last_start")
        inside = F.col("at").between(F.col("start"), F.col("last_start"))
        return (
            seen.join(spans, list(KEY))
            .where(inside)
            .select(
                incident_id_of(F.timestamp_micros("start")).alias("incident_id"), "kind", "name"
            )
            .distinct()
        )

    def withdrawn(self, number: int) -> DataFrame:
        """Incident ids that a change set took back."""
        rows = self.spark.read.schema(f"{CLUSTER}, live boolean").parquet(
            set_path(f"{self.root}/clusters", number)
        )
        return rows.where(~F.col("live")).select(
            incident_id_of(F.timestamp_micros("start")).alias("incident_id")
        )

    def merge(self, alerts: DataFrame, number: int) -> None:
        """Take in alerts as change set ``number``; the same number again changes nothing.

        Each alert is given once. A set sees the sets of lower numbers only, so one that is
        written again after a lost job comes out alike.
        """
        cells = _cells(_keyed(alerts, self.window_minutes, False)).persist()
        try:
            named = cell_names(cells).groupBy(*KEY, "kind", "name", F.col("start").alias("at"))
            named.agg(F.lit(1)).select(*(part.split()[0] for part in _NAMES.split(", "))).write.mode(
                "overwrite"
            ).parquet(set_path(f"{self.root}/names", number))
            self._changed(cells, number).write.mode("overwrite").parquet(
                set_path(f"{self.root}/clusters", number)
            )
        finally:
            cells.unpersist()

    def _changed(self, cells: DataFrame, number: int) -> DataFrame:
        """New rows of the clusters that the cells change, and the clusters that they end."""
        width = self.window_minutes * 60_000_000
        fresh = cells.select(
            *KEY, "start", "last_start", "stop", "severity_rank",
            F.coalesce("odd_severity", F.lit("info")).alias("low_severity"),
            "risk_score", "alert_count", "occurrence_count", "any_new", "any_ack", "reversed_id",
            F.lit(False).alias("known"),
        )
        span = cells.groupBy(*KEY).agg(
            F.min("start").alias("_low"),
            F.greatest(F.max("stop"), F.max("last_start")).alias("_high"),
        )
        near = (F.col("start") <= F.col("_high") + width) & (
            F.greatest("stop", "last_start") + width >= F.col("_low")
        )
        known = (
            self.clusters(before=number)
            .join(span, list(KEY))
            .where(near)
            .select(
                *_FIELDS,
                F.lit(None).cast("string").alias("reversed_id"),
                F.lit(True).alias("known"),
            )
        )
        rows = _clustered(fresh.unionByName(known), self.window_minutes)
        merged = rows.groupBy(*KEY, "cluster").agg(
            *cluster_measures(),
            F.count_if("known").alias("_old"),
            F.count_if(~F.col("known")).alias("_new"),
        )
        changed = merged.where("_new > 0 or _old > 1").select(*_FIELDS, F.lit(True).alias("live"))
        first = F.min("start").over(Window.partitionBy(*KEY, "cluster"))
        ended = (
            rows.withColumn("_first", first)
            .where(F.col("known") & (F.col("start") > F.col("_first")))
            .select(*_FIELDS, F.lit(False).alias("live"))
        )
        return changed.unionByName(ended)

    def fold(self) -> None:
        """Write the live rows as one set, so that reading starts from there."""
        last = written(self.spark, f"{self.root}/clusters")
        if not last:
            return
        number = last[-1]
        names = read_sets(self.spark, self.root, "names", _NAMES).drop("number")
        names.distinct().write.mode("overwrite").parquet(
            set_path(f"{self.root}/names-folded", number)
        )
        self.clusters().withColumn("live", F.lit(True)).write.mode("overwrite").parquet(
            set_path(f"{self.root}/clusters-folded", number)
        )


def watch_incidents(
    alerts: DataFrame,
    table: IncidentTable,
    *,
    checkpoint: str,
    stream_id: str = "incidents",
    fold_every: int = 50,
    interval_seconds: float | None = 10.0,
    once: bool = False,
) -> StreamingQuery:
    """Keep ``table`` up to date from a stream of alerts, in whatever order they come."""

    def take(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, epoch)
        if fold_every and (epoch + 1) % fold_every == 0:
            table.fold()

    writer = (
        alerts.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .queryName(stream_id)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval_seconds is not None:
        writer = writer.trigger(processingTime=f"{interval_seconds} seconds")
    return writer.start()

"""Alert state kept as parquet: whole snapshots plus small change sets.

    <root>/alerts/version=v0000000007-base/bucket=.../           every alert
    <root>/alerts/version=v0000000008-change-<id>/bucket=.../    new rows of a batch's alerts
    <root>/events/version=v0000000008-change-<id>/event_date=.../   its lifecycle events

A version counts once Spark has written its ``_SUCCESS`` file, so a lost job leaves
nothing half visible. A batch reads the buckets of the alerts it touches and writes only the
rows it changed; reading overlays the change sets, all read by one scan, on the last snapshot;
``compact`` folds them into a new one. One writer at a time.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.operators.alerts import (
    batch_events,
    imported_events,
    merge_batch,
    merge_import,
    upsert,
)
from quillwatch.operators.extra import with_extra
from quillwatch.operators.lifecycle import update_statuses
from quillwatch.operators.summaries import cascade_events, prune, store_info, verify_alerts
from quillwatch.functions.text import strip
from quillwatch.schemas import ALERT, ALERT_COLUMNS, ALERT_EVENT
from quillwatch.session import kept

BACKUP_FORMAT = "alert-store-backup-v1"
SCHEMA_VERSION = 1
_NAME = re.compile(r"^v(\d{10})-(base|change)(?:-([0-9a-f]{16}))?$")


class AlertStore:
    """Current alerts and their lifecycle events under one directory."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 16) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # -- layout

    def _complete(self, pattern: str) -> list[str]:
        """Names of the folders of that pattern with a ``_SUCCESS``, by one listing."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = (s.getPath().getParent().getName() for s in fs.globStatus(path) or [])
        return sorted(name.removeprefix("version=") for name in names)

    def _versions(self) -> list[tuple[int, str, str, str]]:
        """Committed (number, kind, tag, name), oldest first."""
        found = [(_NAME.match(name), name) for name in self._complete("alerts/version=*")]
        return sorted((int(m[1]), m[2], m[3] or "", name) for m, name in found if m)

    def _alerts(self, names: list[str], buckets: list[int] | None = None) -> DataFrame:
        """Rows of versions with the ``number`` of theirs, in one scan."""
        if not names:
            empty = self.spark.createDataFrame([], ALERT)
            return empty.withColumn("number", F.lit(0).cast("bigint"))
        base = f"{self.root}/alerts"
        rows = (
            self.spark.read.schema(f"{ALERT}, version string, bucket int")
            .option("basePath", base)
            .parquet(*[f"{base}/version={name}" for name in names])
            .withColumn("number", F.substring("version", 2, 10).cast("bigint"))
        )
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("alert_id"), F.lit(self.buckets)).cast("int")

    def _live(self) -> tuple[list[str], list[tuple[int, str]]]:
        """Name of the last snapshot, and numbered names of the change sets after it."""
        versions = self._versions()
        bases = [v for v in versions if v[1] == "base"]
        floor = bases[-1][0] if bases else 0
        changes = [(v[0], v[3]) for v in versions if v[1] == "change" and v[0] > floor]
        return ([bases[-1][3]] if bases else []), changes

    def _next_name(self, kind: str, tag: str = "") -> str:
        versions = self._versions()
        number = (versions[-1][0] if versions else 0) + 1
        return f"v{number:010d}-{kind}" + (f"-{tag}" if tag else "")

    @staticmethod
    def _tag(change_id: str) -> str:
        return hashlib.sha256(change_id.encode("utf-8")).hexdigest()[:16]

    def _applied(self, change_id: str) -> bool:
        return any(v[2] == self._tag(change_id) for v in self._versions())

    # -- reading

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """Current row of every alert, or of those in some buckets."""
        base_names, changes = self._live()
        base = self._alerts(base_names, buckets).select(*ALERT_COLUMNS)
        if not changes:
            return base
        newest = (
            self._alerts([name for _, name in changes], buckets)
            .groupBy("alert_id")
            .agg(F.max_by(F.struct(*ALERT_COLUMNS), "number").alias("row"))
            .select("row.*")
        )
        return upsert(base, newest) if base_names else newest

    def change_sets(self) -> int:
        """Change sets since the last snapshot."""
        return len(self._live()[1])

    def newest_first(self) -> DataFrame:
        return self.state().orderBy(F.col("last_seen").desc(), "alert_id")

    def events(self) -> DataFrame:
        """Lifecycle events of all committed versions since events were last rewritten."""
        with_events = set(self._complete("events/version=*"))
        names = [v[3] for v in self._versions() if v[3] in with_events]
        rewritten = [i for i, name in enumerate(names) if name.endswith("-base")]
        live = names[rewritten[-1] :] if rewritten else names
        if not live:
            return self.spark.createDataFrame([], ALERT_EVENT)
        base = f"{self.root}/events"
        return (
            self.spark.read.schema(ALERT_EVENT)
            .option("basePath", base)
            .parquet(*[f"{base}/version={name}" for name in live])
            .select(*[part.split()[0] for part in ALERT_EVENT.split(", ")])
        )

    # -- writing

    def _commit(self, name: str, rows: DataFrame, events: DataFrame | None) -> None:
        """Events first, state last: the state's marker is what makes the version count."""
        if events is not None:
            (
                events.withColumn("event_date", F.to_date("timestamp"))
                .write.mode("overwrite")
                .partitionBy("event_date")
                .parquet(f"{self.root}/events/version={name}")
            )
        (
            with_extra(rows)
            .select(*ALERT_COLUMNS, self._bucket().alias("bucket"))
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.root}/alerts/version={name}")
        )

    def persist_batch(self, occurrences: DataFrame, *, batch_id: str, generated_at: str) -> bool:
        """Merge a batch of occurrences. A batch id that was merged before does nothing.

        The batch is read several times, so its rows are kept until it is done.
        """
        if not batch_id.strip():
            raise ValueError("batch_id cannot be empty")
        if self._applied(batch_id):
            return False
        with kept(occurrences):
            buckets = occurrences.select(self._bucket().alias("b")).distinct().collect()
            merged = merge_batch(
                self.state([r["b"] for r in buckets]), occurrences, generated_at=generated_at
            )
            self._commit(
                self._next_name("change", self._tag(batch_id)),
                merged,
                batch_events(occurrences, merged),
            )
        return True

    def update(self, actions: DataFrame, *, change_id: str) -> DataFrame:
        """Apply analyst actions and return the verdict of each."""
        changed, verdicts = update_statuses(self.state(), actions)
        if not self._applied(change_id):
            done = verdicts.where(F.col("verdict") == "accepted")
            events = done.select(
                F.sha2(F.concat_ws("|", "alert_id", "action_key"), 256).alias("event_key"),
                "alert_id",
                F.col("action").alias("event_type"),
                F.col("at").alias("timestamp"),
                F.lit(None).cast("string").alias("batch_id"),
                strip(F.col("actor")).alias("actor"),
                strip(F.col("note")).alias("note"),
                F.to_json(F.struct("alert_id", "action", "at", "actor", "note")).alias(
                    "payload_json"
                ),
            )
            self._commit(self._next_name("change", self._tag(change_id)), changed, events)
        return verdicts

    def compact(self) -> None:
        """Fold the change sets into a new snapshot."""
        self._commit(self._next_name("base"), self.state(), None)

    def prune(self, *, older_than_days: int, now: str, status: str = "resolved") -> DataFrame:
        """Drop old alerts and their events; returns the removed and retained counts.

        The returned frame reads the version from before the prune.
        """
        retained, counts = prune(
            self.state(), older_than_days=older_than_days, now=now, status=status
        )
        kept_events = cascade_events(self.events(), retained)
        self._commit(self._next_name("base"), retained, kept_events)
        return counts

    def import_alerts(self, imported: DataFrame, *, import_id: str, merge: bool = False) -> None:
        """Take over alert rows; with ``merge`` they overwrite rows with the same id."""
        existing = self.state()
        if not merge and not existing.isEmpty():
            raise ValueError("the store already contains alerts; use merge=True")
        if self._applied(import_id):
            return
        self._commit(
            self._next_name("change", self._tag(import_id)),
            merge_import(existing.limit(0), imported),
            imported_events(imported),
        )

    # -- backup

    def backup(self, target: str, *, now: datetime | None = None) -> str:
        """Write the current state and its events below ``target`` under a time-stamped name."""
        stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
        path = f"{target.rstrip('/')}/alerts-{stamp}"
        (
            self.state()
            .withColumns(
                {"format": F.lit(BACKUP_FORMAT), "schema_version": F.lit(SCHEMA_VERSION)}
            )
            .write.mode("errorifexists")
            .parquet(f"{path}/alerts")
        )
        self.events().write.mode("errorifexists").parquet(f"{path}/events")
        return path

    def restore(self, backup: str, *, overwrite: bool = False) -> None:
        """Replace the state and the events by a checked backup."""
        rows = read_backup(self.spark, backup)
        if not overwrite and not self.state().isEmpty():
            raise ValueError("the store is not empty; explicit overwrite is required")
        self._commit(self._next_name("base"), rows, read_backup_events(self.spark, backup))

    # -- inspection

    def info(self) -> DataFrame:
        """Alert count of the current state, and files and bytes of the live versions."""
        base_names, changes = self._live()
        names = base_names + [name for _, name in changes]
        sizes = store_info(self._alerts(names)) if names else None
        count = self.state().agg(F.count("*").alias("alert_count"))
        empty = count.select(
            "alert_count",
            F.lit(0).cast("bigint").alias("files"),
            F.lit(0).cast("bigint").alias("size_bytes"),
        )
        if sizes is None:
            return empty
        stored = sizes.select(
            F.lit(None).cast("bigint").alias("alert_count"), "files", "size_bytes"
        )
        return empty.unionByName(stored).agg(
            F.max("alert_count").alias("alert_count"),
            F.max("files").alias("files"),
            F.max("size_bytes").alias("size_bytes"),
        )

    def verify(self) -> DataFrame:
        return verify_alerts(self.state())


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of a backup; a wrong format, version or row content stops the job."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/alerts")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError("not an alert backup, it has no alerts folder")
    rows = with_extra(spark.read.parquet(f"{path}/alerts"))
    missing = {"format", *ALERT_COLUMNS} - set(rows.columns)
    if missing:
        raise ValueError("not an alert backup, missing columns: " + ", ".join(sorted(missing)))
    good = (
        (F.col("format") == BACKUP_FORMAT)
        & (F.col("schema_version") == SCHEMA_VERSION)
        & F.col("alert_id").isNotNull()
        & F.col("status").isin("new", "acknowledged", "resolved")
    )
    return rows.where(
        F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.lit("Backup contains invalid alert data")).cast("boolean")
        )
    ).select(*ALERT_COLUMNS)


def read_backup_events(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycle events of a backup."""
    return spark.read.schema(ALERT_EVENT).parquet(f"{path}/events")

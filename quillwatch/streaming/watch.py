"""Continuous detection on a stream of audit rows.

Each micro-batch is handed to one ``foreachBatch`` that sets late and bad rows aside, analyzes
the rest, merges it into the alert store and, where asked, exports it. The batch id is derived from the
stream's epoch, and the store ignores an id it has seen, so a replayed epoch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillwatch.functions.times import iso_text
from quillwatch.operators.alerts import enrich_detections, restrict_to_batch
from quillwatch.operators.detection import DEFAULT_RULES, Detector, Rule, analyze, threshold
from quillwatch.operators.incidents import actor_of, notification_rows, notify_selection
from quillwatch.plans.exports import outbox, write_batches
from quillwatch.plans.reports import incidents_from_alerts
from quillwatch.plans.store import AlertStore
from quillwatch.schemas import AUDIT_ROW
from quillwatch.sources.audit import accepted, normalize_events, quarantined
from quillwatch.streaming.marks import Marks, later_than
from quillwatch.streaming.watch_audit import append_epoch


def read_audit_stream(
    spark: SparkSession,
    path: str,
    *,
    schema: str = AUDIT_ROW,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files arriving under ``path``; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def detection_stream(
    rows: DataFrame,
    *,
    min_risk: float = 0.7,
    min_severity: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    detector: Detector | None = None,
) -> DataFrame:
    """Audit rows to detections; stateless, so it works on batches and streams alike."""
    events = accepted(normalize_events(rows))
    return threshold(analyze(events, rules, detector=detector), min_risk, min_severity)


def late_counts(rows: DataFrame, mark: str) -> DataFrame:
    """Rows at or before the mark, which a poll after the mark would skip."""
    late = F.col("event_time") <= F.lit(mark).cast("timestamp")
    return rows.agg(F.count_if(late).alias("late_rows"), F.count_if(~late).alias("fresh_rows"))


def split_late(
    rows: DataFrame, mark: object | None, late_after: str
) -> tuple[DataFrame, DataFrame]:
    """(fresh, late) rows, late ones lying ``late_after`` or more behind the mark."""
    if mark is None:
        return rows, rows.where(F.lit(False))
    limit = F.lit(mark) - F.expr(f"interval {late_after}")
    late = F.coalesce(F.col("event_time").cast("timestamp") <= limit, F.lit(False))
    return rows.where(~late), rows.where(late)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as can run: one large file is read by few of them."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def watch(
    rows: DataFrame,
    store: AlertStore,
    *,
    checkpoint: str,
    stream_id: str = "watch",
    min_risk: float = 0.7,
    min_severity: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    detector: Detector | None = None,
    late_after: str | None = None,
    late_dir: str | None = None,
    quarantine_dir: str | None = None,
    export_dir: str | None = None,
    outbox_dir: str | None = None,
    outbox_secret: str | None = None,
    audit_dir: str | None = None,
    since: str | None = None,
    mark_dir: str | None = None,
    fold_every: int = 20,
    interval_seconds: float | None = 10.0,
    once: bool = False,
) -> StreamingQuery:
    """Start the watch. ``once`` drains what is there and stops.

    Only rows behind the start mark are taken: ``since`` if given, else the newest
    (event_time, event_id) that watches with this ``mark_dir`` have seen, good or bad. A
    checkpoint keeps its start over restarts. With ``audit_dir`` each batch of alerts adds one
    record to a hash chain. Every ``fold_every`` change sets the store is folded.

    Bad rows go to ``quarantine_dir``; without one the first bad row stops the watch. With
    ``late_after`` rows that arrive that long behind the newest event time of earlier batches go
    to ``late_dir`` and no further. Exports hold the current state of the alerts a batch
    touched; notices come from every alert of the actors it touched, so incidents are those of
    the whole store.
    """
    if interval_seconds is not None and not 1.0 <= interval_seconds <= 3_600.0:
        raise ValueError("interval_seconds must be between 1 and 3600")
    if late_after and not late_dir:
        raise ValueError("late rows need late_dir")

    spark = rows.sparkSession
    marks = Marks(spark, mark_dir or f"{checkpoint.rstrip('/')}-marks", checkpoint)
    begin = marks.start(since)

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch_id = f"{stream_id}-{epoch:012d}"
        batch = spread(batch.where(later_than(batch, *begin))).persist()
        try:
            fresh = batch
            if late_after:
                fresh, late = split_late(batch, marks.before(epoch), late_after)
                late.write.mode("overwrite").parquet(f"{late_dir}/{batch_id}")
            if quarantine_dir:
                quarantined(normalize_events(fresh)).write.mode("overwrite").parquet(
                    f"{quarantine_dir}/{batch_id}"
                )
                events = accepted(normalize_events(fresh))
            else:
                events = accepted(normalize_events(fresh, mode="failfast"))
            found = threshold(analyze(events, rules, detector=detector), min_risk, min_severity)
            store_and_send(found.persist(), batch_id, epoch)
            marks.advance(batch, epoch)
            if fold_every and store.change_sets() >= fold_every:
                store.compact()
        finally:
            batch.unpersist()

    def store_and_send(found: DataFrame, batch_id: str, epoch: int) -> None:
        try:
            # one clock value per epoch, taken from the data so that a replay repeats it
            generated_at = found.agg(iso_text(F.max("timestamp")).alias("t")).first()["t"]
            if generated_at is None:
                return
            occurrences = enrich_detections(found, batch_id=batch_id, generated_at=generated_at)
            store.persist_batch(occurrences, batch_id=batch_id, generated_at=generated_at)
            state = store.state()
            touched = restrict_to_batch(state, occurrences)
            if export_dir:
                write_batches(
                    touched.withColumn("batch_id", F.lit(batch_id)), f"{export_dir}/{batch_id}"
                )
            if outbox_dir and outbox_secret:
                key = ["source_system", "database"]
                actors = touched.select(*key, actor_of().alias("actor")).distinct()
                current = (
                    state.withColumn("actor", actor_of())
                    .join(actors, [*key, "actor"], "left_semi")
                    .drop("actor")
                )
                notices = notification_rows(notify_selection(incidents_from_alerts(current)))
                outbox(notices, secret=outbox_secret, sent_at=generated_at).write.mode(
                    "overwrite"
                ).parquet(f"{outbox_dir}/{batch_id}")
            if audit_dir:
                details = found.agg(
                    F.lit(batch_id).alias("batch_id"),
                    F.count("*").alias("alert_count"),
                    F.lit(f"{export_dir}/{batch_id}" if export_dir else None).alias("export_file"),
                    F.lit(f"{outbox_dir}/{batch_id}" if outbox_dir else None).alias("outbox"),
                )
                append_epoch(
                    spark, audit_dir, epoch, at=generated_at, status="success", details=details,
                    chain=stream_id,
                )
        finally:
            found.unpersist()

    writer = (
        rows.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .queryName(stream_id)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval_seconds is not None:
        writer = writer.trigger(processingTime=f"{interval_seconds} seconds")
    return writer.start()


def incident_sessions(
    alerts: DataFrame, *, window_minutes: int = 30, late_after: str = "1 hour"
) -> DataFrame:
    """Incidents from a stream of alert intervals, emitted once they can no longer grow.

    The session gap of an alert is its own length plus the window, so two alerts meet
    under the same condition as in the batch operator. Spark merges the sessions of one
    micro-batch before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    length = F.greatest(
        F.unix_micros("last_seen") - F.unix_micros("first_seen"), F.lit(0).cast("bigint")
    )
    gap = F.concat(
        (length + F.lit(window_minutes * 60_000_000)).cast("string"), F.lit(" microseconds")
    )
    keyed = alerts.withColumns(
        {
            "source_system": F.lower("source_system"),
            "database": F.lower("database"),
            "actor": actor_of(),
        }
    ).withWatermark("first_seen", late_after)
    return (
        keyed.groupBy(
            "source_system", "database", "actor", F.session_window("first_seen", gap).alias("s")
        )
        .agg(
            F.min("first_seen").alias("started"),
            F.max("last_seen").alias("ended"),
            F.count("*").alias("alert_count"),
            F.sum("occurrence_count").alias("occurrence_count"),
            F.max("risk_score").alias("risk_score"),
        )
        .drop("s")
    )

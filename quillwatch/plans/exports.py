"""Files other tools read: detection exports, batches, logs, reports, metrics, outbox."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.hashing import hmac_signature
from quillwatch.functions.text import json_number, json_object, json_string, strip
from quillwatch.functions.times import iso_text
from quillwatch.operators.alerts import flat_records
from quillwatch.operators.extra import spliced, with_extra
from quillwatch.operators.metrics import exposition_lines, health_summary
from quillwatch.operators.summaries import incident_summary, scan_summary
from quillwatch.schemas import ALERT_COLUMNS

_LOG_COLUMNS = (
    "alert_id",
    "fingerprint",
    "batch_id",
    "status",
    "occurrence_count",
    "username",
    "database",
    "source_system",
    "client_ip",
    "query",
    "risk_score",
    "severity",
    "classification",
    "updated_by",
    "status_note",
    "last_action",
)
_LOG_TIMES = ("generated_at", "first_seen", "last_seen", "status_updated_at")


def export_format(path: str) -> str:
    """``csv`` or ``json`` by the suffix of the target name."""
    name = path.rstrip("/").lower()
    for suffix in ("csv", "json"):
        if name.endswith("." + suffix):
            return suffix
    raise ValueError("the export target must end with .csv or .json")


def write_detections(analyzed: DataFrame, path: str) -> None:
    """The nine-column records as CSV with header, or JSON lines with a summary beside them."""
    records = flat_records(analyzed)
    if export_format(path) == "csv":
        records.write.mode("overwrite").option("header", True).option(
            "escape", '"'
        ).csv(path)
        return
    records.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/events")
    scan_summary(analyzed).write.mode("overwrite").json(f"{path}/summary")


def batch_records(
    occurrences: DataFrame, record_type: str = "alert", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Occurrences as log records with ISO times; columns of ``keep`` follow as they are."""
    times = [F.col(c) for c in _LOG_TIMES if c in occurrences.columns]
    names = [c for c in _LOG_TIMES if c in occurrences.columns]
    plain = [c for c in _LOG_COLUMNS if c in occurrences.columns]
    return occurrences.select(
        F.lit(record_type).alias("type"),
        *plain,
        *[iso_text(t).alias(n) for t, n in zip(times, names, strict=True)],
        *(
            [iso_text(F.col("first_seen")).alias("timestamp")]
            if "first_seen" in occurrences.columns
            else []
        ),
        *keep,
    )


def write_batches(occurrences: DataFrame, path: str, batch_type: str = "alert_batch") -> None:
    """Alert rows per batch, and one envelope row per batch with its count.

    A batch may be of any size, so its alerts are rows of its partition, not one array.
    """
    batch_records(occurrences).write.mode("overwrite").partitionBy("batch_id").json(
        f"{path}/alerts"
    )
    occurrences.groupBy("batch_id").agg(
        F.lit(batch_type).alias("type"),
        iso_text(F.max("generated_at")).alias("generated_at"),
        F.count("*").alias("alert_count"),
    ).write.mode("overwrite").json(f"{path}/batches")


_SEQUENCE = re.compile(r"^seq-(\d{10})$")


def _append(records: DataFrame, path: str, **options: object) -> None:
    """Write one append below the next sequence folder of the log.

    Folder names sort by sequence, so replay applies appends in the order they were made. An
    append that meets another one under its number fails and may be repeated.
    """
    spark = records.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    taken = [int(m[1]) for m in map(_SEQUENCE.match, names) if m]
    target = f"{path.rstrip('/')}/seq-{max(taken, default=0) + 1:010d}"
    if options:
        records.write.mode("errorifexists").options(**options).json(target)
    else:
        records.write.mode("errorifexists").text(target)


def log_lines(occurrences: DataFrame) -> DataFrame:
    """Log records as JSON text; the keys of ``extra`` stand beside the named ones."""
    records = batch_records(with_extra(occurrences), keep=("extra",))
    text = F.to_json(F.struct(*records.columns[:-1]))
    return records.select(spliced(text, F.col("extra")).alias("value"))


def append_log(occurrences: DataFrame, path: str) -> None:
    _append(log_lines(occurrences), path)


def append_updates(actions: DataFrame, path: str, update_type: str = "alert_update") -> None:
    """Analyst actions as log records; a missing note is written as null."""
    records = actions.select(
        F.lit(update_type).alias("type"),
        "alert_id",
        iso_text(F.col("at")).alias("timestamp"),
        "action",
        F.col("action").alias("status"),
        "actor",
        strip(F.col("note")).alias("note"),
    )
    _append(records, path, ignoreNullFields=False)


def write_compacted_log(states: DataFrame, path: str) -> None:
    """Current states only, newest first across the files; the target must be new."""
    ordered = with_extra(states).select(*ALERT_COLUMNS).orderBy(F.col("last_seen").desc(), "alert_id")
    log_lines(ordered).write.mode("errorifexists").text(path)


def write_incident_report(
    assessed: DataFrame, path: str, report_type: str = "incident_report"
) -> None:
    rows = assessed.withColumns(
        {
            "first_seen": iso_text(F.col("first_seen")),
            "last_seen": iso_text(F.col("last_seen")),
        }
    )
    rows.write.mode("overwrite").json(f"{path}/incidents")
    incident_summary(assessed).withColumn("type", F.lit(report_type)).write.mode(
        "overwrite"
    ).json(f"{path}/summary")


def write_health_report(probes: DataFrame, path: str) -> None:
    health_summary(probes).write.mode("overwrite").json(f"{path}/summary")
    probes.write.mode("overwrite").json(f"{path}/components")


def write_metrics(series: DataFrame, path: str) -> None:
    """Exposition text; the rows are aggregates, so one file is enough."""
    exposition_lines(series).coalesce(1).write.mode("overwrite").text(path)


def _json_value(name: str, kind: str) -> Column:
    """JSON text of one column of a flat message; scores are in [0, 1] with four decimals."""
    c = F.col(f"`{name}`")
    if kind == "double":
        text = json_number(c)
    elif kind == "array<string>":
        text = F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ","), F.lit("]"))
    elif kind in {"boolean", "tinyint", "smallint", "int", "bigint"}:
        text = c.cast("string")
    else:
        text = json_string(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def message_body(messages: DataFrame) -> Column:
    """Canonical JSON of a flat row: sorted keys, no blanks, raw UTF-8."""
    return json_object({name: _json_value(name, kind) for name, kind in messages.dtypes})


def outbox(messages: DataFrame, *, secret: str, sent_at: str | Column) -> DataFrame:
    """Signed notification bodies: ``message_key, body, timestamp, signature``.

    ``messages`` rows become canonical JSON; delivery is left to whoever reads the table.
    """
    at = sent_at if isinstance(sent_at, Column) else F.lit(sent_at)
    stamped = messages.select(
        message_body(messages).alias("body"), F.unix_seconds(at.cast("timestamp")).alias("timestamp")
    )
    return stamped.select(
        F.sha2("body", 256).alias("message_key"),
        "body",
        F.col("timestamp").cast("string").alias("timestamp"),
        hmac_signature(F.col("body"), F.col("timestamp"), secret).alias("signature"),
    )

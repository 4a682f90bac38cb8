"""Line-delimited JSON lifecycle log: scan, checks and upgrade of old records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.domains import status_or_null
from quillwatch.functions.numeric import clamp_unit
from quillwatch.functions.text import strip
from quillwatch.functions.times import parse_iso
from quillwatch.operators.alerts import alert_id_of, with_fingerprint
from quillwatch.operators.extra import unknown_keys
from quillwatch.operators.once import computed_once
from quillwatch.schemas import LOG_RECORD
from quillwatch.sources.lines import numbered_lines


def parse_log_lines(lines: DataFrame, *, mode: str = "failfast") -> DataFrame:
    """Lines (``file, line_no, raw``) to records.

    Blank lines are skipped. ``problem`` is null, ``invalid_json`` or ``not_an_object``;
    with ``mode="failfast"`` such a line stops the job and its number is reported.
    """
    if mode not in {"failfast", "quarantine"}:
        raise ValueError("mode must be failfast or quarantine")
    parsed = computed_once(
        computed_once(lines.withColumnRenamed("raw", "_line"), raw=strip(F.col("_line"))).where(
            F.col("raw") != ""
        ),
        document=F.try_parse_json("raw"),
        record=F.from_json("raw", LOG_RECORD),
    )
    problem = F.when(F.col("document").isNull(), "invalid_json").when(
        ~F.col("raw").startswith("{"), "not_an_object"
    )
    count = F.try_variant_get("document", "$.occurrence_count", "variant")
    records = parsed.select(
        "file",
        "line_no",
        "raw",
        problem.alias("problem"),
        "record",
        F.when(F.schema_of_variant(count) == "BIGINT", F.col("record.occurrence_count"))
        .try_cast("bigint")
        .alias("whole_count"),
        F.when(problem.isNull(), F.json_object_keys("raw")).alias("fields"),
        "document",
    )
    known = [part.split()[0] for part in LOG_RECORD.split(", ")]
    records = records.withColumn(
        "extra",
        F.when(
            F.col("problem").isNull(), unknown_keys(F.col("document"), F.col("fields"), known)
        ),
    ).drop("document")
    if mode == "quarantine":
        return records
    message = F.concat(
        F.lit("Alert log line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem")
    )
    # looking at the column raises, so no later filter can step around the check
    raising = F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("string"))
    return records.withColumn("problem", raising).where(F.col("problem").isNull())


def read_alert_log(spark: SparkSession, path: str, *, mode: str = "failfast") -> DataFrame:
    return parse_log_lines(numbered_lines(spark, path), mode=mode)


def _time(text: Column, default: Column) -> Column:
    """Parsed text; blank text takes the default; unreadable text stops the job."""
    blank = text.isNull() | (strip(text) == "")
    bad = F.raise_error(F.concat(F.lit("Invalid alert timestamp: "), text)).cast("timestamp")
    return F.when(blank, default).otherwise(F.coalesce(parse_iso(text), bad))


def log_occurrences(
    records: DataFrame, *, alert_type: str = "alert", loaded_at: str | None = None
) -> DataFrame:
    """Alert records, with missing identity and lifecycle fields filled in.

    A record without a type is an alert. ``loaded_at`` stands in for records that carry no
    time at all; without it such a record stops the job.
    """
    rows = records.where(F.col("problem").isNull()).where(
        F.coalesce(F.col("record.type"), F.lit(alert_type)) == alert_type
    ).select("file", "line_no", "whole_count", "extra", "record.*")
    missing = F.raise_error(F.lit("Alert record has no timestamp")).cast("timestamp")
    fallback = F.lit(loaded_at).cast("timestamp") if loaded_at else missing
    generated = _time(F.col("generated_at"), fallback)
    rows = with_fingerprint(rows, "own_fingerprint")
    print_of = F.coalesce(F.nullif("fingerprint", F.lit("")), "own_fingerprint")
    status = F.coalesce(
        status_or_null(F.col("status")),
        F.raise_error(F.concat(F.lit("Invalid alert status: "), "status")).cast("string"),
    )
    rows = computed_once(rows, event_time=_time(F.col("timestamp"), generated))
    dated = rows.withColumns(
        {
            "fingerprint": print_of,
            "status": status,
            "occurrence_count": F.when(F.col("whole_count") > 0, F.col("whole_count"))
            .otherwise(F.lit(1))
            .cast("bigint"),
        }
    )
    return dated.select(
        "file",
        "line_no",
        F.coalesce(
            F.nullif("alert_id", F.lit("")), alert_id_of(F.col("fingerprint"))
        ).alias("alert_id"),
        "fingerprint",
        "status",
        "occurrence_count",
        _time(F.col("first_seen"), F.col("event_time")).alias("first_seen"),
        _time(F.col("last_seen"), F.col("event_time")).alias("last_seen"),
        "severity",
        clamp_unit(F.col("risk_score")).alias("risk_score"),
        "database",
        "username",
        "client_ip",
        "classification",
        "source_system",
        "query",
        "batch_id",
        F.when(
            F.col("generated_at").isNotNull(), parse_iso(F.col("generated_at"))
        ).alias("generated_at"),
        "updated_by",
        "status_note",
        parse_iso(F.col("status_updated_at")).alias("status_updated_at"),
        "last_action",
        "extra",
    )


def log_updates(records: DataFrame, *, update_type: str = "alert_update") -> DataFrame:
    """Status updates; ``fields`` tells which keys a record carries."""
    return records.where(F.col("problem").isNull()).where(
        F.col("record.type") == update_type
    ).select(
        "file",
        "line_no",
        "fields",
        strip(F.col("record.alert_id")).alias("alert_id"),
        F.when(
            F.array_contains("fields", "status"),
            F.coalesce(
                status_or_null(F.col("record.status")),
                F.raise_error(
                    F.concat(F.lit("Invalid alert status: "), F.col("record.status"))
                ).cast("string"),
            ),
        ).alias("status"),
        F.col("record.actor").alias("actor"),
        F.col("record.note").alias("note"),
        parse_iso(F.col("record.timestamp")).alias("timestamp"),
        F.col("record.action").alias("action"),
    ).where(F.col("alert_id") != "")

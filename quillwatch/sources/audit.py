"""Audit relation scan, row normalization and quarantine."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.text import json_object, json_string, sha256_prefixed, strip, strip_column
from quillwatch.functions.times import iso_text
from quillwatch.operators.once import computed_once

MAX_SCAN = 100_000
AUDIT_COLUMNS = (
    "event_time",
    "query_text",
    "username",
    "database_name",
    "client_ip",
    "duration_ms",
    "rows_affected",
)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def audit_page_sql(
    relation: str,
    *,
    schema: str = "public",
    since: datetime | str | None = None,
    limit: int | None = None,
) -> str:
    """What the database is asked for: the relation, or its oldest rows after a mark."""
    source = f"{_quoted(schema)}.{_quoted(relation)}"
    if limit is None:
        return source
    if not 1 <= limit <= MAX_SCAN:
        raise ValueError(f"limit must be between 1 and {MAX_SCAN}")
    text = since.isoformat(sep=" ") if isinstance(since, datetime) else since
    mark = "" if text is None else " WHERE event_time > TIMESTAMP '" + text.replace("'", "''") + "'"
    columns = ", ".join(AUDIT_COLUMNS)
    return f"(SELECT {columns} FROM {source}{mark} ORDER BY event_time LIMIT {limit}) AS page"


def read_audit_jdbc(
    spark: SparkSession,
    url: str,
    relation: str,
    *,
    schema: str = "public",
    since: datetime | str | None = None,
    limit: int | None = None,
    partition_bounds: tuple[str, str, int] | None = None,
    **options: str,
) -> DataFrame:
    """The audit relation over JDBC; filters and columns are pushed to the database.

    The source does not push a limit down, so a limited poll hands ``since`` and ``limit`` here
    and the database itself sorts and cuts. ``partition_bounds`` (lower, upper, partitions) on
    ``event_time`` makes an unlimited read parallel.
    """
    if limit is not None and partition_bounds:
        raise ValueError("a limited poll is one page; leave partition_bounds out")
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=audit_page_sql(relation, schema=schema, since=since, limit=limit),
        pushDownPredicate="true",
        fetchsize="10000",
        sessionInitStatement="SET default_transaction_read_only = on",
        **options,
    )
    if partition_bounds:
        lower, upper, parts = partition_bounds
        reader = reader.options(
            partitionColumn="event_time",
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(parts),
        )
    return reader.load()


def read_audit_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_audit(
    relation: DataFrame,
    *,
    since: datetime | str | None = None,
    after_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The audit columns strictly after the mark, oldest first, at most ``limit`` rows.

    With ``after_id`` the mark is the pair (event_time, event_id), so rows that share the
    last timestamp of the previous scan are not lost. Without ``limit`` no order is
    imposed: a sort of the whole table would be wasted work.
    """
    if limit is not None and not 1 <= limit <= MAX_SCAN:
        raise ValueError(f"limit must be between 1 and {MAX_SCAN}")
    has_id = "event_id" in relation.columns
    rows = relation.select(*(("event_id",) if has_id else ()), *AUDIT_COLUMNS)
    if since is not None:
        mark = F.lit(since).cast(relation.schema["event_time"].dataType)
        later = F.col("event_time") > mark
        if after_id is not None:
            later = later | ((F.col("event_time") == mark) & (F.col("event_id") > after_id))
        rows = rows.where(later)
    if limit is None:
        return rows
    ties = ["event_id"] if has_id else []
    return rows.orderBy("event_time", *ties).limit(limit)


def content_id(*columns: Column) -> Column:
    """Identifier derived from the row itself, so a retried task gives the same one."""
    named = {f"c{i:02d}": json_string(F.coalesce(c, F.lit(""))) for i, c in enumerate(columns)}
    return sha256_prefixed("evt_", json_object(named))


def _violations(source_system: Column) -> Column:
    checks = [
        *(
            (F.col(name).isNull() | (F.col(name) == ""), f"{name} is empty")
            for name in ("query", "username", "database")
        ),
        (source_system.isNull() | (source_system == ""), "source_system is empty"),
        (F.col("timestamp").isNull(), "timestamp is missing"),
        (F.col("duration_ms") < 0, "duration_ms is negative"),
        (F.col("rows_affected") < 0, "rows_affected is negative"),
    ]
    listed = F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))
    # most rows are good, and the list is only made for the others
    bad_row = F.coalesce(reduce(or_, [bad for bad, _ in checks]), F.lit(False))
    none = F.array_compact(F.array().cast("array<string>"))
    return F.when(bad_row, listed).otherwise(none)


def normalize_events(
    rows: DataFrame, *, source_system: str = "postgresql", mode: str = "quarantine"
) -> DataFrame:
    """Audit rows to events with a ``violations`` array.

    ``mode="quarantine"`` keeps bad rows for :func:`accepted` / :func:`quarantined`;
    ``mode="failfast"`` stops the job at the first bad row.
    """
    if mode not in {"quarantine", "failfast"}:
        raise ValueError("mode must be quarantine or failfast")
    source = (
        F.lower(strip(F.col("source_system")))
        if "source_system" in rows.columns
        else F.lit(source_system.strip().lower())
    )
    when = F.col("event_time").cast("timestamp")
    event_id = (
        F.col("event_id").cast("string")
        if "event_id" in rows.columns
        else content_id(
            when.cast("string"), F.col("query_text"), F.col("username"), F.col("database_name"),
            F.col("client_ip").cast("string"), F.col("duration_ms").cast("string"),
            F.col("rows_affected").cast("string"),
        )
    )
    events = rows.select(
        event_id.alias("event_id"),
        strip_column(F.col("query_text")).alias("query"),
        strip_column(F.col("username")).alias("username"),
        strip_column(F.col("database_name")).alias("database"),
        source.alias("source_system"),
        F.col("client_ip").cast("string").alias("client_ip"),
        F.col("duration_ms").cast("double").alias("duration_ms"),
        F.col("rows_affected").cast("bigint").alias("rows_affected"),
        when.alias("timestamp"),
    )
    violations = _violations(F.col("source_system"))
    if mode == "failfast":
        message = F.concat(
            F.lit("Bad audit row "), F.col("event_id"), F.lit(": "), F.array_join(violations, "; ")
        )
        violations = F.when(F.size(violations) == 0, violations).otherwise(
            F.raise_error(message).cast("array<string>")
        )
    listed = events.withColumn("_violations", violations)
    return computed_once(listed, violations=F.col("_violations")).drop("_violations")


def accepted(events: DataFrame) -> DataFrame:
    return events.where(F.size("violations") == 0).drop("violations")


def quarantined(events: DataFrame) -> DataFrame:
    return events.where(F.size("violations") > 0)


def high_water_mark(rows: DataFrame) -> DataFrame:
    """One row with the newest (event_time, event_id) of the fetched, unfiltered rows."""
    if "event_id" in rows.columns:
        top = F.max(F.struct("event_time", "event_id")).alias("mark")
        return rows.agg(top).select("mark.event_time", "mark.event_id")
    return rows.agg(F.max("event_time").alias("event_time"))


def iso_events(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", iso_text(F.col("timestamp")))

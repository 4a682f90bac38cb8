"""Counts and totals over scans, alerts, incidents and the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.domains import ALERT_STATUSES, SEVERITIES
from quillwatch.functions.numeric import clamp_unit


def scan_summary(analyzed: DataFrame) -> DataFrame:
    """One row: events_analyzed, average_risk, maximum_risk and a count per severity.

    Scores have four decimals, so the mean is taken over whole ten-thousandths and does
    not depend on how the rows are spread over tasks.
    """
    units = F.sum(F.round(F.col("risk_score") * 10_000).cast("bigint"))
    total = F.count("*")
    return analyzed.agg(
        total.alias("events_analyzed"),
        F.coalesce(units / F.lit(10_000.0) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias(
            "average_risk"
        ),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("maximum_risk"),
        *[F.count_if(F.col("severity") == name).alias(f"{name}_count") for name in SEVERITIES],
    )


def severity_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("severity").agg(F.count("*").alias("events"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Long form ``facet, name, alerts``: the total, per status and per severity, in one pass."""
    status = F.coalesce("status", F.lit("unknown"))
    severity = F.coalesce("severity", F.lit("unknown"))
    counted = (
        alerts.select(status.alias("status"), severity.alias("severity"))
        .groupBy("status", "severity")
        .agg(F.count("*").alias("n"))
    )
    # the pair counts are few, so all facets come out of them
    facets = counted.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("facet"), F.lit("all").alias("name"), F.col("n")),
                F.struct(F.lit("status").alias("facet"), F.col("status").alias("name"), F.col("n")),
                F.struct(
                    F.lit("severity").alias("facet"), F.col("severity").alias("name"), F.col("n")
                ),
            )
        ).alias("f")
    ).select("f.*")
    return facets.groupBy("facet", "name").agg(F.sum("n").alias("alerts"))


def dashboard_cards(alerts: DataFrame) -> DataFrame:
    """One row of headline counts."""
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ALERT_STATUSES],
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_and_critical"),
    )


def severity_bars(alerts: DataFrame) -> DataFrame:
    """Per severity the count and its percentage of the largest count (half-even)."""
    counts = alerts.groupBy("severity").agg(F.count("*").alias("n"))
    row = counts.agg(
        F.max("n").alias("top"),
        *[
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s)
            for s in SEVERITIES
        ],
    )
    bars = F.array(
        *[F.struct(F.lit(s).alias("severity"), F.col(s).alias("alerts")) for s in SEVERITIES]
    )
    width = F.when(F.col("top") > 0, F.rint(F.col("bar.alerts") / F.col("top") * 100))
    return row.select("top", F.explode(bars).alias("bar")).select(
        "bar.severity",
        "bar.alerts",
        F.coalesce(width, F.lit(0.0)).cast("bigint").alias("width"),
    )


def incident_summary(incidents: DataFrame) -> DataFrame:
    """One row: counts, active count, highest active risk, counts per status and severity."""
    active = F.col("status") != "resolved"
    return incidents.agg(
        F.count("*").alias("incident_count"),
        F.count_if(active).alias("active_count"),
        F.coalesce(F.max(F.when(active, clamp_unit(F.col("risk_score")))), F.lit(0.0)).alias(
            "maximum_active_risk"
        ),
        *[
            F.count_if(F.col("status") == s).alias(f"{s}_count")
            for s in ("open", "investigating", "resolved")
        ],
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES],
    )


def incident_gauges(incidents: DataFrame) -> DataFrame:
    """Incident count and largest recurrence per (status, severity)."""
    return incidents.groupBy("status", "severity").agg(
        F.count("*").alias("incidents"), F.max("occurrence_count").alias("recurrence")
    )


def max_recurrence(incidents: DataFrame) -> DataFrame:
    """Largest occurrence count of an active incident, 0 when none is active."""
    active = F.when(F.col("status") != "resolved", F.col("occurrence_count"))
    return incidents.agg(F.coalesce(F.max(active), F.lit(0).cast("bigint")).alias("recurrence_max"))


def panel_values(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """The single-number panels: current and critical alerts, active and critical incidents."""
    a = alerts.agg(
        F.count("*").alias("current_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
    )
    active = F.col("status") != "resolved"
    i = incidents.agg(
        F.count_if(active).alias("active_incidents"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical_active_incidents"),
        F.coalesce(F.max(F.when(active, F.col("occurrence_count"))), F.lit(0)).alias(
            "maximum_recurrence"
        ),
    )
    pairs_a = _unpivot(a)
    return pairs_a.unionByName(_unpivot(i))


def _unpivot(one_row: DataFrame) -> DataFrame:
    names = one_row.columns
    pairs = F.array(
        *[F.struct(F.lit(n).alias("panel"), F.col(n).cast("bigint").alias("value")) for n in names]
    )
    return one_row.select(F.explode(pairs).alias("p")).select("p.*")


def retention_predicate(older_than_days: int, status: str, now: str) -> Column:
    """Alerts of one status not seen for a number of days before ``now``."""
    if not 1 <= older_than_days <= 365_000:
        raise ValueError("older_than_days must be between 1 and 365000")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(older_than_days))
    return F.coalesce(
        (F.col("status") == status) & (F.col("last_seen") < cutoff), F.lit(False)
    )


def prune(
    alerts: DataFrame, *, older_than_days: int, now: str, status: str = "resolved"
) -> tuple[DataFrame, DataFrame]:
    """Alerts to keep, and one row with the removed and retained counts."""
    gone = retention_predicate(older_than_days, status, now)
    counts = alerts.agg(
        F.count_if(gone).alias("removed"), F.count_if(~gone).alias("retained")
    )
    return alerts.where(~gone), counts


def cascade_events(events: DataFrame, retained: DataFrame) -> DataFrame:
    """Lifecycle events of the alerts that are kept."""
    return events.join(retained.select("alert_id"), "alert_id", "left_semi")


_FAULTS = (
    "bad_status",
    "bad_count",
    "bad_id",
    "bad_time",
    "bad_risk",
    "duplicate_ids",
    "duplicate_fingerprints",
)


def verify_alerts(alerts: DataFrame) -> DataFrame:
    """One row of violation counts of a stored alert table, and ``valid``."""

    def fault(good: Column) -> Column:
        return F.count_if(~F.coalesce(good, F.lit(False)))

    checks = alerts.agg(
        F.count("*").alias("alert_count"),
        fault(F.col("status").isin(*ALERT_STATUSES)).alias("bad_status"),
        fault(F.col("occurrence_count") > 0).alias("bad_count"),
        fault(F.col("alert_id").rlike("^alrt_[0-9a-f]{24}$")).alias("bad_id"),
        fault(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).alias("bad_time"),
        fault(F.col("risk_score").between(0.0, 1.0)).alias("bad_risk"),
    )

    def repeats(key: str, name: str) -> DataFrame:
        counts = alerts.groupBy(key).agg(F.count("*").alias("n"))
        return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))

    one_row_each = (
        checks.unionByName(repeats("alert_id", "duplicate_ids"), allowMissingColumns=True)
        .unionByName(
            repeats("fingerprint", "duplicate_fingerprints"), allowMissingColumns=True
        )
    )
    row = one_row_each.agg(*[F.max(c).alias(c) for c in ("alert_count", *_FAULTS)])
    faults = F.col(_FAULTS[0])
    for name in _FAULTS[1:]:
        faults = faults + F.col(name)
    return row.withColumn("valid", faults == 0)


def store_info(alerts: DataFrame) -> DataFrame:
    """One row: number of alerts, number of files and their bytes.

    Sizes come from the file metadata the scan already knows.
    """
    per_file = alerts.groupBy(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count("*").alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("alert_count"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"),
        F.lit("parquet").alias("backend"),
    )

"""The usual chains of operators, from audit rows to incidents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from quillwatch.operators.alerts import collapse_occurrences, enrich_detections
from quillwatch.operators.detection import analyze, threshold
from quillwatch.operators.incidents import correlate
from quillwatch.operators.learning import assess
from quillwatch.operators.summaries import scan_summary
from quillwatch.sources.audit import (
    accepted,
    high_water_mark,
    normalize_events,
    quarantined,
    scan_audit,
)


@dataclass(frozen=True)
class ScanReport:
    """Lazy frames of one scan; each runs only when it is used."""

    detections: DataFrame
    summary: DataFrame
    rejected: DataFrame
    mark: DataFrame


def scan_report(
    relation: DataFrame,
    *,
    since: datetime | str | None = None,
    after_id: str | None = None,
    limit: int | None = None,
    min_risk: float = 0.0,
    min_severity: str | None = None,
) -> ScanReport:
    """Scan, normalize, score and filter; the mark covers the unfiltered rows."""
    rows = scan_audit(relation, since=since, after_id=after_id, limit=limit)
    events = normalize_events(rows)
    detections = threshold(analyze(accepted(events)), min_risk, min_severity)
    return ScanReport(
        detections, scan_summary(detections), quarantined(events), high_water_mark(rows)
    )


def alerts_from_audit(
    relation: DataFrame,
    *,
    batch_id: str,
    generated_at: str,
    min_risk: float = 0.7,
    min_severity: str | None = None,
) -> DataFrame:
    """Deduplicated alerts of a whole audit relation."""
    report = scan_report(relation, min_risk=min_risk, min_severity=min_severity)
    return collapse_occurrences(
        enrich_detections(report.detections, batch_id=batch_id, generated_at=generated_at)
    )


def incidents_from_alerts(alerts: DataFrame, *, window_minutes: int = 30) -> DataFrame:
    """Assessed incidents of an alert table."""
    return assess(correlate(alerts, window_minutes=window_minutes))

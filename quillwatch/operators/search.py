"""Filters, pages, lookups and display rows over alerts and incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.domains import (
    ALERT_STATUSES,
    INCIDENT_STATUSES,
    parse_severity,
    parse_status,
)
from quillwatch.functions.numeric import clamp_unit
from quillwatch.functions.text import casefold, preview

ALERT_SEARCH = ("alert_id", "username", "database", "client_ip", "classification", "query")
INCIDENT_SEARCH = (
    "incident_id",
    "title",
    "database",
    "actor",
    "source_system",
    "usernames",
    "client_ips",
    "classifications",
)


@dataclass(frozen=True)
class Page:
    """A page of rows, and lazily the number of all matches and the next offset."""

    rows: DataFrame
    matches: DataFrame
    limit: int
    offset: int

    def totals(self) -> DataFrame:
        """One row: total, limit, offset, next_offset (null on the last page)."""
        total = self.matches.agg(F.count("*").alias("total"))
        end = F.least(F.lit(self.offset + self.limit), F.greatest("total", F.lit(self.offset)))
        return total.select(
            "total",
            F.lit(self.limit).cast("bigint").alias("limit"),
            F.lit(self.offset).cast("bigint").alias("offset"),
            F.when(end < F.col("total"), end.cast("bigint")).alias("next_offset"),
        )


def page(matches: DataFrame, order: list[Column], limit: int, offset: int, most: int) -> Page:
    """Ordered page; ``orderBy + offset + limit`` keeps only offset+limit rows per task."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset cannot be negative")
    return Page(matches.orderBy(*order).offset(offset).limit(limit), matches, limit, offset)


def newest_first(frame: DataFrame, key: str) -> list[Column]:
    return [F.col("last_seen").desc(), F.col(key).asc()]


def _text(value: str | None) -> str | None:
    return (value or "").strip().casefold() or None


def _bounds(minimum_risk: float) -> None:
    if not 0.0 <= minimum_risk <= 1.0:
        raise ValueError("minimum_risk must be between 0.0 and 1.0")


def filter_alerts(
    alerts: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    minimum_risk: float = 0.0,
    search: str | None = None,
    search_mode: str = "like",
) -> DataFrame:
    """Alerts that match every given condition.

    ``search_mode="like"`` looks into each column on its own and leaves ``%`` and ``_``
    active; ``"substring"`` looks for the plain text in the six columns joined by blanks.
    Status and risk are compared on the stored columns, so they reach the parquet scan.
    """
    _bounds(minimum_risk)
    kept = alerts
    name = parse_status(status, ALERT_STATUSES)
    if name is not None:
        kept = kept.where(F.col("status") == name)
    wanted = _text(severity)
    if wanted is not None:
        kept = kept.where(F.lower("severity") == wanted)
    if minimum_risk > 0.0:
        kept = kept.where(F.col("risk_score") >= minimum_risk)
    needle = _text(search)
    if needle is None:
        return kept
    if search_mode == "like":
        pattern = f"%{needle}%".replace("\\", "\\\\")
        hits = [F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in ALERT_SEARCH]
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        return kept.where(any_hit)
    if search_mode == "substring":
        return kept.where(F.contains(casefold(F.concat_ws(" ", *ALERT_SEARCH)), F.lit(needle)))
    raise ValueError("search_mode must be like or substring")


def query_alerts(
    alerts: DataFrame, *, limit: int = 50, offset: int = 0, **conditions: object
) -> Page:
    """A page of matching alerts, newest first."""
    matches = filter_alerts(alerts, **conditions)  # type: ignore[arg-type]
    return page(matches, newest_first(alerts, "alert_id"), limit, offset, 100_000)


def explore_alerts(alerts: DataFrame, *, limit: int = 50, **conditions: object) -> DataFrame:
    """First matches of the substring search, newest first, as one-line display rows."""
    matches = filter_alerts(alerts, search_mode="substring", **conditions)  # type: ignore[arg-type]
    top = page(matches, newest_first(alerts, "alert_id"), limit, 0, 100_000).rows
    return display_rows(top, width=120)


def display_rows(alerts: DataFrame, width: int = 60) -> DataFrame:
    """One-line rows; the statement is collapsed and cut to ``width`` characters."""
    return alerts.select(
        "alert_id",
        "status",
        "occurrence_count",
        "last_seen",
        "severity",
        F.format_string("%.3f", clamp_unit(F.col("risk_score"))).alias("risk"),
        "username",
        "client_ip",
        "database",
        preview(F.col("query"), width).alias("query"),
    )


def get_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return lookup(alerts, "alert_id", alert_id, "Alert")


def get_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    return lookup(incidents, "incident_id", incident_id, "Incident")


def lookup(frame: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """The row with the key; a missing key stops the job when the result is used.

    The filter is a plain equality on a stored column, so it reaches the scan.
    """
    wanted = value.strip()
    if not wanted:
        raise ValueError(f"{what} identifier cannot be empty")
    found = frame.where(F.col(key) == wanted)
    whole = found.agg(F.first(F.struct("*"), ignorenulls=True).alias("row"))
    checked = whole.select(
        F.coalesce(
            "row",
            F.raise_error(F.lit(f"{what} not found: {wanted}")).cast(whole.schema["row"].dataType),
        ).alias("row")
    )
    return checked.select("row.*")


def filter_incidents(
    incidents: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    minimum_risk: float = 0.0,
    search: str | None = None,
) -> DataFrame:
    """Incidents that match every given condition."""
    _bounds(minimum_risk)
    kept = incidents
    name = parse_status(status, INCIDENT_STATUSES)
    if name is not None:
        kept = kept.where(F.col("status") == name)
    wanted = parse_severity(severity)
    if wanted is not None:
        kept = kept.where(F.lower("severity") == wanted)
    if minimum_risk > 0.0:
        kept = kept.where(F.col("risk_score") >= minimum_risk)
    needle = _text(search)
    if needle is not None:
        haystack = casefold(F.concat_ws(" ", *INCIDENT_SEARCH))
        kept = kept.where(F.contains(haystack, F.lit(needle)))
    return kept


def query_incidents(
    incidents: DataFrame, *, limit: int = 50, offset: int = 0, **conditions: object
) -> Page:
    """A page of matching incidents, newest first."""
    matches = filter_incidents(incidents, **conditions)  # type: ignore[arg-type]
    return page(matches, newest_first(incidents, "incident_id"), limit, offset, 1_000)

"""Ordered severities and the closed value sets of statuses and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwatch.functions.text import fold_key

# Severities from least to most serious.
SEVERITIES = ("info", "low", "medium", "high", "critical")
# Alert, incident and recommendation states, analyst decisions.
ALERT_STATUSES = ("new", "acknowledged", "resolved")
INCIDENT_STATUSES = ("open", "investigating", "resolved")
DECISIONS = ("accept", "reject", "revision_required")
RECOMMENDATION_STATUSES = (
    "proposed",
    "accepted",
    "rejected",
    "revision_required",
    "rolled_back",
)


def severity_rank(c: Column, unknown: int = 0) -> Column:
    """0 for info up to 4 for critical."""
    ladder = F.when(c == SEVERITIES[0], F.lit(0))
    for rank, name in enumerate(SEVERITIES[1:], start=1):
        ladder = ladder.when(c == name, F.lit(rank))
    return ladder.otherwise(F.lit(unknown))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def parse_severity(value: str | None) -> str | None:
    """Check a severity argument; raises for unknown names."""
    if value is None:
        return None
    name = value.strip().casefold()
    if name not in SEVERITIES:
        raise ValueError("severity must be one of: " + ", ".join(SEVERITIES))
    return name


def parse_status(value: str | None, allowed: tuple[str, ...] = ALERT_STATUSES) -> str | None:
    """Check a status argument; raises for unknown names."""
    if value is None:
        return None
    name = value.strip().casefold()
    if name not in allowed:
        raise ValueError("status must be one of: " + ", ".join(allowed))
    return name


def status_or_null(c: Column, allowed: tuple[str, ...] = ALERT_STATUSES) -> Column:
    """Null means ``new``; names outside the domain become null."""
    name = F.when(c.isNull(), F.lit("new")).otherwise(fold_key(c))
    return F.when(name.isin(*allowed), name)


def status_strict(c: Column, allowed: tuple[str, ...] = ALERT_STATUSES) -> Column:
    """Like :func:`status_or_null`, but an unknown name stops the job."""
    return F.coalesce(
        status_or_null(c, allowed),
        F.raise_error(F.concat(F.lit("Invalid status: "), F.coalesce(c, F.lit("null")))).cast(
            "string"
        ),
    )

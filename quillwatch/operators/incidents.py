"""Chaining alerts into incidents by source, database, actor and time.

A cluster of one actor ends where the next alert starts more than ``window`` after
everything before it has ended. Two alerts of one actor that start in the same
``window``-wide time cell can never be separated, so alerts are first reduced per actor,
cell and distinct names by an ordinary hash aggregate with map-side combine. The ordered
pass sees only those rows: their number depends on the time span and on how many names
an actor uses, not on the number of alerts, and a busy actor cannot overload a task.

Alerts that end before they start break that guarantee; each keeps a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.domains import (
    SEVERITIES,
    parse_severity,
    severity_name,
    severity_rank,
)
from quillwatch.functions.numeric import clamp_unit, positive_long, round_unit
from quillwatch.functions.text import (
    casefold,
    fold_key,
    json_ascii_string,
    json_object,
    json_string,
    optional_text,
    sha256_prefixed,
    strip,
    title_case,
)
from quillwatch.functions.times import iso_text
from quillwatch.operators.once import computed_once

KEY = ("source_system", "database", "actor")


def actor_of(null_ip_as_text: bool = False) -> Column:
    """Client address, or the user name where there is none."""
    ip = F.col("client_ip")
    if null_ip_as_text:
        ip = F.coalesce(ip, F.lit("none"))
    return F.coalesce(
        F.nullif(fold_key(ip), F.lit("")), F.nullif(fold_key(F.col("username")), F.lit("")),
        F.lit("unknown"),
    )


def _identity(name: str) -> Column:
    return F.coalesce(F.nullif(fold_key(F.col(name)), F.lit("")), F.lit("unknown"))


def _keyed(alerts: DataFrame, window_minutes: int, null_ip_as_text: bool) -> DataFrame:
    """Alerts with their correlation key, time cell and normalized measures."""
    if not 1 <= window_minutes <= 10_080:
        raise ValueError("window_minutes must be between 1 and 10080")
    width = window_minutes * 60_000_000
    epoch = F.timestamp_seconds(F.lit(0))
    has_time = "timestamp" in alerts.columns
    fallback = F.coalesce(F.col("timestamp"), epoch) if has_time else epoch
    first = F.coalesce(F.col("first_seen"), fallback)
    last = F.coalesce(F.col("last_seen"), fallback)
    start = F.unix_micros(first)
    severity = casefold(F.coalesce("severity", F.lit("info")))
    return alerts.select(
        "alert_id",
        _identity("source_system").alias("source_system"),
        _identity("database").alias("database"),
        actor_of(null_ip_as_text).alias("actor"),
        start.alias("start"),
        F.unix_micros(last).alias("stop"),
        # floor division, also right before 1970
        ((start - F.pmod(start, F.lit(width))) / F.lit(width)).cast("bigint").alias("cell"),
        F.when(last < first, F.col("alert_id")).alias("reversed_id"),
        severity_rank(severity).alias("severity_rank"),
        F.when(~severity.isin(*SEVERITIES), severity).alias("odd_severity"),
        clamp_unit(F.col("risk_score")).alias("risk_score"),
        positive_long(F.col("occurrence_count")).alias("occurrence_count"),
        casefold(F.coalesce("status", F.lit("new"))).alias("status"),
        F.coalesce(
            optional_text(F.coalesce("classification", F.lit("unclassified"))),
            F.lit("unclassified"),
        ).alias("classification"),
        # a blank but not empty name is kept as the empty text
        F.when(F.col("username") != "", strip(F.col("username"))).alias("username"),
        F.when(F.col("client_ip") != "", strip(F.col("client_ip"))).alias("client_ip"),
    )


_NAMES = ("username", "client_ip", "classification", "odd_severity")
_CELL = (*KEY, "cell", "reversed_id", *_NAMES)


def _cells(keyed: DataFrame) -> DataFrame:
    """One row per actor, time cell and distinct names, with the partial measures."""
    return keyed.groupBy(*_CELL).agg(
        F.min("start").alias("start"),
        F.max("start").alias("last_start"),
        F.max("stop").alias("stop"),
        F.max("severity_rank").alias("severity_rank"),
        F.max("risk_score").alias("risk_score"),
        F.count("*").alias("alert_count"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.max((F.col("status") == "new").cast("int")).alias("any_new"),
        F.max((F.col("status") == "acknowledged").cast("int")).alias("any_ack"),
    )


def _clustered(cells: DataFrame, window_minutes: int) -> DataFrame:
    """Cells with the number of the cluster they belong to."""
    width = window_minutes * 60_000_000
    # ties: the row that ends last goes first, as in a newest-first snapshot
    actor = Window.partitionBy(*KEY).orderBy(
        F.col("start"), F.col("stop").desc(), F.col("reversed_id").asc_nulls_first()
    )
    previous = actor.rowsBetween(Window.unboundedPreceding, -1)
    current = actor.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The maximum may run over all earlier clusters: whatever opened the current one lies
    # beyond their end plus the window, and so does every later start.
    reached = cells.withColumn("reach", F.max("stop").over(previous))
    opens = F.col("reach").isNull() | (F.col("start") > F.col("reach") + width)
    return reached.withColumn("cluster", F.sum(opens.cast("int")).over(current))


def _status(any_new: Column, any_ack: Column) -> Column:
    return F.when(any_new == 1, "open").when(any_ack == 1, "investigating").otherwise("resolved")


def incident_action(severity: Column, occurrences: Column) -> Column:
    """Advice by severity, then by recurrence."""
    return (
        F.when(
            severity == "critical",
            "Preserve evidence and initiate the human-controlled incident-response procedure.",
        )
        .when(
            severity == "high",
            "Escalate for immediate analyst review and validate containment options.",
        )
        .when(
            occurrences >= 3,
            "Review recurrence, tune controls and maintain enhanced monitoring.",
        )
        .otherwise("Continue analyst review and monitor for correlated activity.")
    )


def incident_id_of(first_seen: Column) -> Column:
    """Identifier from the correlation key and the start of the cluster."""
    return sha256_prefixed(
        "inc_",
        json_object(
            {
                "actor": json_ascii_string(F.col("actor")),
                "cluster_start": json_string(iso_text(first_seen)),
                "database": json_ascii_string(F.col("database")),
                "source_system": json_ascii_string(F.col("source_system")),
            }
        ),
    )


def correlate(
    alerts: DataFrame, *, window_minutes: int = 30, null_ip_as_text: bool = False
) -> DataFrame:
    """Incidents with their counts, worst severity, status, and sorted distinct names.

    The alert ids are not an array column here, because an incident can hold any number
    of alerts; :func:`incident_members` gives them as rows.
    """
    cells = _cells(_keyed(alerts, window_minutes, null_ip_as_text))
    rows = cells.withColumn("low_severity", F.coalesce("odd_severity", F.lit("info")))
    rolled = _clustered(rows, window_minutes).groupBy(*KEY, "cluster").agg(
        *cluster_measures(),
        F.array_sort(F.collect_set("username")).alias("usernames"),
        F.array_sort(F.collect_set("client_ip")).alias("client_ips"),
        F.array_sort(F.collect_set("classification")).alias("classifications"),
    )
    return incident_rows(rolled, window_minutes).select(
        *INCIDENT_FIELDS[:-1], "usernames", "client_ips", "classifications", INCIDENT_FIELDS[-1]
    )


#: Columns of a cluster that parts of it are added up to; see ``cluster_measures``.
CLUSTER = (
    "source_system string, database string, actor string, start bigint, last_start bigint, "
    "stop bigint, severity_rank int, low_severity string, risk_score double, alert_count bigint, "
    "occurrence_count bigint, any_new int, any_ack int"
)


def cluster_measures() -> list[Column]:
    """Measures of a cluster from its cells, or from clusters that became one."""
    return [
        F.min("start").alias("start"),
        F.max("last_start").alias("last_start"),
        F.max("stop").alias("stop"),
        F.max("severity_rank").alias("severity_rank"),
        F.min(F.struct("start", "low_severity")).getField("low_severity").alias("low_severity"),
        F.max("risk_score").alias("risk_score"),
        F.sum("alert_count").alias("alert_count"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.max("any_new").alias("any_new"),
        F.max("any_ack").alias("any_ack"),
    ]


INCIDENT_FIELDS = (
    "incident_id", "title", "status", "severity", "risk_score", "alert_count", "occurrence_count",
    "first_seen", "last_seen", "correlation_window_minutes", *KEY, "recommended_action",
)


def incident_rows(clusters: DataFrame, window_minutes: int) -> DataFrame:
    """The given clusters with the fields of an incident (INCIDENT_FIELDS), others kept."""
    severity = F.when(
        F.col("severity_rank") > 0, severity_name(F.col("severity_rank"))
    ).otherwise(F.col("low_severity"))
    timed = clusters.withColumns(
        {
            "first_seen": F.timestamp_micros("start"),
            "last_seen": F.timestamp_micros("stop"),
            "severity": severity,
        }
    )
    about = F.concat(
        title_case(F.col("severity")), F.lit(" database-security activity on "), F.col("database")
    )
    return computed_once(timed, incident_id=incident_id_of(F.col("first_seen"))).withColumns(
        {
            "title": about,
            "status": _status(F.col("any_new"), F.col("any_ack")),
            "risk_score": round_unit(F.col("risk_score"), 4),
            "correlation_window_minutes": F.lit(window_minutes),
            "recommended_action": incident_action(F.col("severity"), F.col("occurrence_count")),
        }
    )


#: Names that an incident has any number of, and the column each kind is taken from.
NAME_KINDS = ("username", "client_ip", "classification")


def cell_names(cells: DataFrame) -> DataFrame:
    """``cells`` with a row (kind, name) for each name of a cell."""
    kinds = F.array(
        *(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in NAME_KINDS)
    )
    return (
        cells.withColumn("_named", F.explode(kinds))
        .withColumns({"kind": F.col("_named.kind"), "name": F.col("_named.name")})
        .where(F.col("name").isNotNull())
        .drop("_named")
    )


def incident_names(
    alerts: DataFrame, *, window_minutes: int = 30, null_ip_as_text: bool = False
) -> DataFrame:
    """``incident_id, kind, name``: user names, addresses and classes as rows.

    A pooled address may have any number of users; arrays of them belong on a page only
    (``with_names``).
    """
    cells = _clustered(_cells(_keyed(alerts, window_minutes, null_ip_as_text)), window_minutes)
    start = F.min("start").over(Window.partitionBy(*KEY, "cluster"))
    opened = cells.withColumn("first_seen", F.timestamp_micros(start))
    named = cell_names(opened).groupBy(*KEY, "first_seen", "kind", "name").agg(F.lit(1))
    return named.select(incident_id_of(F.col("first_seen")).alias("incident_id"), "kind", "name")


def with_names(incidents: DataFrame, names: DataFrame) -> DataFrame:
    """Attach sorted arrays of names; meant for one incident or one page of them."""
    plural = dict(zip(NAME_KINDS, ("usernames", "client_ips", "classifications"), strict=True))
    arrays = (
        names.join(incidents.select("incident_id"), "incident_id", "left_semi")
        .groupBy("incident_id")
        .agg(
            *(
                F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(out)
                for kind, out in plural.items()
            )
        )
    )
    filled = {c: F.coalesce(c, F.array().cast("array<string>")) for c in plural.values()}
    return incidents.join(arrays, "incident_id", "left").withColumns(filled)


def incident_members(
    alerts: DataFrame, *, window_minutes: int = 30, null_ip_as_text: bool = False
) -> DataFrame:
    """``incident_id, alert_id`` for every alert.

    Alerts meet the clusters on actor, cell and names. A cell that holds very many alerts
    is a large partition on one side only, which adaptive execution splits.
    """
    keyed = _keyed(alerts, window_minutes, null_ip_as_text)
    cells = _clustered(_cells(keyed), window_minutes)
    start = F.min("start").over(Window.partitionBy(*KEY, "cluster"))
    lookup = cells.withColumn("first_seen", F.timestamp_micros(start)).select(
        *_CELL, incident_id_of(F.col("first_seen")).alias("incident_id")
    )
    condition = [keyed[c].eqNullSafe(lookup[c]) for c in _CELL]
    return keyed.join(lookup, condition).select("incident_id", "alert_id")


def with_alert_ids(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Attach the sorted alert ids; meant for one incident or one page of them."""
    ids = (
        members.join(incidents.select("incident_id"), "incident_id", "left_semi")
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    )
    return incidents.join(ids, "incident_id", "left")


def newest_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.col("last_seen").desc(), "incident_id")


def notification_rows(assessed: DataFrame, record_type: str = "incident_notification") -> DataFrame:
    """The fields that may leave the system: no statements, users or alert ids."""
    return assessed.select(
        F.lit(record_type).alias("type"),
        "incident_id",
        "title",
        "status",
        "severity",
        "risk_score",
        "alert_count",
        "occurrence_count",
        iso_text(F.col("first_seen")).alias("first_seen"),
        iso_text(F.col("last_seen")).alias("last_seen"),
        "database",
        "source_system",
        "classifications",
        F.col("triple_loop.escalation_required").alias("escalation_required"),
        F.col("triple_loop.human_approval_required").alias("human_approval_required"),
    )


def notify_selection(incidents: DataFrame, minimum_severity: str = "high") -> DataFrame:
    """Unresolved incidents at or above a severity."""
    floor = severity_rank(F.lit(parse_severity(minimum_severity)))
    return incidents.where(
        (F.col("status") != "resolved") & (severity_rank(F.col("severity")) >= floor)
    )

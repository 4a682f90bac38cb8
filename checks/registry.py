"""Queries over the whole given tables, each with its checking SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.oracles import ROUND4, action_case, iso, rank, sql
from quillwatch.functions.text import escape_label
from quillwatch.operators import (
    alert_rules,
    alerts,
    audit_chain,
    detection,
    feedback,
    incidents,
    learning,
    lifecycle,
    metrics,
    search,
    summaries,
    throttle,
)
from quillwatch.plans import exports, reports
from quillwatch.plans.store import AlertStore
from quillwatch.session import checkpoint_dir
from quillwatch.sources import alert_log
from quillwatch.sources import audit as audit_source
from quillwatch.streaming.incident_table import IncidentTable, watch_incidents
from quillwatch.streaming.watch import late_counts, watch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = v.one_query(lambda spark, sf: v.plain(query(spark, sf)))
    if oracle is not None:
        ORACLES[name] = oracle


# ---------------------------------------------------------------- scans and normalization

SINCE = "2024-01-10 00:00:00"
EVENT_SQL = (
    "event_id, query, username, database, source_system, client_ip, duration_ms, rows_affected, "
    'ts AS "timestamp"'
)

register(
    "audit_scan_page",
    lambda s, d: audit_source.scan_audit(v.audit(s, d), since=SINCE, limit=1000),
    sql(f"SELECT * FROM audit WHERE event_time > TIMESTAMP '{SINCE}' "
        "ORDER BY event_time, event_id LIMIT 1000", "audit"),
)
register(
    "audit_scan_since",
    lambda s, d: audit_source.scan_audit(v.audit(s, d), since=SINCE),
    sql(f"SELECT * FROM audit WHERE event_time > TIMESTAMP '{SINCE}'", "audit"),
)
register(
    "high_water_mark",
    lambda s, d: audit_source.high_water_mark(v.audit(s, d)),
    sql("SELECT event_time, event_id FROM audit ORDER BY event_time DESC, event_id DESC LIMIT 1",
        "audit"),
)
register("normalized_events", v.events, sql(f"SELECT {EVENT_SQL} FROM ev", "ev"))
register(
    "quarantined_events",
    lambda s, d: audit_source.quarantined(
        audit_source.normalize_events(v.bad_audit(s, d))
    ).select("event_id", "violations"),
    sql("""SELECT event_id, array_to_string(list_filter([
          CASE WHEN trim(query_text) = '' THEN 'query is empty' END,
          CASE WHEN trim(username) = '' THEN 'username is empty' END,
          CASE WHEN coalesce(trim(database_name), '') = '' THEN 'database is empty' END,
          CASE WHEN duration_ms < 0 THEN 'duration_ms is negative' END], lambda z: z IS NOT NULL),
          '|') AS violations FROM bad
        WHERE trim(query_text) = '' OR trim(username) = '' OR database_name IS NULL
          OR duration_ms < 0""", "bad"),
)
register(
    "late_rows",
    lambda s, d: _late(s, d),
    sql("SELECT count(*) FILTER (event_time <= TIMESTAMP '2024-01-10 00:00:00') AS late_rows, "
        "count(*) FILTER (event_time > TIMESTAMP '2024-01-10 00:00:00') AS fresh_rows FROM audit",
        "audit"),
)


def _late(spark: SparkSession, sf: str) -> DataFrame:
    return late_counts(
        v.audit(spark, sf).withColumn("event_time", F.col("event_time").cast("timestamp")),
        "2024-01-10T00:00:00+00:00",
    )


# ---------------------------------------------------------------- rules, scores, decisions

DECISION_SQL = f"""SELECT event_id, risk_score, severity, classification,
  array_to_string(indicators, '|') AS indicators,
  CASE WHEN len(indicators) = 0 THEN
    'No suspicious SQL pattern was identified by the {detection.DETECTOR_NAME} detector.'
  ELSE 'The event received a risk score of ' || format('{{:.2f}}', risk_score) || '. ' ||
    array_to_string(indicators, ' ') END AS explanation,
  {action_case()} AS recommended_action, CAST(NULL AS VARCHAR) AS automatic_action FROM scored"""

register(
    "decisions",
    lambda s, d: detection.decisions(v.analyzed(s, d)),
    sql(DECISION_SQL, "scored"),
)
for _position, _rule in enumerate(detection.DEFAULT_RULES, start=1):
    register(
        "rule_" + _rule.name.replace("-", "_"),
        lambda s, d, rule=_rule: detection.match_rules(v.events(s, d), [rule])
        .where("rule_mask = 1")
        .select("event_id", "query"),
        sql(f"SELECT event_id, query FROM hits WHERE r{_position}", "hits"),
    )
register(
    "threshold_high",
    lambda s, d: detection.threshold(v.detected(s, d), 0.7, "high").select(
        "event_id", "risk_score", "severity"
    ),
    sql(f"SELECT event_id, risk_score, severity FROM scored WHERE risk_score >= 0.7e0 AND "
        f"{rank('severity')} >= 3", "scored"),
)
register(
    "anomalous_events",
    lambda s, d: v.analyzed(s, d).where("is_anomalous").select("event_id", "risk_score"),
    sql("SELECT event_id, risk_score FROM scored WHERE risk_score >= 0.5e0", "scored"),
)
register(
    "rule_report",
    lambda s, d: detection.rule_report(v.events(s, d)),
    sql("""SELECT CASE description """
        + " ".join(f"WHEN '{r.description}' THEN '{r.name}'" for r in detection.DEFAULT_RULES)
        + """ END AS rule, description, count(*) AS hits, count(DISTINCT username) AS actors,
        CAST(sum(CAST(round(risk_score * 10000) AS BIGINT)) AS BIGINT) / 10000e0 / count(*)
          AS mean_score FROM (SELECT username, risk_score, unnest(indicators) AS description
          FROM scored) GROUP BY description""", "scored"),
)
register(
    "flat_records",
    lambda s, d: alerts.flat_records(v.detections(s, d)),
    sql(f"""SELECT {iso('ts')} AS "timestamp", username, database, source_system, client_ip, query,
        risk_score, severity, classification FROM scored WHERE risk_score >= 0.5e0""", "scored"),
)
register(
    "scan_summary",
    lambda s, d: summaries.scan_summary(v.detected(s, d)),
    sql("""SELECT count(*) AS events_analyzed,
        CAST(sum(CAST(round(risk_score * 10000) AS BIGINT)) AS BIGINT) / 10000e0 / count(*)
          AS average_risk, max(risk_score) AS maximum_risk, """
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count"
                    for s in ("info", "low", "medium", "high", "critical"))
        + " FROM scored", "scored"),
)
register(
    "severity_counts",
    lambda s, d: summaries.severity_counts(
        reports.scan_report(v.audit(s, d), min_risk=0.7).detections
    ),
    sql("SELECT severity, count(*) AS events FROM scored WHERE risk_score >= 0.7e0 GROUP BY 1",
        "scored"),
)


def _slow_detector(events: DataFrame) -> DataFrame:
    """A replacement detector that rates statements by their duration."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("duration_ms") / F.lit(512.0)))
    return events.withColumn("risk_score", score).withColumns(
        {
            "severity": detection.severity_of(F.col("risk_score")),
            "classification": F.lit("slow_sql_activity"),
            "indicators": F.array(F.lit("Slow statement.")),
            "detector_name": F.lit("duration"),
        }
    )


register(
    "custom_detector",
    lambda s, d: detection.analyze(v.events(s, d), detector=_slow_detector).select(
        "event_id", "risk_score", "severity", "classification", "is_anomalous"
    ),
    sql("""SELECT event_id, least(1e0, greatest(0e0, duration_ms / 512e0)) AS risk_score,
        CASE WHEN duration_ms / 512e0 >= 0.9e0 THEN 'critical' WHEN duration_ms / 512e0 >= 0.75e0
        THEN 'high' WHEN duration_ms / 512e0 >= 0.5e0 THEN 'medium' WHEN duration_ms > 0 THEN 'low'
        ELSE 'info' END AS severity, 'slow_sql_activity' AS classification,
        duration_ms / 512e0 >= 0.5e0 AS is_anomalous FROM ev""", "ev"),
)
_EXTRA = detection.Rule("select-star", r"\bSELECT\s+\*", 0.3, "All columns selected.", ("select",))
register(
    "custom_rule",
    lambda s, d: detection.match_rules(v.events(s, d), [_EXTRA]).where("rule_mask = 1").select(
        "event_id"
    ),
    sql(r"SELECT event_id FROM ev WHERE regexp_matches(query, '(?i)\bSELECT\s+\*')", "ev"),
)
# Many rules, boundaries beside groups, classes and escapes, and weights that give exact ties.
_SHAPES = (
    (r"\b(orders_{0}|t_{0})\b", r"\b(orders_{0}|t_{0})\b"),
    (r"\b\w+\s+from\s+orders_{0}", r"\b\w+\s+from\s+orders_{0}"),
    (r"from\s+\b[a-z]+_{0}\b", r"from\s+\b[a-z]+_{0}\b"),
    (r"(table)\b\s+\bt_{0}\b", r"(table)\b\s+\bt_{0}\b"),
)
_TIES = (0.03125, 0.09375, 0.00005, 0.25)


def _many(count: int) -> list[detection.Rule]:
    return [
        detection.Rule(
            f"many-{i}", _SHAPES[i % 4][0].format(i % 7), _TIES[i % 4], f"Rule {i} fired."
        )
        for i in range(count)
    ]


def _many_sql(count: int) -> str:
    terms = " * ".join(
        f"CASE WHEN regexp_matches(query, '(?i){_SHAPES[i % 4][1].format(i % 7)}') "
        f"THEN {1.0 - _TIES[i % 4]!r}e0 ELSE 1e0 END"
        for i in range(count)
    )
    return (
        f"SELECT event_id, {ROUND4} AS risk_score FROM "
        f"(SELECT event_id, 1e0 - (1e0 * {terms}) AS x FROM ev)"
    )


def _many_report_sql(count: int) -> str:
    hits = " UNION ALL ".join(
        f"SELECT event_id, username, 'many-{i}' AS rule, 'Rule {i} fired.' AS description "
        f"FROM ev WHERE regexp_matches(query, '(?i){_SHAPES[i % 4][1].format(i % 7)}')"
        for i in range(count)
    )
    return (
        f"SELECT rule, description, count(*) AS hits, count(DISTINCT username) AS actors, "
        "CAST(sum(CAST(round(risk_score * 10000) AS BIGINT)) AS BIGINT) / 10000e0 / count(*) "
        f"AS mean_score FROM ({hits}) JOIN ({_many_sql(count)}) USING (event_id) GROUP BY ALL"
    )


for _count in (20, 70):
    register(
        f"rules_{_count}",
        lambda s, d, n=_count: detection.detect(v.events(s, d), _many(n)).select(
            "event_id", "risk_score"
        ),
        sql(_many_sql(_count), "ev"),
    )
    register(
        f"rule_report_{_count}",
        lambda s, d, n=_count: detection.rule_report(v.events(s, d), _many(n)),
        sql(_many_report_sql(_count), "ev"),
    )


def _sql_ties(spark: SparkSession, sf: str) -> DataFrame:
    detection.sql_functions(spark, _many(4))
    v.events(spark, sf).createOrReplaceTempView("quillwatch_events")
    return spark.sql("SELECT event_id, risk_score(query) AS risk_score FROM quillwatch_events")


register("sql_risk_score_ties", _sql_ties, sql(_many_sql(4), "ev"))


def _sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    detection.sql_functions(spark)
    v.events(spark, sf).createOrReplaceTempView("quillwatch_events")
    return spark.sql(
        "SELECT event_id, risk_score(query) AS risk_score, risk_severity(query) AS severity "
        "FROM quillwatch_events"
    )


register(
    "sql_functions",
    _sql_functions,
    sql("SELECT event_id, risk_score, severity FROM scored", "scored"),
)

# ---------------------------------------------------------------- alerts

OCC_COLUMNS = """event_id AS occurrence_key, alert_id, 'new' AS status,
  CAST(1 AS BIGINT) AS occurrence_count, ts AS first_seen, ts AS last_seen, fingerprint, severity,
  risk_score, database, username, client_ip, classification, source_system, query,
  'batch-1' AS batch_id, TIMESTAMP '2024-02-01 00:00:00' AS generated_at"""
ALERT_SQL = """alert_id, fingerprint, occurrence_count, first_seen, last_seen, severity, risk_score,
  database, username, client_ip, classification, source_system, query"""
_ALERT_NAMES = [c.strip() for c in ALERT_SQL.split(",")]
LIFE_SQL = "status, updated_by, status_note, status_updated_at, last_action"
_LIFE_NAMES = [c.strip() for c in LIFE_SQL.split(",")]

register("occurrences", v.occurrences, sql(f"SELECT {OCC_COLUMNS} FROM occ", "occ"))
register(
    "deduplicated_alerts",
    lambda s, d: v.alerts(s, d).select(*_ALERT_NAMES),
    sql(f"SELECT {ALERT_SQL} FROM al", "al"),
)
register(
    "lifecycle_effects",
    lambda s, d: v.bare_timeline(s, d)
    .where("kind <> 'occurrence' or effect <> 'occurrence'")
    .withColumnRenamed("at", "moment"),
    sql("SELECT alert_id, step_key, moment, kind, effect, actor, note FROM fsm "
        "WHERE kind <> 'occurrence' OR effect <> 'occurrence'", "fsm"),
)
register(
    "rejected_actions",
    lambda s, d: lifecycle.rejected_actions(v.bare_timeline(s, d)).select("alert_id", "step_key"),
    sql("SELECT alert_id, step_key FROM fsm WHERE effect = 'rejected'", "fsm"),
)
register(
    "lifecycle_states",
    lambda s, d: v.states(s, d).select(*_ALERT_NAMES, *_LIFE_NAMES),
    sql(f"SELECT {ALERT_SQL}, {LIFE_SQL} FROM states", "states"),
)
register(
    "lifecycle_events",
    lambda s, d: lifecycle.lifecycle_events(v.recorded_steps(s, d), v.bare_timeline(s, d)).drop(
        "batch_id"
    ),
    sql("""SELECT alert_id, step_key, effect AS event_type, moment AS "timestamp",
        CASE WHEN effect = 'reopened' THEN 'system' ELSE actor END AS actor,
        CASE WHEN effect = 'reopened' THEN
          'A new matching database event reopened the resolved alert.' ELSE note END AS note
        FROM fsm WHERE effect <> 'rejected'""", "fsm"),
)

MIDDLE = "2024-01-16 00:00:00"
GENERATED_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """State after the first half of the month, and the second half as a batch."""
    whole = v.occurrences(spark, sf)
    early = whole.where(F.col("last_seen") < F.lit(MIDDLE).cast("timestamp"))
    late = whole.where(F.col("last_seen") >= F.lit(MIDDLE).cast("timestamp"))
    state = alerts.collapse_occurrences(early)
    closed = F.substring("alert_id", 6, 1).isin("0", "1", "2", "3", "4")
    return (
        state.withColumns(
            {
                "status": F.when(closed, "resolved").otherwise("new"),
                "updated_by": F.when(closed, "analyst"),
                "status_note": F.lit(None).cast("string"),
                "status_updated_at": F.when(closed, F.col("last_seen")),
                "last_action": F.when(closed, "resolved"),
            }
        ),
        late,
    )


_HALF_SQL = f"""SELECT b.alert_id, CASE WHEN s.alert_id IS NULL OR s.closed THEN 'new' ELSE 'new' END
  AS status, b.n + coalesce(s.n, 0) AS occurrence_count, least(b.f, s.f) AS first_seen,
  greatest(b.l, s.l) AS last_seen,
  CASE WHEN s.closed THEN 'system' END AS updated_by,
  CASE WHEN s.closed THEN {GENERATED_SQL} END AS status_updated_at,
  CASE WHEN s.closed THEN 'reopened' END AS last_action,
  CASE WHEN s.alert_id IS NULL THEN 'created' WHEN s.closed THEN 'reopened' ELSE 'occurrence' END
    AS event_type
FROM (SELECT alert_id, count(*) AS n, min(ts) AS f, max(ts) AS l FROM occ
      WHERE ts >= TIMESTAMP '{MIDDLE}' GROUP BY 1) b
LEFT JOIN (SELECT alert_id, count(*) AS n, min(ts) AS f, max(ts) AS l,
      substr(min(alert_id), 6, 1) IN ('0', '1', '2', '3', '4') AS closed FROM occ
      WHERE ts < TIMESTAMP '{MIDDLE}' GROUP BY 1) s USING (alert_id)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    state, batch = _halves(spark, sf)
    return alerts.merge_batch(state, batch, generated_at=v.GENERATED)


register(
    "batch_merge",
    lambda s, d: _merged(s, d).select(
        "alert_id", "status", "occurrence_count", "first_seen", "last_seen", "updated_by",
        "status_updated_at", "last_action", "event_type",
    ),
    sql(_HALF_SQL, "occ"),
)
register(
    "batch_events",
    lambda s, d: alerts.batch_events(_halves(s, d)[1], _merged(s, d))
    .groupBy("event_type", "actor")
    .agg(F.count("*").alias("events"), F.countDistinct("event_key").alias("keys")),
    sql(f"""SELECT event_type, CASE WHEN event_type = 'reopened' THEN 'system' END AS actor,
        CAST(sum(n) AS BIGINT) AS events, CAST(sum(n) AS BIGINT) AS keys FROM (
          SELECT event_type, count(*) AS n FROM ({_HALF_SQL}) GROUP BY 1
          UNION ALL SELECT 'occurrence', count(*) - (SELECT count(*) FROM ({_HALF_SQL}))
            FROM occ WHERE ts >= TIMESTAMP '{MIDDLE}') GROUP BY 1""", "occ"),
)
register(
    "upserted_state",
    lambda s, d: alerts.upsert(_halves(s, d)[0], _merged(s, d)).select(
        "alert_id", "occurrence_count", "last_seen"
    ),
    sql("SELECT alert_id, count(*) AS occurrence_count, max(ts) AS last_seen FROM occ GROUP BY 1",
        "occ"),
)
register(
    "batch_restriction",
    lambda s, d: alerts.restrict_to_batch(v.alerts(s, d), _halves(s, d)[1]).select("alert_id"),
    sql(f"SELECT DISTINCT alert_id FROM occ WHERE ts >= TIMESTAMP '{MIDDLE}'", "occ"),
)


def _imported(spark: SparkSession, sf: str) -> DataFrame:
    return v.states(spark, sf).where("severity = 'high'").withColumns(
        {"occurrence_count": F.col("occurrence_count") * 100, "batch_id": F.lit("import")}
    )


register(
    "merge_import",
    lambda s, d: alerts.merge_import(v.states(s, d), _imported(s, d)).select(
        "alert_id", "occurrence_count", "batch_id"
    ),
    sql("""SELECT alert_id, CASE WHEN severity = 'high' THEN occurrence_count * 100 ELSE
        occurrence_count END AS occurrence_count, CASE WHEN severity = 'high' THEN 'import' ELSE
        'batch-1' END AS batch_id FROM al""", "al"),
)
register(
    "imported_events",
    lambda s, d: alerts.imported_events(_imported(s, d)).select(
        "alert_id", "event_type", "timestamp", "actor", "batch_id"
    ),
    sql("""SELECT alert_id, 'migrated' AS event_type, last_seen AS "timestamp", 'system' AS actor,
        'import' AS batch_id FROM al WHERE severity = 'high'""", "al"),
)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """States in which analysts only acknowledge nothing: all new, a third resolved."""
    closed = F.substring("alert_id", 6, 1).isin("a", "b", "c", "d", "e", "f")
    return v.alerts(spark, sf).withColumns(
        {
            "status": F.when(closed, "resolved").otherwise("new"),
            **{
                c: F.lit(None).cast("string")
                for c in ("updated_by", "status_note", "last_action")
            },
            "status_updated_at": F.lit(None).cast("timestamp"),
        }
    )


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    """Every alert gets an acknowledge, a second one and a resolve, some in other order."""
    steps = F.array(
        F.struct(F.lit("acknowledged").alias("action"), F.lit(1).alias("k")),
        F.struct(F.lit("acknowledged").alias("action"), F.lit(2).alias("k")),
        F.struct(
            F.lit("resolved").alias("action"),
            F.when(F.substring("alert_id", 7, 1) < "8", F.lit(0)).otherwise(F.lit(3)).alias("k"),
        ),
    )
    return v.alerts(spark, sf).select("alert_id", "last_seen", F.explode(steps).alias("p")).select(
        "alert_id",
        F.concat_ws("/", "alert_id", "p.k").alias("action_key"),
        F.col("p.action").alias("action"),
        (F.col("last_seen") + F.make_dt_interval(hours=F.col("p.k"))).alias("at"),
        F.lit("analyst").alias("actor"),
        F.lit(None).cast("string").alias("note"),
    )


_VERDICT_SQL = """SELECT alert_id, alert_id || '/' || k AS action_key, action,
  CASE WHEN substr(alert_id, 6, 1) IN ('a','b','c','d','e','f')
    THEN 'a resolved alert cannot be modified until it is reopened'
  WHEN substr(alert_id, 7, 1) < '8' THEN CASE WHEN k = 0 THEN 'accepted' ELSE
    'a resolved alert cannot be modified until it is reopened' END
  WHEN k = 2 THEN 'alert is already acknowledged' ELSE 'accepted' END AS verdict
FROM (SELECT alert_id, 'acknowledged' AS action, 1 AS k FROM al
  UNION ALL SELECT alert_id, 'acknowledged', 2 FROM al
  UNION ALL SELECT alert_id, 'resolved', CASE WHEN substr(alert_id, 7, 1) < '8' THEN 0 ELSE 3 END
    FROM al)"""
register(
    "status_verdicts",
    lambda s, d: lifecycle.update_statuses(_stored(s, d), _requested(s, d))[1].select(
        "alert_id", "action_key", "action", "verdict"
    ),
    sql(_VERDICT_SQL, "al"),
)
register(
    "status_updates",
    lambda s, d: lifecycle.update_statuses(_stored(s, d), _requested(s, d))[0].select(
        "alert_id", "status", "last_action", "updated_by"
    ),
    sql("""SELECT alert_id, 'resolved' AS status, 'resolved' AS last_action, 'analyst' AS updated_by
        FROM al WHERE substr(alert_id, 6, 1) NOT IN ('a','b','c','d','e','f')""", "al"),
)

# ---------------------------------------------------------------- log replay


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The detections and analyst actions as lines of one log, with blank lines between."""
    occurrence = exports.batch_records(
        v.occurrences(spark, sf).select(
            "occurrence_key", "username", "database", "source_system", "client_ip", "query",
            "risk_score", "severity", "classification", "batch_id", "first_seen",
        )
    )
    rows = occurrence.select(
        (F.unix_micros(F.col("first_seen").cast("timestamp")) * 2).alias("line_no"),
        F.to_json(F.struct(*[c for c in occurrence.columns if c != "first_seen"])).alias("raw"),
    )
    act = v.actions(spark, sf)
    updates = act.select(
        (F.unix_micros("at") * 2 + 1).alias("line_no"),
        F.to_json(
            F.struct(
                F.lit("alert_update").alias("type"), "alert_id",
                F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                "action", F.col("action").alias("status"), "actor", "note",
            ),
            {"ignoreNullFields": "false"},
        ).alias("raw"),
    )
    blanks = rows.where(F.col("line_no") % 50 == 0).select(
        F.col("line_no") - 1, F.lit("   ").alias("raw")
    )
    return rows.unionByName(updates).union(blanks).withColumn("file", F.lit("log"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return alert_log.parse_log_lines(_log_lines(spark, sf))


register(
    "log_records",
    lambda s, d: _records(s, d)
    .groupBy(F.col("record.type").alias("type"))
    .agg(F.count("*").alias("records")),
    sql("SELECT 'alert' AS type, count(*) AS records FROM occ UNION ALL "
        "SELECT 'alert_update', count(*) FROM act", "occ", "act"),
)
register(
    "upgraded_records",
    lambda s, d: alert_log.log_occurrences(_records(s, d)).select(
        "alert_id", "fingerprint", "status", "occurrence_count", "first_seen", "last_seen",
        "risk_score",
    ),
    sql("""SELECT alert_id, fingerprint, 'new' AS status, CAST(1 AS BIGINT) AS occurrence_count,
        ts AS first_seen, ts AS last_seen, risk_score FROM occ""", "occ"),
)
# In a log an update simply applies; nothing is refused and nothing reopens by itself.
register(
    "log_replay",
    lambda s, d: lifecycle.replay_log(
        alert_log.log_occurrences(_records(s, d)), alert_log.log_updates(_records(s, d))
    ).select(
        "alert_id", "fingerprint", "status", "occurrence_count", "first_seen", "last_seen",
        "query", "updated_by", "status_note", "status_updated_at", "last_action",
    ),
    sql("""SELECT al.alert_id, al.fingerprint, coalesce(u.action, 'new') AS status,
        al.occurrence_count, al.first_seen, al.last_seen, al.query, u.actor AS updated_by,
        n.note AS status_note, u.moment AS status_updated_at, u.action AS last_action FROM al
        LEFT JOIN (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY alert_id
          ORDER BY moment DESC) = 1) u USING (alert_id)
        LEFT JOIN (SELECT * FROM act WHERE note IS NOT NULL QUALIFY row_number() OVER (
          PARTITION BY alert_id ORDER BY moment DESC) = 1) n USING (alert_id)""", "al", "act"),
)

# ---------------------------------------------------------------- search and pages

SEARCH_LIKE = ("lower(alert_id) LIKE '%{0}%' OR lower(username) LIKE '%{0}%' OR "
               "lower(database) LIKE '%{0}%' OR coalesce(lower(client_ip) LIKE '%{0}%', FALSE) OR "
               "lower(classification) LIKE '%{0}%' OR lower(query) LIKE '%{0}%'")
register(
    "alert_search_like",
    lambda s, d: search.filter_alerts(
        v.states(s, d), status="new", severity="High", minimum_risk=0.6, search="T_1"
    ).select("alert_id", "query"),
    sql("SELECT alert_id, query FROM states WHERE status = 'new' AND severity = 'high' AND "
        f"risk_score >= 0.6e0 AND ({SEARCH_LIKE.format('t_1')})", "states"),
)
register(
    "alert_search_substring",
    lambda s, d: search.filter_alerts(
        v.states(s, d), search="sales 192.0.2.1", search_mode="substring"
    ).select("alert_id", "database"),
    sql("SELECT alert_id, database FROM states WHERE contains(lower(concat_ws(' ', alert_id, "
        "username, database, client_ip, classification, query)), 'sales 192.0.2.1')", "states"),
)
_PAGE_SQL = "ORDER BY last_seen DESC, alert_id LIMIT 50 OFFSET 10"
register(
    "alert_page",
    lambda s, d: search.query_alerts(
        v.states(s, d), severity="critical", limit=50, offset=10
    ).rows.select("alert_id", "last_seen", "status"),
    sql(f"SELECT alert_id, last_seen, status FROM states WHERE severity = 'critical' {_PAGE_SQL}",
        "states"),
)
register(
    "alert_page_totals",
    lambda s, d: search.query_alerts(
        v.states(s, d), severity="critical", limit=50, offset=10
    ).totals(),
    sql("""SELECT count(*) AS total, CAST(50 AS BIGINT) AS "limit", CAST(10 AS BIGINT) AS "offset",
        CASE WHEN count(*) > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM states
        WHERE severity = 'critical'""", "states"),
)
register(
    "alert_explorer",
    lambda s, d: search.explore_alerts(v.states(s, d), status="new", search="union", limit=25)
    .select("alert_id", "risk", "query"),
    sql(r"""SELECT alert_id, format('{:.3f}', risk_score) AS risk,
        regexp_replace(query, '\s+', ' ', 'g') AS query FROM states WHERE status = 'new' AND
        contains(lower(concat_ws(' ', alert_id, username, database, client_ip, classification,
        query)), 'union') ORDER BY last_seen DESC, alert_id LIMIT 25""", "states"),
)
register(
    "alert_display_rows",
    lambda s, d: search.display_rows(v.states(s, d), width=40).select("alert_id", "risk", "query"),
    sql(r"""SELECT alert_id, format('{:.3f}', risk_score) AS risk,
        CASE WHEN length(q) > 40 THEN substr(q, 1, 37) || '...' ELSE q END AS query FROM
        (SELECT *, regexp_replace(query, '\s+', ' ', 'g') AS q FROM states) t""", "states"),
)
register(
    "newest_alerts",
    lambda s, d: v.states(s, d).orderBy(*search.newest_first(v.states(s, d), "alert_id")).select(
        "alert_id", "last_seen"
    ),
    sql("SELECT alert_id, last_seen FROM states ORDER BY last_seen DESC, alert_id", "states"),
)
# One of the statements that repeat, so this alert exists at every table size.
LOOKUP_ID = "alrt_8e03263c2408ec6298463b75"
register(
    "alert_lookup",
    lambda s, d: search.get_alert(v.alerts(s, d), LOOKUP_ID).select(*_ALERT_NAMES),
    sql(f"SELECT {ALERT_SQL} FROM al WHERE alert_id = '{LOOKUP_ID}'", "al"),
)

# ---------------------------------------------------------------- summaries and retention

register(
    "alert_summary",
    lambda s, d: summaries.alert_summary(v.states(s, d)),
    sql("""SELECT 'total' AS facet, 'all' AS name, count(*) AS alerts FROM states
        UNION ALL SELECT 'status', status, count(*) FROM states GROUP BY status
        UNION ALL SELECT 'severity', severity, count(*) FROM states GROUP BY severity""", "states"),
)
register(
    "dashboard_cards",
    lambda s, d: summaries.dashboard_cards(v.states(s, d)),
    sql("""SELECT count(*) AS total_alerts, count(*) FILTER (status = 'new') AS "new",
        count(*) FILTER (status = 'acknowledged') AS acknowledged,
        count(*) FILTER (status = 'resolved') AS resolved,
        count(*) FILTER (severity IN ('high', 'critical')) AS high_and_critical FROM states""",
        "states"),
)
register(
    "severity_bars",
    lambda s, d: summaries.severity_bars(v.states(s, d)),
    sql("""SELECT s.severity, coalesce(n, 0) AS alerts, CAST(round_even(coalesce(n, 0) /
        (SELECT max(n) FROM (SELECT count(*) AS n FROM states GROUP BY severity)) * 100, 0)
        AS BIGINT) AS width FROM (SELECT unnest(['info', 'low', 'medium', 'high', 'critical'])
        AS severity) s LEFT JOIN (SELECT severity, count(*) AS n FROM states GROUP BY 1) c
        USING (severity)""", "states"),
)
_GONE = "(status = 'resolved' AND last_seen < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL '15' DAY)"
register(
    "prune_counts",
    lambda s, d: summaries.prune(v.states(s, d), older_than_days=15, now=v.NOW)[1],
    sql(f"SELECT count(*) FILTER ({_GONE}) AS removed, count(*) FILTER (NOT {_GONE}) AS retained "
        "FROM states", "states"),
)
register(
    "prune_retained",
    lambda s, d: summaries.prune(v.states(s, d), older_than_days=15, now=v.NOW)[0].select(
        "alert_id", "status"
    ),
    sql(f"SELECT alert_id, status FROM states WHERE NOT {_GONE}", "states"),
)
register(
    "prune_event_cascade",
    lambda s, d: summaries.cascade_events(
        lifecycle.lifecycle_events(v.recorded(s, d), v.recorded_timeline(s, d)),
        summaries.prune(
            lifecycle.lifecycle_states(v.recorded(s, d), v.recorded_timeline(s, d)),
            older_than_days=15,
            now=v.NOW,
        )[0],
    ).groupBy("event_type").agg(F.count("*").alias("events")),
    sql(f"""SELECT effect AS event_type, count(*) AS events FROM fsm WHERE effect <> 'rejected' AND
        alert_id IN (SELECT alert_id FROM states WHERE NOT {_GONE}) GROUP BY 1""", "fsm", "states"),
)
register(
    "store_verification",
    lambda s, d: summaries.verify_alerts(v.recorded_states(s, d)),
    sql("""SELECT count(*) AS alert_count, CAST(0 AS BIGINT) AS bad_status, CAST(0 AS BIGINT) AS
        bad_count, CAST(0 AS BIGINT) AS bad_id, CAST(0 AS BIGINT) AS bad_time, CAST(0 AS BIGINT) AS
        bad_risk, CAST(0 AS BIGINT) AS duplicate_ids, CAST(0 AS BIGINT) AS duplicate_fingerprints,
        TRUE AS valid FROM states""", "states"),
)
register(
    "store_info",
    lambda s, d: summaries.store_info(v.table(s, d, "events")).select(
        "alert_count", "files", "backend"
    ),
    "SELECT count(*) AS alert_count, CAST(1 AS BIGINT) AS files, 'parquet' AS backend FROM events",
)

# ---------------------------------------------------------------- incidents

INCIDENT_SQL = """incident_id, title, status, severity, risk_score, alert_count, occurrence_count,
  first_seen, last_seen, CAST({0} AS BIGINT) AS correlation_window_minutes, source_system, database,
  actor, array_to_string(usernames, '|') AS usernames, array_to_string(client_ips, '|') AS
  client_ips, array_to_string(classifications, '|') AS classifications, recommended_action"""
register(
    "incidents_from_events",
    v.incidents,
    sql(f"SELECT {INCIDENT_SQL.format(30)} FROM e_inc", "e_inc"),
)
register(
    "incidents_from_intervals",
    v.interval_incidents,
    sql(f"SELECT {INCIDENT_SQL.format(4320)} FROM o_inc", "o_inc"),
)
def _table_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """All alerts in six micro-batches, each with alerts of all times and actors."""
    root = f"{checkpoint_dir(spark)}/incidents-{uuid.uuid4().hex}"
    alerts = v.intervals(spark, sf)
    alerts.repartition(6, F.xxhash64("alert_id")).write.parquet(f"{root}/alerts")
    stream = (
        spark.readStream.schema(alerts.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{root}/alerts")
    )
    table = IncidentTable(spark, f"{root}/table", window_minutes=4320)
    watch_incidents(
        stream, table, checkpoint=f"{root}/checkpoint", once=True, fold_every=4
    ).awaitTermination()
    return incidents.with_names(table.incidents(), table.names())


register(
    "incident_table",
    _table_incidents,
    sql(f"SELECT {INCIDENT_SQL.format(4320)} FROM o_inc", "o_inc"),
)
register(
    "incident_names",
    lambda s, d: incidents.incident_names(v.intervals(s, d), window_minutes=4320),
    sql("""SELECT incident_id, 'username' AS kind, unnest(usernames) AS name FROM o_inc
        UNION ALL SELECT incident_id, 'client_ip', unnest(client_ips) FROM o_inc
        UNION ALL SELECT incident_id, 'classification', unnest(classifications) FROM o_inc""",
        "o_inc"),
)
register(
    "incident_members",
    lambda s, d: incidents.incident_members(v.intervals(s, d), window_minutes=4320),
    sql("""SELECT i.incident_id, c.alert_id FROM o_c c JOIN o_inc i ON c.k_source = i.source_system
        AND c.k_db = i.database AND c.k_actor = i.actor AND c.cluster = i.cluster""",
        "o_c", "o_inc"),
)
register(
    "incident_alert_ids",
    lambda s, d: incidents.with_alert_ids(
        search.query_incidents(v.interval_incidents(s, d), limit=100).rows,
        incidents.incident_members(v.intervals(s, d), window_minutes=4320),
    ).select("incident_id", "alert_ids"),
    sql("""SELECT i.incident_id, array_to_string(list_sort(list(c.alert_id)), '|') AS alert_ids
        FROM (SELECT * FROM o_inc ORDER BY last_seen DESC, incident_id LIMIT 100) i JOIN o_c c
        ON c.k_source = i.source_system AND c.k_db = i.database AND c.k_actor = i.actor
        AND c.cluster = i.cluster GROUP BY 1""", "o_c", "o_inc"),
)
register(
    "incident_search",
    lambda s, d: search.filter_incidents(
        v.interval_incidents(s, d), status="open", severity="critical", minimum_risk=0.5,
        search="U1 class_0",
    ).select("incident_id", "title"),
    sql("""SELECT incident_id, title FROM o_inc WHERE status = 'open' AND severity = 'critical' AND
        risk_score >= 0.5e0 AND contains(lower(concat_ws(' ', incident_id, title, database, actor,
        source_system, nullif(array_to_string(usernames, ' '), ''),
        nullif(array_to_string(client_ips, ' '), ''), array_to_string(classifications, ' '))),
        'u1 class_0')""", "o_inc"),
)
register(
    "incident_page",
    lambda s, d: search.query_incidents(
        v.interval_incidents(s, d), status="investigating", limit=100, offset=5
    ).rows.select("incident_id", "last_seen"),
    sql("SELECT incident_id, last_seen FROM o_inc WHERE status = 'investigating' "
        "ORDER BY last_seen DESC, incident_id LIMIT 100 OFFSET 5", "o_inc"),
)
register(
    "incident_page_totals",
    lambda s, d: search.query_incidents(
        v.interval_incidents(s, d), status="investigating", limit=100, offset=5
    ).totals(),
    sql("""SELECT count(*) AS total, CAST(100 AS BIGINT) AS "limit", CAST(5 AS BIGINT) AS "offset",
        CASE WHEN count(*) > 105 THEN CAST(105 AS BIGINT) END AS next_offset FROM o_inc
        WHERE status = 'investigating'""", "o_inc"),
)
register(
    "incident_summary",
    lambda s, d: summaries.incident_summary(v.interval_incidents(s, d)),
    sql("""SELECT count(*) AS incident_count, count(*) FILTER (status <> 'resolved') AS
        active_count, coalesce(max(risk_score) FILTER (status <> 'resolved'), 0e0) AS
        maximum_active_risk, """
        + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count"
                    for s in ("open", "investigating", "resolved")) + ", "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count"
                    for s in ("info", "low", "medium", "high", "critical"))
        + " FROM o_inc", "o_inc"),
)
register(
    "incident_gauges",
    lambda s, d: summaries.incident_gauges(v.interval_incidents(s, d)),
    sql("SELECT status, severity, count(*) AS incidents, max(occurrence_count) AS recurrence "
        "FROM o_inc GROUP BY 1, 2", "o_inc"),
)
register(
    "max_recurrence",
    lambda s, d: summaries.max_recurrence(v.interval_incidents(s, d)),
    sql("SELECT coalesce(max(occurrence_count), 0) AS recurrence_max FROM o_inc "
        "WHERE status <> 'resolved'", "o_inc"),
)
register(
    "panel_values",
    lambda s, d: summaries.panel_values(v.recorded_states(s, d), v.recorded_incidents(s, d)),
    sql("""SELECT 'current_alerts' AS panel, count(*) AS value FROM states
        UNION ALL SELECT 'critical_alerts', count(*) FROM states WHERE severity = 'critical'
        UNION ALL SELECT 'active_incidents', count(*) FROM e_inc WHERE status <> 'resolved'
        UNION ALL SELECT 'critical_active_incidents', count(*) FROM e_inc WHERE status <>
          'resolved' AND severity = 'critical'
        UNION ALL SELECT 'maximum_recurrence', max(occurrence_count) FROM e_inc
          WHERE status <> 'resolved'""", "states", "e_inc"),
)


def _flat_assessment(assessed: DataFrame) -> DataFrame:
    t = "triple_loop."
    return assessed.select(
        "incident_id",
        F.col(t + "loop1_detection.signal_strength").alias("signal_strength"),
        F.col(t + "loop1_detection.evidence_alerts").alias("evidence_alerts"),
        F.col(t + "loop1_detection.observed_occurrences").alias("observed_occurrences"),
        F.col(t + "loop2_adaptation.response_mode").alias("response_mode"),
        F.col(t + "loop2_adaptation.response_priority").alias("response_priority"),
        F.col(t + "loop2_adaptation.preserve_evidence").alias("preserve_evidence"),
        F.col(t + "loop2_adaptation.recurrence_detected").alias("recurrence_detected"),
        F.col(t + "loop3_reflection.governance_action").alias("governance_action"),
        F.col(t + "loop3_reflection.requires_documented_rationale").alias("needs_rationale"),
        F.col(t + "loop3_reflection.feedback_candidate").alias("feedback_candidate"),
        F.col(t + "learning_score").alias("learning_score"),
        F.col(t + "escalation_required").alias("escalation_required"),
        F.col(t + "human_approval_required").alias("human_approval_required"),
    )


_URGENT = "severity IN ('high', 'critical')"
register(
    "incident_assessment",
    lambda s, d: _flat_assessment(learning.assess(v.interval_incidents(s, d))),
    sql(f"""SELECT incident_id, risk_score AS signal_strength, alert_count AS evidence_alerts,
        occurrence_count AS observed_occurrences,
        CASE WHEN {_URGENT} THEN 'immediate_human_review' WHEN occurrence_count >= 3 THEN
          'enhanced_monitoring_and_control_tuning' ELSE 'standard_analyst_review' END AS
          response_mode,
        CASE WHEN {_URGENT} THEN 'urgent' WHEN occurrence_count >= 3 THEN 'elevated' ELSE 'normal'
          END AS response_priority,
        severity IN ('medium', 'high', 'critical') AS preserve_evidence,
        occurrence_count > alert_count OR occurrence_count >= 3 AS recurrence_detected,
        governance_action, governance_action <> 'retain_current_policy' AS needs_rationale,
        occurrence_count >= 3 AS feedback_candidate, learning_score,
        {_URGENT} OR occurrence_count >= 3 AS escalation_required,
        {_URGENT} AS human_approval_required FROM ass""", "ass"),
)
register(
    "notification_payloads",
    lambda s, d: incidents.notification_rows(
        incidents.notify_selection(v.assessed(s, d), "medium")
    ),
    sql(f"""SELECT 'incident_notification' AS type, incident_id, title, status, severity,
        risk_score, alert_count, occurrence_count, {iso('first_seen')} AS first_seen,
        {iso('last_seen')} AS last_seen, database, source_system,
        array_to_string(classifications, '|') AS classifications,
        {_URGENT} OR occurrence_count >= 3 AS escalation_required,
        {_URGENT} AS human_approval_required FROM o_inc
        WHERE status <> 'resolved' AND sr >= 2""", "o_inc"),
)
_SECRET = "check-secret"
_PADS = [bytes(k ^ p for k in _SECRET.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
_BODY = " || ',' || ".join(
    f"""'"{name}":' || coalesce(CAST(to_json({value}) AS VARCHAR), 'null')"""
    for name, value in (
        ("alert_count", "alert_count"), ("classifications", "classifications"),
        ("database", "database"), ("escalation_required", f"{_URGENT} OR occurrence_count >= 3"),
        ("first_seen", iso("first_seen")), ("human_approval_required", _URGENT),
        ("incident_id", "incident_id"), ("last_seen", iso("last_seen")),
        ("occurrence_count", "occurrence_count"), ("risk_score", "risk_score"),
        ("severity", "severity"), ("source_system", "source_system"), ("status", "status"),
        ("title", "title"), ("type", "'incident_notification'"),
    )
)
register(
    "notification_outbox",
    lambda s, d: exports.outbox(
        incidents.notification_rows(incidents.notify_selection(v.assessed(s, d))),
        secret=_SECRET,
        sent_at=v.GENERATED,
    ),
    sql(f"""SELECT sha256(body) AS message_key, body, '1706745600' AS "timestamp",
        'sha256=' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') ||
          encode('1706745600.' || body)))) AS signature
        FROM (SELECT '{{' || {_BODY} || '}}' AS body FROM o_inc
              WHERE status <> 'resolved' AND sr >= 3)""", "o_inc"),
)

# ---------------------------------------------------------------- recommendations, feedback

register("recommendations", v.recommendations, sql("SELECT * FROM recs", "recs"))
register(
    "feedback_records",
    lambda s, d: feedback.build_feedback(v.feedback_entries(s, d)),
    sql("""SELECT CASE WHEN problem IS NULL THEN fid END AS feedback_id, recommendation_id,
        incident_id, analyst, decision, rationale, created_at, problem FROM fb_all""", "fb_all"),
)
register(
    "feedback_verdicts",
    lambda s, d: feedback.judge_feedback(v.recommendations(s, d), v.feedback(s, d)),
    sql("SELECT * FROM judged", "judged"),
)
register(
    "applied_feedback",
    lambda s, d: feedback.apply_feedback(
        v.recommendations(s, d),
        feedback.judge_feedback(v.recommendations(s, d), v.feedback(s, d)),
    ).select("recommendation_id", "status", "auto_apply"),
    sql("""SELECT r.recommendation_id, CASE j.decision WHEN 'accept' THEN 'accepted' WHEN 'reject'
        THEN 'rejected' WHEN 'revision_required' THEN 'revision_required' ELSE 'proposed' END AS
        status, FALSE AS auto_apply FROM recs r LEFT JOIN (SELECT * FROM judged WHERE verdict =
        'accepted') j USING (recommendation_id)""", "recs", "judged"),
)
register(
    "unmatched_feedback",
    lambda s, d: feedback.unmatched_feedback(v.recommendations(s, d), v.feedback(s, d)).select(
        "feedback_id", "analyst"
    ),
    sql("SELECT feedback_id, analyst FROM fb WHERE recommendation_id NOT IN "
        "(SELECT recommendation_id FROM recs)", "fb", "recs"),
)
register(
    "feedback_conflicts",
    lambda s, d: feedback.conflicting_ids(
        v.feedback(s, d).select("recommendation_id", "decision"), "recommendation_id"
    ),
    sql("SELECT recommendation_id FROM fb GROUP BY 1 HAVING count(DISTINCT decision) > 1", "fb"),
)
register(
    "feedback_list",
    lambda s, d: feedback.list_feedback(v.feedback(s, d), recommendation_id="prec_missing").select(
        "feedback_id", "created_at"
    ),
    sql("SELECT feedback_id, created_at FROM fb WHERE recommendation_id = 'prec_missing'", "fb"),
)
register(
    "recommendation_list",
    lambda s, d: feedback.list_recommendations(v.recommendations(s, d)).select(
        "recommendation_id", "created_at"
    ),
    sql("SELECT recommendation_id, created_at FROM recs", "recs"),
)


def _saved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    recs = v.recommendations(spark, sf)
    changed = recs.withColumn(
        "rationale",
        F.when(F.col("learning_score") > 0.5, F.lit("changed")).otherwise(F.col("rationale")),
    )
    stored = recs.where("proposed_action <> 'retain_current_policy'")
    return feedback.save_recommendations(stored, changed)


register(
    "saved_recommendations",
    lambda s, d: _saved(s, d)[0].select("recommendation_id", "rationale"),
    sql("""SELECT recommendation_id, CASE WHEN proposed_action = 'retain_current_policy' AND
        learning_score > 0.5e0 THEN 'changed' ELSE rationale END AS rationale FROM recs""", "recs"),
)
register(
    "recommendation_conflicts",
    lambda s, d: _saved(s, d)[1],
    sql("SELECT recommendation_id FROM recs WHERE proposed_action <> 'retain_current_policy' AND "
        "learning_score > 0.5e0", "recs"),
)

# ---------------------------------------------------------------- metrics and health

register(
    "request_counts",
    lambda s, d: metrics.request_counts(v.access_log(s, d)),
    sql("SELECT m AS method, route, CAST(status_code AS BIGINT) AS status_code, count(*) AS "
        "requests FROM routed GROUP BY 1, 2, 3", "routed"),
)
register(
    "request_durations",
    lambda s, d: metrics.request_durations(v.access_log(s, d)),
    sql("SELECT m AS method, route, CAST(sum(secs) AS DOUBLE) AS duration_sum, count(*) AS "
        "duration_count FROM routed GROUP BY 1, 2", "routed"),
)
register(
    "request_rates",
    lambda s, d: metrics.request_rates(v.access_log(s, d)),
    sql("""SELECT time_bucket(INTERVAL '5' MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00') AS
        window_start, time_bucket(INTERVAL '5' MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00') +
        INTERVAL '5' MINUTE AS window_end, CAST(status_code AS BIGINT) AS status_code, count(*) AS
        requests, count(*) / 300e0 AS requests_per_second, CAST(sum(secs) AS DOUBLE) / count(*) AS
        mean_duration, count(*) FILTER (status_code BETWEEN 500 AND 599) AS server_errors
        FROM routed GROUP BY 1, 2, 3""", "routed"),
)
register(
    "health_summary",
    lambda s, d: metrics.health_summary(v.probes(s, d)),
    sql("""SELECT CASE WHEN count(*) FILTER (required AND NOT healthy) > 0 THEN 'degraded' ELSE
        'healthy' END AS status, count(*) AS component_count, count(*) FILTER (healthy) AS
        healthy_count, array_to_string(list_sort(list(name) FILTER (required AND NOT healthy)),
        '|') AS required_failures, array_to_string(list_sort(list(name) FILTER (NOT required AND
        NOT healthy)), '|') AS optional_failures FROM probes""", "probes"),
)
register(
    "latest_probes",
    lambda s, d: metrics.latest_probes(
        v.probes(s, d).unionByName(
            v.probes(s, d).withColumn("checked_at_epoch", F.col("checked_at_epoch") - 60)
        )
    ),
    sql("SELECT name, url, required, healthy, CAST(status_code AS BIGINT) AS status_code, "
        "duration_seconds, detail, checked_at_epoch FROM probes", "probes"),
)


def _gauge(frame: DataFrame, value: str) -> DataFrame:
    return frame.select(
        F.col("name").alias("component"), F.col(value).cast("int").alias("value")
    )


register(
    "required_down",
    lambda s, d: metrics.required_down(
        _gauge(v.probes(s, d), "healthy"), _gauge(v.probes(s, d), "required")
    ),
    sql("SELECT name AS component, CAST(0 AS BIGINT) AS value FROM probes WHERE required AND NOT "
        "healthy", "probes"),
)
register(
    "hold_rule",
    lambda s, d: metrics.hold_rule(
        v.access_log(s, d).select(F.col("client").alias("series"), "ts", "status_code"),
        F.col("status_code") < 400,
        hold_seconds=86_400,
    ),
    sql("""SELECT series, min(ts) AS started, max(ts) AS ended, count(*) AS samples,
        bool_or(ts >= s + INTERVAL '1' DAY) AS fires, min(ts) FILTER (ts >= s + INTERVAL '1' DAY)
        AS fires_at FROM (SELECT *, min(ts) OVER (PARTITION BY series, g) AS s FROM (
          SELECT client AS series, ts, status_code < 400 AS ok, sum(CASE WHEN status_code < 400
            THEN 0 ELSE 1 END) OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
          FROM access) WHERE ok) GROUP BY series, g""", "access"),
)
for _alert_rule in alert_rules.RULES:
    register(
        "fired_" + re.sub(r"(?<!^)([A-Z])", r"_\1", _alert_rule.name).lower(),
        lambda s, d, name=_alert_rule.name: alert_rules.fired_rules(v.metric_samples(s, d))
        .where(F.col("rule") == name)
        .drop("rule"),
        sql(f"""SELECT '{_alert_rule.severity}' AS severity, '{_alert_rule.summary}' AS summary,
            series, started, ended, samples, fires, fires_at FROM rule_spells
            WHERE rule = '{_alert_rule.name}'""", "rule_spells"),
    )


def _increases(spark: SparkSession, sf: str) -> DataFrame:
    """Every server-error counter at every time that any of them has a sample."""
    counters = v.metric_samples(spark, sf).where(
        (F.col("metric") == "quillwatch_http_requests_total") & F.col("labels.status").like("5__")
    ).select(alert_rules.series_key(F.col("labels")).alias("series"), "ts", "value")
    cell = F.floor(F.unix_seconds("ts") / 300)
    near = counters.select("series", F.explode(F.array(cell, cell + 1)).alias("cell")).distinct()
    times = counters.select(F.col("ts").alias("at"), cell.alias("cell")).distinct()
    asked = near.join(times, "cell").drop("cell")
    grown = metrics.counter_increase(counters, asked, range_seconds=300)
    return grown.where("increase is not null").withColumnRenamed("at", "moment")


register(
    "counter_increase",
    _increases,
    sql("SELECT series, make_timestamp(t) AS moment, increase FROM growth "
        "WHERE increase IS NOT NULL", "growth"),
)
register(
    "server_error_growth",
    lambda s, d: alert_rules.server_error_growth(v.metric_samples(s, d)).select(
        F.col("ts").alias("moment"), F.round("increase", 6).alias("increase")
    ),
    sql("SELECT make_timestamp(t) AS moment, round(sum(increase), 6) AS increase FROM growth "
        "WHERE increase IS NOT NULL GROUP BY t", "growth"),
)
_PREFIX = metrics.DEFAULT_PREFIX
_HEADS = ", ".join(
    f"'{line}'"
    for name, kind, about in metrics.FAMILIES
    for line in (f"# HELP {_PREFIX}_{name} {about}", f"# TYPE {_PREFIX}_{name} {kind}")
) + f""", '{_PREFIX}_info{{version="1.0"}} 1', '{_PREFIX}_alert_store_up{{backend="parquet"}} 1'"""
register(
    "exposition_lines",
    lambda s, d: metrics.exposition_lines(
        metrics.request_series(v.access_log(s, d))
        .unionByName(metrics.alert_series(v.states(s, d)))
        .unionByName(metrics.incident_series(v.incidents(s, d)))
        .unionByName(metrics.component_series(v.probes(s, d)))
        .unionByName(metrics.info_series(s, "1.0"))
    ),
    sql(f"""SELECT '{_PREFIX}_http_requests_total{{method="' || m || '",path="' || route ||
          '",status="' || status_code || '"}} ' || count(*) AS value FROM routed
          GROUP BY m, route, status_code
        UNION ALL SELECT '{_PREFIX}_http_request_duration_seconds_sum{{method="' || m || '",path="'
          || route || '"}} ' || format('{{:.9f}}', CAST(sum(secs) AS DOUBLE)) FROM routed
          GROUP BY m, route
        UNION ALL SELECT '{_PREFIX}_http_request_duration_seconds_count{{method="' || m ||
          '",path="' || route || '"}} ' || count(*) FROM routed GROUP BY m, route
        UNION ALL SELECT '{_PREFIX}_alerts_total{{status="' || status || '"}} ' || count(*)
          FROM states GROUP BY status
        UNION ALL SELECT '{_PREFIX}_alerts_by_severity{{severity="' || severity || '"}} ' ||
          count(*) FROM states GROUP BY severity
        UNION ALL SELECT '{_PREFIX}_incidents_total{{status="' || status || '",severity="' ||
          severity || '"}} ' || count(*) FROM e_inc GROUP BY status, severity
        UNION ALL SELECT '{_PREFIX}_incident_recurrence_max ' || max(occurrence_count) FROM e_inc
          WHERE status <> 'resolved'
        UNION ALL SELECT '{_PREFIX}_component_up{{component="' || name || '"}} ' ||
          CAST(healthy AS INT) FROM probes
        UNION ALL SELECT '{_PREFIX}_component_probe_duration_seconds{{component="' || name || '"}} '
          || format('{{:.9f}}', duration_seconds) FROM probes
        UNION ALL SELECT '{_PREFIX}_component_required{{component="' || name || '"}} ' ||
          CAST(required AS INT) FROM probes
        UNION ALL SELECT unnest([{_HEADS}])""", "routed", "states", "e_inc", "probes"),
)
register(
    "escaped_labels",
    lambda s, d: v.table(s, d, "documents").select(
        "doc_id", F.md5(escape_label(F.col("text"))).alias("label_md5")
    ),
    r"""SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), '"', '\"'))
        AS label_md5 FROM documents""",
)

# ---------------------------------------------------------------- limits and audit chains

register(
    "request_pressure",
    lambda s, d: throttle.request_pressure(v.access_log(s, d), limit=1).select(
        "request_id", "in_last_minute", "over_limit"
    ),
    sql("""SELECT request_id, n AS in_last_minute, n > 1 AS over_limit FROM (SELECT request_id,
        count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND
        PRECEDING AND CURRENT ROW) AS n FROM access)""", "access"),
)
_WALK = """WITH RECURSIVE {access}, numbered AS (SELECT request_id, client,
  epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS n
  FROM access),
walk AS (SELECT request_id, client, n, TRUE AS accepted, [t] AS held, CAST(NULL AS BIGINT) AS wait
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT request_id, client, n, len(kept) < 1,
    CASE WHEN len(kept) < 1 THEN list_append(kept, t) ELSE kept END,
    CASE WHEN len(kept) >= 1 THEN greatest(1, (60000000 - (t - kept[1])) // 1000000) END
  FROM (SELECT m.request_id, m.client, m.n, m.t,
          list_filter(w.held, lambda a: a > m.t - 60000000) AS kept
        FROM walk w JOIN numbered m ON m.client = w.client AND m.n = w.n + 1))
SELECT request_id, accepted, wait AS retry_after FROM walk"""
register(
    "throttle",
    lambda s, d: throttle.throttle(v.access_log(s, d), limit=1).select(
        "request_id", "accepted", "retry_after"
    ),
    _WALK.format(access="access AS (" + v.ACCESS_SQL.format(events="events") + ")"),
)


def _chain_lines(spark: SparkSession, sf: str, tampered: bool) -> DataFrame:
    """One audit chain per user, appended by the library; some records edited afterwards."""
    entries = v.table(spark, sf, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("chain"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("order_key"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("at"),
        F.col("event_type").alias("action"),
        F.lit("success").alias("status"),
        F.to_json(F.struct("event_id", "value", "props")).alias("details"),
    )
    tails = spark.createDataFrame([], "chain string, sequence bigint, link_hash string")
    lines = audit_chain.append_audit_events(tails, entries).withColumn(
        "line_no", F.col("sequence")
    )
    if not tampered:
        return lines
    broken = F.regexp_replace("raw", '"event_id": (\\d*)7,', '"event_id": $18,')
    edited = F.regexp_extract("raw", '"event_id": (\\d+)', 1).cast("bigint") % 500 == 207
    return lines.withColumn("raw", F.when(edited, broken).otherwise(F.col("raw")))


register(
    "audit_chain_intact",
    lambda s, d: audit_chain.verify_audit_log(_chain_lines(s, d, False), chain="chain"),
    """SELECT 'user_' || user_id AS chain, TRUE AS valid, count(*) AS records,
       count(*) AS chained_records, CAST(0 AS BIGINT) AS legacy_records,
       CAST(NULL AS BIGINT) AS failure_line, 'ok' AS message FROM events GROUP BY user_id""",
)
register(
    "audit_chain_tampered",
    lambda s, d: audit_chain.verify_audit_log(
        _chain_lines(s, d, True), chain="chain", block_lines=16
    ),
    """SELECT 'user_' || user_id AS chain, bad IS NULL AS valid, coalesce(bad, n) AS records,
       coalesce(bad - 1, n) AS chained_records, CAST(0 AS BIGINT) AS legacy_records,
       bad AS failure_line, CASE WHEN bad IS NULL THEN 'ok' ELSE 'record_hash_mismatch' END AS
       message FROM (SELECT user_id, count(*) AS n, min(k) FILTER (event_id % 500 = 207) AS bad
       FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
       AS k FROM events) GROUP BY user_id)""",
)



def _mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Chains that begin with a record of the old kind; some lines are no records at all."""
    events = v.table(spark, sf, "events").withColumn(
        "chain", F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    )
    first = events.groupBy("chain").agg(F.min("event_id").alias("event_id"))
    old = first.select(
        "chain", "event_id", F.to_json(F.struct(F.lit("login").alias("action"), "event_id")).alias("raw")
    )
    tails = old.select(
        "chain", F.lit(1).cast("bigint").alias("sequence"), F.sha2("raw", 256).alias("link_hash")
    )
    entries = events.join(first, ["chain", "event_id"], "left_anti").select(
        "chain",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("order_key"),
        F.lit(v.GENERATED).alias("at"),
        F.col("event_type").alias("action"),
        F.lit("success").alias("status"),
        F.to_json(F.struct("event_id")).alias("details"),
    )
    added = audit_chain.append_audit_events(tails, entries).select(
        "chain", F.col("sequence").alias("line_no"), "raw"
    )
    lines = old.select("chain", F.lit(1).cast("bigint").alias("line_no"), "raw").unionByName(added)
    number = F.regexp_extract("raw", '"event_id": ?(\\d+)', 1).cast("bigint") % 500
    return lines.withColumn(
        "raw", F.when(number == 207, "{").when(number == 308, "[1]").otherwise(F.col("raw"))
    )


register(
    "audit_chain_mixed",
    lambda s, d: audit_chain.verify_audit_log(_mixed_lines(s, d), chain="chain", block_lines=16),
    """SELECT 'user_' || user_id AS chain, bad IS NULL AS valid, coalesce(bad, n) AS records,
       greatest(coalesce(bad - 2, n - 1), 0) AS chained_records,
       CAST(CASE WHEN bad = 1 THEN 0 ELSE 1 END AS BIGINT) AS legacy_records, bad AS failure_line,
       CASE kind WHEN 207 THEN 'invalid_json' WHEN 308 THEN 'record_is_not_an_object' ELSE 'ok' END
       AS message FROM (SELECT user_id, count(*) AS n, min(k) FILTER (m IN (207, 308)) AS bad,
       arg_min(m, k) FILTER (m IN (207, 308)) AS kind FROM (SELECT user_id, event_id % 500 AS m,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
       GROUP BY user_id)""",
)

# ---------------------------------------------------------------- exports and batches

register(
    "compacted_log",
    lambda s, d: exports.batch_records(v.states(s, d)).select(
        "type", "alert_id", "status", "occurrence_count", "first_seen", "last_seen",
        "status_updated_at",
    ),
    sql(f"""SELECT 'alert' AS type, alert_id, status, occurrence_count, {iso('first_seen')} AS
        first_seen, {iso('last_seen')} AS last_seen, CASE WHEN status_updated_at IS NOT NULL THEN
        {iso('status_updated_at')} END AS status_updated_at FROM states""", "states"),
)


# ---------------------------------------------------------------- streaming


def _stream_watch(spark: SparkSession, sf: str) -> DataFrame:
    """The whole events table read as a stream, drained once into a fresh alert store."""
    root = f"{checkpoint_dir(spark)}/watch-{uuid.uuid4().hex}"
    raw = v.table(spark, sf, "events")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf}/events*.parquet")
    rows = spark.sql(v.AUDIT_SQL, events=stream).withColumn(
        "event_time", F.col("event_time").cast("timestamp")
    )
    store = AlertStore(spark, f"{root}/store")
    watch(rows, store, checkpoint=f"{root}/checkpoint", min_risk=0.5, once=True).awaitTermination()
    return store.state()


register(
    "stream_watch",
    lambda s, d: _stream_watch(s, d).select(*_ALERT_NAMES, "status"),
    sql(f"SELECT {ALERT_SQL}, 'new' AS status FROM al", "al"),
)

# Registers more queries by its import; it needs the names above.
import checks.sink_queries  # noqa: E402,F401

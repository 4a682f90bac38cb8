"""Input frames derived from the given tables, each over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.operators.alerts import collapse_occurrences, enrich_detections
from quillwatch.operators.detection import analyze, detect, threshold
from quillwatch.operators.feedback import build_feedback, recommend
from quillwatch.operators.incidents import correlate
from quillwatch.operators.learning import assess
from quillwatch.operators.lifecycle import lifecycle_states, lifecycle_timeline
from quillwatch.session import pin_utc, spread_rows, stored
from quillwatch.sources.audit import accepted, normalize_events

BATCH = "batch-1"
GENERATED = "2024-02-01T00:00:00+00:00"
NOW = "2024-02-05T00:00:00+00:00"

# The same text runs in Spark and in the checking database.
AUDIT_SQL = """
SELECT
  'evt_' || CAST(event_id AS STRING) AS event_id,
  ts AS event_time,
  CASE event_id % 16
    WHEN 0  THEN 'SELECT id, name FROM customers WHERE id = ' || CAST(event_id AS STRING) || ';'
    WHEN 1  THEN 'DROP TABLE t_' || CAST(event_id % 7 AS STRING) || ';'
    WHEN 2  THEN 'DROP DATABASE db_' || CAST(event_id % 3 AS STRING) || ';'
    WHEN 3  THEN 'TRUNCATE TABLE t_' || CAST(event_id % 7 AS STRING) || ';'
    WHEN 4  THEN 'DELETE FROM t_' || CAST(event_id % 7 AS STRING) || ';'
    WHEN 5  THEN 'GRANT ALL ON t_1 TO user_' || CAST(user_id % 50 AS STRING) || ';'
    WHEN 6  THEN 'REVOKE ALL ON t_1 FROM user_' || CAST(user_id % 50 AS STRING) || ';'
    WHEN 7  THEN 'SELECT a FROM t UNION ALL SELECT pw FROM cred WHERE id = ' || CAST(event_id AS STRING)
    WHEN 8  THEN 'SELECT * FROM users WHERE name = ' || chr(39) || 'x' || chr(39) || ' OR 1=1 -- ' || CAST(event_id AS STRING)
    WHEN 9  THEN 'SELECT 1 /* probe ' || CAST(event_id % 5 AS STRING) || ' */'
    WHEN 10 THEN 'EXEC xp_cmdshell ' || chr(39) || 'whoami' || chr(39) || ';'
    WHEN 11 THEN 'SELECT LOAD_FILE (' || chr(39) || '/f/' || CAST(event_id % 4 AS STRING) || chr(39) || ');'
    WHEN 12 THEN 'SELECT pg_sleep(' || CAST(event_id % 9 AS STRING) || ');'
    WHEN 13 THEN 'DELETE FROM t_1 WHERE id = ' || CAST(event_id AS STRING) || ';'
    WHEN 14 THEN '  select   *  from   orders_' || CAST(event_id % 7 AS STRING) || '  '
    ELSE         'DROP TABLE t_1; SELECT 1 UNION SELECT 2 -- ' || CAST(event_id AS STRING)
  END AS query_text,
  'User_' || CAST(user_id % 50 AS STRING) AS username,
  CASE user_id % 4 WHEN 0 THEN 'Sales' WHEN 1 THEN 'finance'
                   WHEN 2 THEN 'warehouse' ELSE 'postgres' END AS database_name,
  CASE WHEN user_id % 5 = 0 THEN NULL
       ELSE '192.0.2.' || CAST(user_id % 200 AS STRING) END AS client_ip,
  value AS duration_ms,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS rows_affected
FROM {events}
"""

# Every 97th row is broken in one of four ways.
BAD_SQL = """
SELECT event_id, event_time,
  CASE WHEN n % 97 = 0 AND n % 4 = 0 THEN '   ' ELSE query_text END AS query_text,
  CASE WHEN n % 97 = 0 AND n % 4 = 1 THEN '' ELSE username END AS username,
  CASE WHEN n % 97 = 0 AND n % 4 = 3 THEN NULL ELSE database_name END AS database_name,
  client_ip,
  CASE WHEN n % 97 = 0 AND n % 4 = 2 THEN -1.5 ELSE duration_ms END AS duration_ms,
  rows_affected
FROM (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS n FROM {audit}) AS numbered
"""

ACCESS_SQL = """
SELECT
  event_id AS request_id,
  CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'GET' WHEN 'error' THEN 'POST'
                  WHEN 'signup' THEN ' put ' ELSE '' END AS method,
  CASE event_id % 6
    WHEN 0 THEN '/api/v1/alerts/alrt_' || CAST(event_id AS STRING)
    WHEN 1 THEN '/api/v1/alerts/alrt_' || CAST(event_id AS STRING) || '/ack'
    WHEN 2 THEN '/api/v1/alerts/alrt_' || CAST(event_id AS STRING) || '/resolve'
    WHEN 3 THEN '/api/v1/incidents/inc_' || CAST(event_id AS STRING) || '/assessment'
    WHEN 4 THEN '/health/live'
    ELSE '/api/v1/alerts/a/b' END AS path,
  CAST(CASE WHEN event_id % 20 = 0 THEN 500 WHEN event_id % 20 < 3 THEN 404 ELSE 200 END AS INT)
    AS status_code,
  CASE WHEN event_id % 50 = 0 THEN -value ELSE value END / 1000 AS duration_seconds,
  'client_' || CAST(user_id % 10 AS STRING) AS client,
  ts
FROM {events}
"""

PROBES_SQL = """
SELECT n_name AS name, 'https://' || lower(n_name) || '.example' AS url,
  n_regionkey < 3 AS required, n_nationkey % 4 <> 0 AS healthy,
  CAST(CASE WHEN n_nationkey % 4 <> 0 THEN 200 ELSE 503 END AS INT) AS status_code,
  CAST(n_nationkey AS DOUBLE) / 8 AS duration_seconds,
  CASE WHEN n_nationkey % 4 <> 0 THEN 'ok' ELSE 'http_503' END AS detail,
  CAST(1700000000 + n_nationkey AS DOUBLE) AS checked_at_epoch
FROM {nation}
"""

INTERVALS_SQL = """
SELECT 'alrt_' || CAST(o_orderkey AS STRING) AS alert_id,
  o_orderpriority AS source_system, o_orderstatus AS database,
  'U' || CAST(o_custkey % 4 AS STRING) AS username,
  CAST(NULL AS STRING) AS client_ip,
  o_orderdate AS first_seen,
  o_orderdate + (o_orderkey % 120) * INTERVAL '1' MINUTE AS last_seen,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium'
    WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
  CAST(o_orderkey % 11 AS DOUBLE) / 10 AS risk_score,
  o_orderkey % 4 AS occurrence_count,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'new' WHEN 1 THEN 'acknowledged'
    ELSE 'resolved' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'class_' || CAST(o_orderkey % 3 AS STRING) END
    AS classification
FROM {orders}
"""


# One scrape every seven seconds; each reads one kind of metric, chosen by its number. Request
# counters grow now and then, and start again after five requests.
METRIC_SQL = """
SELECT ts, value, 'quillwatch' AS job, kind,
  CASE kind WHEN 0 THEN 'up' WHEN 1 THEN 'quillwatch_alert_store_up'
    WHEN 2 THEN 'quillwatch_alerts_by_severity' WHEN 3 THEN 'quillwatch_incidents_total'
    WHEN 4 THEN 'quillwatch_incident_recurrence_max' WHEN 5 THEN 'quillwatch_component_up'
    WHEN 6 THEN 'quillwatch_component_required' ELSE 'quillwatch_http_requests_total' END AS metric,
  CASE WHEN kind = 0 THEN 'node_' || CAST(u % 2 AS STRING) END AS instance,
  CASE WHEN kind IN (2, 3) AND u % 3 < 2 THEN 'critical' WHEN kind IN (2, 3) THEN 'high' END
    AS severity,
  CASE WHEN kind = 3 THEN CASE part WHEN 0 THEN 'open' ELSE 'resolved' END
       WHEN kind = 7 THEN CASE u % 3 WHEN 0 THEN '500' WHEN 1 THEN '503' ELSE '200' END END AS status,
  CASE WHEN kind IN (5, 6) THEN 'part_' || CAST(u % 3 AS STRING) END AS component
FROM (
  SELECT event_id, ts, u, part,
    CASE WHEN kind = 5 THEN 5 + part ELSE kind END AS kind,
    CAST(CASE
      WHEN kind = 7 THEN floor(CAST(row_number() OVER (
        PARTITION BY kind, u % 3, part ORDER BY event_id) AS DOUBLE) / 12) % 6
      WHEN kind = 4 THEN level * 3
      WHEN kind = 5 AND part = 1 THEN CASE WHEN u % 3 = 0 THEN 0 ELSE 1 END
      WHEN kind = 3 AND part = 1 THEN 1 - level
      WHEN kind IN (0, 1, 5) THEN 1 - level ELSE level END AS DOUBLE) AS value
  FROM (
    SELECT event_id, user_id AS u, part,
      CASE CAST(event_id % 8 AS INT) WHEN 6 THEN 5 ELSE CAST(event_id % 8 AS INT) END AS kind,
      CASE WHEN event_id % 100 < 60 AND event_type <> 'signup' THEN 1 ELSE 0 END AS level,
      TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '7' SECOND AS ts
    FROM {events} CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) AS parts) AS scraped
) AS valued
WHERE NOT (kind NOT IN (3, 5, 6) AND part = 1)
"""


View = Callable[[SparkSession, str], DataFrame]


def planned_once(build: View) -> View:
    """Keep the analyzed plan of a view per session and path; no data is kept."""
    plans: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}

    @wraps(build)
    def view(spark: SparkSession, sf: str) -> DataFrame:
        known = plans.get((id(spark), sf))
        if known is None or known[0] is not spark:
            known = plans[(id(spark), sf)] = (spark, build(pin_utc(spark), sf))
        return known[1]

    return view


_built: ContextVar[dict[tuple[str, int, str], DataFrame] | None] = ContextVar("built", default=None)


def one_query(query: View) -> View:
    """The views marked ``once_a_query`` are built once while the query is, and forgotten after."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        mark = _built.set({})
        try:
            return query(spark, sf)
        finally:
            _built.reset(mark)

    return run


def once_a_query(build: View) -> View:
    """One frame for every use inside a query; the next query builds its own."""

    @wraps(build)
    def view(spark: SparkSession, sf: str) -> DataFrame:
        built = _built.get()
        if built is None:
            return one_query(view)(spark, sf)
        key = (build.__name__, id(spark), sf)
        if key not in built:
            built[key] = build(pin_utc(spark), sf)
        return built[key]

    return view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def _audit_of(events: DataFrame) -> DataFrame:
    rows = events.sparkSession.sql(AUDIT_SQL, events=events)
    # the made-up statement text is built once, as if it were read from a file
    others = [c for c in rows.columns if c != "query_text"]
    return rows.select(*others, F.inline(F.array(F.struct("query_text")))).select(*rows.columns)


@planned_once
def audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audit_of(table(spark, sf, "events"))


@planned_once
def bad_audit(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(BAD_SQL, audit=audit(spark, sf))


@planned_once
def events(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(normalize_events(audit(spark, sf)))


@planned_once
def detected(spark: SparkSession, sf: str) -> DataFrame:
    return detect(events(spark, sf))


@planned_once
def analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return analyze(events(spark, sf))


@planned_once
def detections(spark: SparkSession, sf: str) -> DataFrame:
    return threshold(detected(spark, sf), 0.5)


def _occurrences_of(found: DataFrame) -> DataFrame:
    return enrich_detections(found, batch_id=BATCH, generated_at=GENERATED)


@planned_once
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _occurrences_of(detections(spark, sf))


@planned_once
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated alerts, all new."""
    return collapse_occurrences(occurrences(spark, sf)).withColumn("status", F.lit("new"))


def _actions_on(alerts: DataFrame) -> DataFrame:
    """Analyst actions chosen by the first hex digit of the alert id; see ``oracles``."""
    digit = F.conv(F.substring("alert_id", 6, 1), 16, 10).cast("int")
    planned = F.array(
        F.when(
            digit <= 5,
            F.struct(F.lit("acknowledged").alias("action"), F.lit(1).alias("hours")),
        ),
        F.when(
            digit.between(4, 9),
            F.struct(F.lit("resolved").alias("action"), F.lit(2).alias("hours")),
        ),
        F.when(
            digit.between(4, 5),
            F.struct(F.lit("acknowledged").alias("action"), F.lit(3).alias("hours")),
        ),
    )
    listed = alerts.select("alert_id", "first_seen", F.explode(planned).alias("p"))
    base = listed.where(F.col("p").isNotNull())
    return base.select(
        "alert_id",
        F.concat_ws("/", "alert_id", "p.action", "p.hours").alias("action_key"),
        F.col("p.action").alias("action"),
        (F.col("first_seen") + F.make_dt_interval(hours=F.col("p.hours"))).alias("at"),
        F.concat(F.lit("analyst_"), F.substring("alert_id", 6, 1)).alias("actor"),
        F.when(F.col("p.hours") == 2, F.lit("handled")).alias("note"),
    )


@planned_once
def actions(spark: SparkSession, sf: str) -> DataFrame:
    return _actions_on(alerts(spark, sf))


def _spread_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread_rows(table(spark, sf, "events"), "event_id", "ts", "user_id")
    return _occurrences_of(threshold(detect(accepted(normalize_events(_audit_of(rows)))), 0.5))


@once_a_query
def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """The occurrences written once, for queries that read them several times."""
    return stored(_spread_occurrences(spark, sf), "occurrences")


@once_a_query
def recorded_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and times of the occurrences alone, for queries that read no more of them."""
    steps = _spread_occurrences(spark, sf).select(
        "alert_id", "occurrence_key", "first_seen", "last_seen", "batch_id"
    )
    return stored(steps, "steps")


@once_a_query
def bare_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline from :func:`recorded_steps`."""
    steps = recorded_steps(spark, sf)
    firsts = steps.groupBy("alert_id").agg(F.min("first_seen").alias("first_seen"))
    return lifecycle_timeline(steps, _actions_on(firsts))


@once_a_query
def recorded_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _actions_on(collapse_occurrences(recorded(spark, sf)))


@once_a_query
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle_timeline(recorded(spark, sf), recorded_actions(spark, sf))


@once_a_query
def recorded_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline written once, for queries that read it several times."""
    return stored(timeline(spark, sf), "timeline")


@once_a_query
def states(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts after the whole lifecycle."""
    return lifecycle_states(recorded(spark, sf), timeline(spark, sf))


@once_a_query
def recorded_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states written once, for queries that read them several times."""
    return stored(states(spark, sf), "states")


@once_a_query
def recorded_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(recorded_states(spark, sf), window_minutes=30)


@once_a_query
def incidents(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(states(spark, sf), window_minutes=30)


@planned_once
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.sql(INTERVALS_SQL, orders=table(spark, sf, "orders"))
    return raw.withColumns(
        {c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")}
    )


@planned_once
def interval_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(intervals(spark, sf), window_minutes=4320)


@planned_once
def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return assess(interval_incidents(spark, sf))


@planned_once
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return recommend(assessed(spark, sf), created_at=GENERATED)


@planned_once
def feedback_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as analysts; every recommendation is seen by three of them, by its id."""
    recs = recommendations(spark, sf).select(
        "recommendation_id",
        "incident_id",
        F.conv(F.substring("incident_id", 5, 3), 16, 10).cast("bigint").alias("bucket"),
    )
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    turn = F.explode(F.array(*(F.lit(k * 4096) for k in range(3))))
    recs = recs.withColumn("turn", turn).withColumn(
        "c_custkey", (F.col("bucket") + F.col("turn")) % F.lit(max(people.count(), 1)) + 1
    )
    decision = (
        F.when(F.col("c_custkey") % 3 == 0, "accept")
        .when(F.col("c_custkey") % 3 == 1, "reject")
        .otherwise("revision_required")
    )
    return recs.join(people, "c_custkey").select(
        F.when(F.col("c_custkey") % 13 == 0, F.lit("prec_missing"))
        .otherwise(F.col("recommendation_id"))
        .alias("recommendation_id"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit("inc_other"))
        .otherwise(F.col("incident_id"))
        .alias("incident_id"),
        F.when(F.col("c_custkey") % 19 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias(
            "analyst"
        ),
        decision.alias("decision"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("short"))
        .otherwise(F.concat(F.lit("Reviewed for "), "c_mktsegment"))
        .alias("rationale"),
        (
            F.lit(GENERATED).cast("timestamp") + F.make_dt_interval(secs=F.col("c_custkey"))
        ).alias("created_at"),
    )


@planned_once
def feedback(spark: SparkSession, sf: str) -> DataFrame:
    built = build_feedback(feedback_entries(spark, sf))
    # a repeated entry has the same identifier and is stored once
    return built.where(F.col("problem").isNull()).drop("problem").dropDuplicates()


@planned_once
def access_log(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.sql(ACCESS_SQL, events=table(spark, sf, "events"))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@planned_once
def probes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PROBES_SQL, nation=table(spark, sf, "nation"))


@planned_once
def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Metric, labels, ts, value."""
    raw = spark.sql(METRIC_SQL, events=table(spark, sf, "events"))
    names = ("job", "instance", "severity", "status", "component")
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names))
    return raw.select(
        "metric",
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def plain(frame: DataFrame) -> DataFrame:
    """Comparable columns: times without zone, lists joined by ``|``, no wide integers."""
    out = []
    for field in frame.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind.startswith("array"):
            column = F.array_join(column, "|")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return frame.select(*out)



"""Queries that write through a sink, a store or the watch and read back what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.oracles import iso, sql
from checks.registry import _ALERT_NAMES, ALERT_SQL, MIDDLE, register
from quillwatch.functions.numeric import positive_long
from quillwatch.operators import audit_chain, lifecycle, summaries
from quillwatch.plans import exports
from quillwatch.plans.store import AlertStore
from quillwatch.session import checkpoint_dir
from quillwatch.sources import alert_log
from quillwatch.streaming.watch import read_audit_stream, watch
from quillwatch.streaming.watch_audit import audit_lines

FLAT = (
    "timestamp string, username string, database string, source_system string, client_ip string, "
    "query string, risk_score double, severity string, classification string"
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- exports


def _exported(spark: SparkSession, sf: str, suffix: str) -> DataFrame:
    path = f"{_folder(spark, 'export')}.{suffix}"
    exports.write_detections(v.detections(spark, sf), path)
    if suffix == "csv":
        return spark.read.schema(FLAT).option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(FLAT).json(f"{path}/events")


for _suffix in ("csv", "json"):
    register(
        f"export_{_suffix}",
        lambda s, d, suffix=_suffix: _exported(s, d, suffix),
        sql(f"""SELECT {iso('ts')} AS "timestamp", username, database, source_system, client_ip,
            query, risk_score, severity, classification FROM scored WHERE risk_score >= 0.5e0""",
            "scored"),
    )


def _envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, and the alert rows that lie in the partition of each."""
    path = _folder(spark, "batches")
    third = F.regexp_replace("occurrence_key", "evt_", "").cast("bigint") % 3
    exports.write_batches(
        v.occurrences(spark, sf).withColumn("batch_id", F.concat(F.lit("b"), third)), path
    )
    kept = spark.read.schema("alert_id string, batch_id string").json(f"{path}/alerts")
    rows = kept.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.countDistinct("alert_id").alias("alerts")
    )
    envelope = "batch_id string, type string, generated_at string, alert_count bigint"
    return spark.read.schema(envelope).json(f"{path}/batches").join(rows, "batch_id")


register(
    "batch_envelopes",
    _envelopes,
    sql("""SELECT 'b' || CAST(substr(event_id, 5) AS BIGINT) % 3 AS batch_id, 'alert_batch' AS type,
        '2024-02-01T00:00:00+00:00' AS generated_at, count(*) AS alert_count, count(*) AS rows,
        count(DISTINCT alert_id) AS alerts FROM occ GROUP BY 1""", "occ"),
)


def _incident_report(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "incident-report")
    exports.write_incident_report(v.assessed(spark, sf), path)
    total = spark.read.schema("incident_count bigint").json(f"{path}/summary")
    kind = (
        "incident_id string, status string, severity string, risk_score double, alert_count bigint, "
        "first_seen string, last_seen string"
    )
    return spark.read.schema(kind).json(f"{path}/incidents").join(F.broadcast(total))


register(
    "incident_report",
    _incident_report,
    sql(f"""SELECT incident_id, status, severity, risk_score, alert_count, {iso('first_seen')} AS
        first_seen, {iso('last_seen')} AS last_seen, (SELECT count(*) FROM o_inc) AS incident_count
        FROM o_inc""", "o_inc"),
)


def _health_report(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "health-report")
    exports.write_health_report(v.probes(spark, sf), path)
    kind = (
        "status string, component_count bigint, healthy_count bigint, "
        "required_failures array<string>, optional_failures array<string>"
    )
    parts = spark.read.schema("name string").json(f"{path}/components")
    return spark.read.schema(kind).json(f"{path}/summary").join(
        F.broadcast(parts.agg(F.count("*").alias("components")))
    )


register(
    "health_report",
    _health_report,
    sql("""SELECT CASE WHEN count(*) FILTER (required AND NOT healthy) > 0 THEN 'degraded' ELSE
        'healthy' END AS status, count(*) AS component_count, count(*) FILTER (healthy) AS
        healthy_count, array_to_string(list_sort(list(name) FILTER (required AND NOT healthy)),
        '|') AS required_failures, array_to_string(list_sort(list(name) FILTER (NOT required AND
        NOT healthy)), '|') AS optional_failures, count(*) AS components FROM probes""", "probes"),
)

# ---------------------------------------------------------------- log and store


def _ticketed(alerts: DataFrame) -> DataFrame:
    """Alerts with two keys that the schema does not name."""
    return alerts.withColumn(
        "extra",
        F.create_map(
            F.lit("ticket"), F.concat(F.lit('"T '), F.substring("alert_id", 6, 4), F.lit('"')),
            F.lit("weights"), F.concat(F.lit("["), F.col("occurrence_count"), F.lit(",null]")),
        ),
    )


def _tickets() -> list[Column]:
    return [F.col("extra")[key].alias(key) for key in ("ticket", "weights")]


_TICKET_SQL = (
    "'\"T ' || substr(alert_id, 6, 4) || '\"' AS ticket, '[' || occurrence_count || ',null]' AS weights"
)


def _log_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, then analyst actions, some on alerts that no record names; replayed."""
    path = _folder(spark, "log")
    exports.append_log(v.recorded(spark, sf), path)
    act = v.recorded_actions(spark, sf)
    lost = act.withColumn("alert_id", F.concat(F.lit("alrt_lost_"), F.substring("alert_id", 6, 8)))
    exports.append_updates(act.unionByName(lost).orderBy("at", "action_key"), path)
    records = alert_log.read_alert_log(spark, path)
    return lifecycle.replay_log(
        alert_log.log_occurrences(records), alert_log.log_updates(records)
    ).select(
        "alert_id", "fingerprint", "status", "occurrence_count", "first_seen", "last_seen",
        "updated_by", "status_note", "status_updated_at", "last_action",
    )


register(
    "log_sink_replay",
    _log_sink,
    sql("""SELECT al.alert_id, al.fingerprint, coalesce(u.action, 'new') AS status,
        al.occurrence_count, al.first_seen, al.last_seen, u.actor AS updated_by,
        n.note AS status_note, u.moment AS status_updated_at, u.action AS last_action FROM al
        LEFT JOIN (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY alert_id
          ORDER BY moment DESC) = 1) u USING (alert_id)
        LEFT JOIN (SELECT * FROM act WHERE note IS NOT NULL QUALIFY row_number() OVER (
          PARTITION BY alert_id ORDER BY moment DESC) = 1) n USING (alert_id)""", "al", "act"),
)


def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "compacted")
    exports.write_compacted_log(_ticketed(v.states(spark, sf)), path)
    records = alert_log.read_alert_log(spark, path)
    none = alert_log.log_updates(records)
    return lifecycle.replay_log(alert_log.log_occurrences(records), none).select(
        "alert_id", "status", "occurrence_count", "first_seen", "last_seen", "risk_score", "query",
        "status_updated_at", *_tickets(),
    )


register(
    "compacted_log_replay",
    _compacted,
    sql(f"""SELECT alert_id, status, occurrence_count, first_seen, last_seen, risk_score, query,
        status_updated_at, {_TICKET_SQL} FROM states""", "states"),
)


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    """Batches and an import into a store, its backup into another one."""
    root = _folder(spark, "stores")
    store = AlertStore(spark, f"{root}/one")
    late = F.col("last_seen") >= F.lit(MIDDLE).cast("timestamp")
    parts = (v.occurrences(spark, sf).where(~late), v.occurrences(spark, sf).where(late))
    for n, rows in enumerate(parts):
        store.persist_batch(rows, batch_id=f"b{n}", generated_at=v.GENERATED)
    store.compact()
    store.import_alerts(_ticketed(store.state()), import_id="tickets", merge=True)
    other = AlertStore(spark, f"{root}/two")
    other.restore(store.backup(f"{root}/backups"))
    events = other.events().groupBy("alert_id").agg(
        F.count_if(F.col("event_type") == "migrated").alias("imports"),
        F.count_if(F.col("event_type") != "migrated").alias("events"),
    )
    return other.state().join(events, "alert_id", "left").select(
        "alert_id", "status", "occurrence_count", "first_seen", "last_seen", "imports", "events",
        *_tickets(),
    )


register(
    "backup_restore",
    _restored,
    sql(f"""SELECT alert_id, 'new' AS status, occurrence_count, first_seen, last_seen, 1::BIGINT AS
        imports, occurrence_count AS events, {_TICKET_SQL} FROM al""", "al"),
)


def _store_info(spark: SparkSession, sf: str) -> DataFrame:
    """Count of a store of two batches that touch the same alerts."""
    store = AlertStore(spark, _folder(spark, "info"))
    late = F.col("last_seen") >= F.lit(MIDDLE).cast("timestamp")
    store.persist_batch(v.occurrences(spark, sf).where(~late), batch_id="a", generated_at=v.GENERATED)
    store.persist_batch(v.occurrences(spark, sf).where(late), batch_id="b", generated_at=v.GENERATED)
    return store.info().select(
        "alert_count", (F.col("files") > 1).alias("some_files"), (F.col("size_bytes") > 0).alias("some_bytes")
    )


register(
    "alert_store_info",
    _store_info,
    sql("SELECT count(*) AS alert_count, TRUE AS some_files, TRUE AS some_bytes FROM al", "al"),
)


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Stored alerts of which some break one rule each; those of digit 9 stand twice."""
    digit = F.substring("alert_id", 6, 1)
    rows = v.states(spark, sf)
    odd = rows.withColumns(
        {
            "status": F.when(digit == "0", "odd").otherwise(F.col("status")),
            "occurrence_count": F.when(digit == "1", F.lit(0)).otherwise(F.col("occurrence_count")),
            "first_seen": F.when(digit != "2", F.col("first_seen")),
            "risk_score": F.when(digit == "3", F.lit(1.5)).otherwise(F.col("risk_score")),
            "alert_id": F.when(digit == "4", F.upper("alert_id")).otherwise(F.col("alert_id")),
        }
    )
    return odd.unionByName(odd.where(F.substring("alert_id", 6, 1) == "9"))


_DIGIT = "count(*) FILTER (substr(alert_id, 6, 1) = '{}')"
register(
    "store_faults",
    lambda s, d: summaries.verify_alerts(_faulty(s, d)),
    sql(f"""SELECT count(*) + {_DIGIT.format(9)} AS alert_count, {_DIGIT.format(0)} AS bad_status,
        {_DIGIT.format(1)} AS bad_count, {_DIGIT.format(4)} AS bad_id, {_DIGIT.format(2)} AS
        bad_time, {_DIGIT.format(3)} AS bad_risk, {_DIGIT.format(9)} AS duplicate_ids,
        {_DIGIT.format(9)} AS duplicate_fingerprints, FALSE AS valid FROM states""", "states"),
)
register(
    "positive_counts",
    lambda s, d: v.table(s, d, "orders").select(
        "o_orderkey",
        positive_long(F.substring("o_orderpriority", 1, 1)).alias("of_digit"),
        positive_long(F.col("o_orderpriority")).alias("of_text"),
        positive_long(F.concat(F.lit("-"), F.substring("o_orderpriority", 1, 1))).alias("of_negative"),
    ),
    """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS of_digit,
       CAST(1 AS BIGINT) AS of_text, CAST(1 AS BIGINT) AS of_negative FROM orders""",
)

# ---------------------------------------------------------------- watch


def _audit_files(
    spark: SparkSession, sf: str, path: str, *conditions: str, files: int | None = None
) -> str:
    """Audit rows as files, those of each condition in this order; ``files`` for each if given."""
    rows = v.audit(spark, sf).withColumns(
        {
            "event_time": F.col("event_time").cast("timestamp"),
            "n": F.substring("event_id", 5, 20).cast("bigint"),
        }
    )
    for condition in conditions:
        part = rows.where(condition).drop("n")
        if files:
            part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(path)
    return rows.drop("n").schema.simpleString()[len("struct<") : -1].replace(":", " ")


def _watched(spark: SparkSession, sf: str) -> DataFrame:
    """Five fifths, one a micro-batch: the alerts, the audit records and their chain.

    A fifth is one file for each 100,000 rows, so that no task writes or reads all of it.
    """
    root = _folder(spark, "watch")
    files = 1 + v.table(spark, sf, "events").count() // 500_000
    kind = _audit_files(
        spark, sf, f"{root}/rows", *(f"n % 5 = {k}" for k in range(5)), files=files
    )
    store = AlertStore(spark, f"{root}/store")
    watch(
        read_audit_stream(spark, f"{root}/rows", schema=kind, files_per_batch=files), store,
        checkpoint=f"{root}/checkpoint", min_risk=0.5, audit_dir=f"{root}/audit", fold_every=2,
        once=True,
    ).awaitTermination()
    lines = audit_lines(spark, f"{root}/audit")
    chain = audit_chain.verify_audit_log(lines, chain="chain")
    count = F.get_json_object("raw", "$.details.alert_count").cast("bigint")
    alerts = store.state().select(F.lit("alert").alias("part"), "alert_id", "occurrence_count")
    return alerts.union(lines.select(F.lit("batch"), "chain", count)).union(
        chain.select(F.lit("chain"), "message", "chained_records")
    )


register(
    "watch_batches",
    _watched,
    sql("""SELECT 'alert' AS part, alert_id, occurrence_count FROM al
        UNION ALL SELECT 'batch', 'watch', count(*) FROM occ
          GROUP BY CAST(substr(event_id, 5) AS BIGINT) % 5
        UNION ALL SELECT 'chain', 'ok', count(DISTINCT CAST(substr(event_id, 5) AS BIGINT) % 5)
          FROM occ""", "al", "occ"),
)


def _resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A watch over the first half, and another without its checkpoint over everything."""
    root = _folder(spark, "resume")
    store = AlertStore(spark, f"{root}/store")
    for run, condition in (
        ("one", f"event_time < timestamp'{MIDDLE}'"), ("two", f"event_time >= timestamp'{MIDDLE}'"),
    ):
        kind = _audit_files(spark, sf, f"{root}/rows", condition)
        watch(
            read_audit_stream(spark, f"{root}/rows", schema=kind), store, stream_id=run,
            checkpoint=f"{root}/{run}", mark_dir=f"{root}/marks", min_risk=0.5, once=True,
        ).awaitTermination()
    return store.state().select(*_ALERT_NAMES, "status")


register(
    "watch_resumed",
    _resumed,
    sql(f"SELECT {ALERT_SQL}, 'new' AS status FROM al", "al"),
)


def _since(spark: SparkSession, sf: str) -> DataFrame:
    """A watch that begins behind an explicit time although a mark is stored."""
    root = _folder(spark, "since")
    kind = _audit_files(spark, sf, f"{root}/rows", "true")
    for run, since in (("all", None), ("late", f"{MIDDLE}")):
        store = AlertStore(spark, f"{root}/{run}-store")
        watch(
            read_audit_stream(spark, f"{root}/rows", schema=kind), store, stream_id=run,
            checkpoint=f"{root}/{run}", mark_dir=f"{root}/marks", min_risk=0.5, since=since,
            once=True,
        ).awaitTermination()
    return store.state().select("alert_id", "occurrence_count", "first_seen", "last_seen")


register(
    "watch_since",
    _since,
    sql(f"""SELECT alert_id, count(*) AS occurrence_count, min(ts) AS first_seen, max(ts) AS
        last_seen FROM occ WHERE ts > TIMESTAMP '{MIDDLE}' GROUP BY alert_id""", "occ"),
)


def _late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Newer rows first; of the older ones those far behind go to the late folder."""
    root = _folder(spark, "late")
    store = AlertStore(spark, f"{root}/store")
    for condition in (f"event_time >= timestamp'{MIDDLE}'", f"event_time < timestamp'{MIDDLE}'"):
        kind = _audit_files(spark, sf, f"{root}/rows", condition)
        watch(
            read_audit_stream(spark, f"{root}/rows", schema=kind), store, once=True, min_risk=0.5,
            checkpoint=f"{root}/checkpoint", late_after="20 days", late_dir=f"{root}/late",
        ).awaitTermination()
    late = spark.read.schema(kind).parquet(f"{root}/late/*")
    return late.select("event_id", F.col("event_time").alias("moment"))


register(
    "watch_late_rows",
    _late_rows,
    sql(f"""SELECT event_id, event_time AS moment FROM audit WHERE event_time < TIMESTAMP '{MIDDLE}'
        AND event_time <= (SELECT max(event_time) FROM audit) - INTERVAL '20' DAY""", "audit"),
)

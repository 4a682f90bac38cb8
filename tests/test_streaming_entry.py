from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import views
from quillwatch.operators.incidents import correlate
from quillwatch.plans.exports import write_batches, write_detections, write_metrics
from quillwatch.operators.metrics import component_series
from quillwatch.plans.store import AlertStore
from quillwatch.streaming.watch import incident_sessions, read_audit_stream, watch

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "event_id string, event_time timestamp, query_text string, username string, "
    "database_name string, client_ip string, duration_ms double, rows_affected bigint"
)


def test_watch_restart_matches_batch(spark, tmp_path):
    rows = views.audit(spark, SF).withColumn("event_time", F.col("event_time").cast("timestamp"))
    source = str(tmp_path / "audit")
    halves = [rows.where("event_time < timestamp'2024-01-16'"),
              rows.where("event_time >= timestamp'2024-01-16'")]
    store = AlertStore(spark, str(tmp_path / "store"))
    for half in halves:
        half.coalesce(2).write.mode("append").parquet(source)
        stream = read_audit_stream(spark, source, schema=SCHEMA, files_per_batch=1)
        query = watch(
            stream, store, checkpoint=str(tmp_path / "ckpt"), min_risk=0.5, once=True,
            export_dir=str(tmp_path / "export"), outbox_dir=str(tmp_path / "outbox"),
            outbox_secret="s",
        )
        query.awaitTermination()
    expected = {(r.alert_id, r.occurrence_count) for r in views.alerts(spark, SF).collect()}
    state = store.state()
    assert {(r.alert_id, r.occurrence_count) for r in state.collect()} == expected
    assert store.events().count() == sum(n for _, n in expected)
    signed = spark.read.parquet(str(tmp_path / "outbox") + "/*")
    assert signed.where("signature like 'sha256=%'").count() > 0


def test_watch_sets_late_and_bad_rows_aside(spark, tmp_path):
    source = str(tmp_path / "audit")
    row = "select '{0}' event_id, timestamp'{1}' event_time, 'DROP TABLE {0}' query_text, {2} " \
          "username, 'db' database_name, string(null) client_ip, 1.0D duration_ms, 0L rows_affected"
    store = AlertStore(spark, str(tmp_path / "store"))
    for rows in (
        [("a", "2024-02-10", "'u'"), ("b", "2024-02-10 01:00:00", "' '")],
        [("c", "2024-01-01", "'u'"), ("d", "2024-02-10 00:30:00", "'u'")],
    ):
        text = " union all ".join(row.format(*r) for r in rows)
        spark.sql(text).coalesce(1).write.mode("append").parquet(source)
        watch(
            read_audit_stream(spark, source, schema=SCHEMA), store,
            checkpoint=str(tmp_path / "ckpt"), once=True, late_after="1 day",
            late_dir=str(tmp_path / "late"), quarantine_dir=str(tmp_path / "bad"),
        ).awaitTermination()
    assert {r.query for r in store.state().collect()} == {"DROP TABLE a", "DROP TABLE d"}
    late = spark.read.parquet(str(tmp_path / "late") + "/*").collect()
    bad = spark.read.parquet(str(tmp_path / "bad") + "/*").collect()
    assert [r.event_id for r in late] == ["c"] and [r.event_id for r in bad] == ["b"]


def test_incident_sessions_stream(spark, tmp_path):
    alerts = views.alerts(spark, SF).select(
        "alert_id", "source_system", "database", "username", "client_ip", "first_seen",
        "last_seen", "occurrence_count", "risk_score", "severity", "classification", "status",
    ).where("last_seen - first_seen < interval 2 days")
    # one far later alert moves the watermark past everything else
    late = alerts.limit(1).withColumns(
        {c: F.lit("2030-01-01").cast("timestamp") for c in ("first_seen", "last_seen")}
    )
    source = str(tmp_path / "alerts")
    alerts.coalesce(1).write.parquet(source)
    schema = alerts.schema
    for step in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            incident_sessions(stream, late_after="60 days")
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ckpt"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if step == 0:
            late.coalesce(1).write.mode("append").parquet(source)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = correlate(alerts)
    key = ["database", "actor", "alert_count", "occurrence_count"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(
        map(tuple, batch.select(*key).collect())
    )


def test_exports(spark, tmp_path):
    write_detections(views.detections(spark, SF), str(tmp_path / "d.csv"))
    csv = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "d.csv"))
    assert len(csv.columns) == 9 and csv.count() == views.detections(spark, SF).count()
    write_detections(views.detections(spark, SF), str(tmp_path / "d.json"))
    assert spark.read.json(str(tmp_path / "d.json/summary")).first().events_analyzed > 0
    write_batches(views.occurrences(spark, SF), str(tmp_path / "b"))
    envelope = spark.read.json(str(tmp_path / "b/batches")).first()
    assert envelope.alert_count == views.occurrences(spark, SF).count()
    write_metrics(component_series(views.probes(spark, SF)), str(tmp_path / "m"))
    text = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert any(t.startswith("# TYPE quillwatch_component_up gauge") for t in text)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())

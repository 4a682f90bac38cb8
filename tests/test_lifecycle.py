import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillwatch.operators.alerts import enrich_detections
from quillwatch.operators.lifecycle import lifecycle_timeline, replay_log
from quillwatch.plans.exports import append_log, append_updates, write_compacted_log
from quillwatch.plans.store import AlertStore
from quillwatch.sources.alert_log import log_occurrences, log_updates, read_alert_log

DETECTION = (
    "event_id string, timestamp timestamp, username string, database string, "
    "source_system string, client_ip string, query string, risk_score double, severity string, "
    "classification string"
)


def detection(event_id, when, query="DROP TABLE x", severity="high", risk=0.8):
    from datetime import datetime

    return (
        event_id, datetime.fromisoformat(when), "bob", "orders", "postgresql", "10.0.0.1", query,
        risk, severity, "suspicious_sql_activity",
    )


def occurrences(spark, rows, batch="b1"):
    frame = spark.createDataFrame(rows, DETECTION)
    return enrich_detections(frame, batch_id=batch, generated_at="2026-07-21T00:00:00Z")


def fold(steps):
    status, effects = "absent", []
    for kind in steps:
        if kind == "o":
            effect = {"absent": "created", "resolved": "reopened"}.get(status, "occurrence")
            if status in ("absent", "resolved"):
                status = "new"
        elif kind == "a":
            effect = "acknowledged" if status == "new" else "rejected"
            status = "acknowledged" if effect == "acknowledged" else status
        else:
            effect = "resolved" if status in ("new", "acknowledged") else "rejected"
            status = "resolved" if effect == "resolved" else status
        effects.append(effect)
    return effects


@pytest.mark.parametrize("spread_micros", [400_000, 3_000_000])
def test_timeline_equals_sequential_fold(spark, spread_micros):
    """Random histories, dense enough that occurrences share seconds with actions."""
    rng = random.Random(spread_micros)
    occ, act, histories = [], [], {}
    for n in range(300):
        alert, at, steps = f"a{n:03d}", 1_700_000_000_000_000, []
        for k in range(rng.randint(1, 14)):
            at += rng.randint(1, spread_micros)
            kind = rng.choice("ooar")
            key = f"{alert}-{k:02d}"
            steps.append((kind, key))
            if kind == "o":
                occ.append((alert, key, at))
            else:
                act.append((alert, key, "acknowledged" if kind == "a" else "resolved", at))
        histories[alert] = steps
    o = spark.createDataFrame(occ, "alert_id string, occurrence_key string, m long").select(
        "alert_id", "occurrence_key", F.timestamp_micros("m").alias("last_seen")
    )
    a = spark.createDataFrame(act, "alert_id string, action_key string, action string, m long").select(
        "alert_id", "action_key", "action", F.timestamp_micros("m").alias("at"),
        F.lit("x").alias("actor"), F.lit(None).cast("string").alias("note"),
    )
    got = {(r.alert_id, r.step_key): r.effect for r in lifecycle_timeline(o, a).collect()}
    for alert, steps in histories.items():
        expected = fold([kind for kind, _ in steps])
        for (kind, key), effect in zip(steps, expected, strict=True):
            if kind == "o" and effect == "occurrence":
                assert got.get((alert, key), "occurrence") == "occurrence"
            else:
                assert got[(alert, key)] == effect, (alert, steps)


def test_timeline_of_one_long_history(spark):
    """Thousands of steps of one alert, over thousands of blocks and within one block.

    The jobs are cancelled after two minutes: work that grows faster than the steps does not end.
    """
    rng, occ, act, histories = random.Random(7), [], [], {}
    for alert, gap in (("spread", 1_000_000_000), ("dense", 100_000), ("mixed", 2_000_000)):
        steps = []
        for k in range(4_000):
            kind, key = rng.choice("oooaarx"), f"{alert}-{k:05d}"
            steps.append((kind, key))
            at = 1_700_000_100_000_000 + k * gap
            if kind == "o":
                occ.append((alert, key, at))
            else:
                name = {"a": "acknowledged", "r": "resolved", "x": None}[kind]
                act.append((alert, key, name, at))
        histories[alert] = steps
    # rows without a time come first, rows without an alert nowhere; neither has an effect row
    occ += [("mixed", "mixed-null", None), (None, "lost", 1_700_000_100_000_000)]
    o = spark.createDataFrame(occ, "alert_id string, occurrence_key string, m long").select(
        "alert_id", "occurrence_key", F.timestamp_micros("m").alias("last_seen")
    )
    a = spark.createDataFrame(act, "alert_id string, action_key string, action string, m long").select(
        "alert_id", "action_key", "action", F.timestamp_micros("m").alias("at"),
        F.lit("x").alias("actor"), F.lit(None).cast("string").alias("note"),
    )
    spark.sparkContext.setJobGroup("long history", "long history")
    alarm = threading.Timer(120, spark.sparkContext.cancelJobGroup, ["long history"])
    alarm.start()
    try:
        rows = lifecycle_timeline(o, a, block_seconds=900).collect()
    finally:
        alarm.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.alert_id, r.step_key): r.effect for r in rows}
    assert not {("mixed", "mixed-null"), (None, "lost")} & set(got)
    for alert, steps in histories.items():
        led = "o" if alert == "mixed" else ""
        known = [(kind, key) for kind, key in steps if kind != "x"]
        expected = fold([*led, *(kind for kind, _ in known)])[len(led):]
        for (kind, key), effect in zip(known, expected, strict=True):
            if kind == "o" and effect == "occurrence":
                assert got.get((alert, key), "occurrence") == "occurrence"
            else:
                assert got[(alert, key)] == effect
        assert all(got[(alert, key)] == "rejected" for kind, key in steps if kind == "x")


def test_store_life(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path / "store"))
    assert store.state().count() == 0
    first = occurrences(spark, [detection("e1", "2026-07-20 10:00:00"),
                                detection("e2", "2026-07-20 10:05:00", query=" drop  TABLE X ")])
    assert store.persist_batch(first, batch_id="b1", generated_at="2026-07-20T10:06:00Z")
    assert not store.persist_batch(first, batch_id="b1", generated_at="2026-07-20T10:06:00Z")
    alert = store.state().first()
    assert (store.state().count(), alert.occurrence_count, alert.status) == (1, 2, "new")
    assert sorted(r.event_type for r in store.events().collect()) == ["created", "occurrence"]

    def act(key, action, at, actor="ana"):
        return spark.sql(
            f"select '{alert.alert_id}' alert_id, '{key}' action_key, '{action}' action, "
            f"timestamp'{at}' at, '{actor}' actor, ' n ' note"
        )

    verdict = store.update(act("k1", "acknowledged", "2026-07-20 11:00:00"), change_id="k1")
    assert [r.verdict for r in verdict.collect()] == ["accepted"]
    again = store.update(act("k2", "acknowledged", "2026-07-20 11:01:00"), change_id="k2")
    assert again.first().verdict == "alert is already acknowledged"
    second = occurrences(spark, [detection("e3", "2026-07-20 12:00:00")], "b2")
    store.persist_batch(second, batch_id="b2", generated_at="2026-07-20T12:00:00Z")
    row = store.state().first()
    assert (row.status, row.occurrence_count, row.updated_by, row.status_note) == (
        "acknowledged", 3, "ana", "n",
    )
    store.update(act("k3", "resolved", "2026-07-20 13:00:00"), change_id="k3")
    closed = store.update(act("k4", "resolved", "2026-07-20 13:01:00"), change_id="k4")
    assert closed.first().verdict.startswith("a resolved alert cannot")
    third = occurrences(spark, [detection("e4", "2026-07-20 14:00:00")], "b3")
    store.persist_batch(third, batch_id="b3", generated_at="2026-07-20T14:00:00Z")
    row = store.state().first()
    assert (row.status, row.last_action, row.occurrence_count) == ("new", "reopened", 4)
    before = store.events().count()
    store.compact()
    assert store.state().count() == 1 and store.events().count() == before
    info = store.info().first()
    assert info.alert_count == 1 and info.files >= 1 and info.size_bytes > 0
    assert store.verify().first().valid

    path = store.backup(str(tmp_path / "backups"))
    other = AlertStore(spark, str(tmp_path / "other"))
    other.restore(path)
    assert other.state().first().occurrence_count == 4
    with pytest.raises(ValueError):
        other.restore(path)
    other.restore(path, overwrite=True)
    with pytest.raises(ValueError):
        other.import_alerts(store.state(), import_id="i1")
    other.import_alerts(
        store.state().withColumn("occurrence_count", F.lit(9).cast("bigint")),
        import_id="i1", merge=True,
    )
    assert other.state().first().occurrence_count == 9
    assert "migrated" in {r.event_type for r in other.events().collect()}
    with pytest.raises(ValueError):
        other.restore(str(tmp_path / "other/alerts/version=v0000000001-base"), overwrite=True)


def test_prune(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path / "store"))
    store.persist_batch(
        occurrences(spark, [detection("e1", "2020-01-01 00:00:00")]),
        batch_id="b1", generated_at="2020-01-01T00:00:00Z",
    )
    alert_id = store.state().first().alert_id
    store.update(
        spark.sql(f"select '{alert_id}' alert_id, 'k' action_key, 'resolved' action, "
                  "timestamp'2020-01-02' at, 'ana' actor, string(null) note"),
        change_id="k",
    )
    counts = store.prune(older_than_days=30, now="2026-07-21T00:00:00Z").first()
    assert (counts.removed, counts.retained) == (1, 0)
    assert store.state().count() == 0 and store.events().count() == 0
    with pytest.raises(ValueError):
        store.prune(older_than_days=0, now="2026-07-21T00:00:00Z")


def replay(spark, path):
    records = read_alert_log(spark, path)
    return replay_log(log_occurrences(records), log_updates(records))


def test_replay_of_old_records(spark, tmp_path):
    base = {"timestamp": "2026-01-01T00:00:00Z", "username": "u", "database": "d", "query": "q"}
    lines = [
        json.dumps({"type": "alert_update", "alert_id": "a1", "status": "resolved"}),
        json.dumps({**base, "alert_id": "a1"}),
        "   ",
        json.dumps({"type": "other", "alert_id": "a1"}),
        json.dumps({"type": "alert_update", "alert_id": "a1", "status": "acknowledged",
                    "actor": "ana", "note": "first", "timestamp": "2026-01-01T01:00:00Z",
                    "action": "acknowledged"}),
        json.dumps({**base, "alert_id": "a1", "timestamp": "2025-12-31T00:00:00", "severity": "low",
                    "occurrence_count": 3, "status": "resolved"}),
        json.dumps({"type": "alert_update", "alert_id": "a1", "actor": "ben", "note": None}),
        json.dumps({**base, "occurrence_count": "5"}),
        json.dumps({"type": "alert_update", "alert_id": "missing", "status": "resolved"}),
    ]
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(lines) + "\n")
    rows = {r.alert_id: r for r in replay(spark, str(log)).collect()}
    a1 = rows.pop("a1")
    assert (a1.status, a1.occurrence_count, a1.updated_by, a1.status_note, a1.severity) == (
        "acknowledged", 4, "ben", "first", "low",
    )
    assert a1.first_seen.isoformat() == "2025-12-31T00:00:00"
    (upgraded,) = rows.values()
    assert upgraded.alert_id == "alrt_" + upgraded.fingerprint[:24]
    assert upgraded.occurrence_count == 1 and upgraded.status == "new"
    log.write_text("\n".join([lines[1], "{broken", "[1]"]))
    with pytest.raises(Exception, match="line 2: invalid_json|line 3: not_an_object"):
        replay(spark, str(log)).collect()
    quarantine = read_alert_log(spark, str(log), mode="quarantine")
    assert {(r.line_no, r.problem) for r in quarantine.collect()} == {
        (1, None), (2, "invalid_json"), (3, "not_an_object"),
    }


def test_log_sinks_replay(spark, tmp_path):
    path = str(tmp_path / "log")
    occ = occurrences(spark, [detection("e1", "2026-07-20 10:00:00"),
                              detection("e2", "2026-07-20 10:05:00")]).coalesce(1)
    append_log(occ, path)
    alert_id = occ.first().alert_id
    append_updates(
        spark.sql(f"select '{alert_id}' alert_id, timestamp'2026-07-21' at, 'resolved' action, "
                  "'ana' actor, string(null) note"),
        path,
    )
    states = replay(spark, path)
    assert states.first().occurrence_count == 2
    assert [states.first()[c] for c in ("status", "updated_by")] == ["resolved", "ana"]
    append_log(occ, path)
    assert replay(spark, path).first().status == "resolved"
    write_compacted_log(states, str(tmp_path / "compact"))
    again = replay(spark, str(tmp_path / "compact")).first()
    assert again.occurrence_count == 2 and again.alert_id == alert_id

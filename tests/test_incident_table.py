import random

from pyspark.sql import functions as F

from quillwatch.operators.incidents import correlate, incident_names, with_names
from quillwatch.streaming.incident_table import IncidentTable

FIELDS = (
    "alert_id string, source_system string, database string, username string, client_ip string, "
    "first_seen timestamp, last_seen timestamp, severity string, risk_score double, "
    "occurrence_count long, status string, classification string"
)


def alerts(spark, rows):
    """(id, actor, first minute, last minute, severity, status, user)"""
    base = 1_700_000_000
    flat = [
        (i, "pg", "DB", user, f"192.0.2.{actor}", base + 60 * a, base + 60 * b, sev, 0.5, 2, status, "c")
        for i, actor, a, b, sev, status, user in rows
    ]
    kind = FIELDS.replace("timestamp", "long")
    return spark.createDataFrame(flat, kind).withColumns(
        {c: F.timestamp_seconds(c) for c in ("first_seen", "last_seen")}
    )


def rows_of(frame):
    return sorted(tuple(str(r[c]) for c in sorted(frame.columns)) for r in frame.collect())


def test_a_late_alert_joins_two_incidents(spark, tmp_path):
    table = IncidentTable(spark, str(tmp_path / "t"), window_minutes=30)
    early, gap = ("a", 1, 0, 5, "low", "resolved", "u"), ("b", 1, 80, 85, "high", "new", "v")
    table.merge(alerts(spark, [early, gap, ("x", 2, 0, 0, "info", "new", "u")]), 0)
    before = {r.incident_id for r in table.incidents().collect()}
    assert len(before) == 3
    late = ("c", 1, 30, 55, "critical", "acknowledged", "w")
    for _ in range(2):  # a set that is written again changes nothing
        table.merge(alerts(spark, [late]), 1)
        gone = {r.incident_id for r in table.withdrawn(1).collect()}
        now = {r.incident_id for r in table.incidents().collect()}
        assert len(gone) == 1 and now == before - gone
    joined = table.incidents().where("alert_count = 3").first()
    assert (joined.severity, joined.status, joined.occurrence_count) == ("critical", "open", 6)
    names = {r.name for r in table.names().where(F.col("incident_id") == joined.incident_id).collect()}
    assert names == {"u", "v", "w", "192.0.2.1", "c"}


def test_batches_in_any_order_equal_one_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for n in range(160):
        a = rng.randrange(1500)
        rows.append((f"a{n}", rng.randrange(4), a, a + rng.choice([0, 0, 3, 40, -2]),
                     rng.choice(["info", "low", "odd", "high"]),
                     rng.choice(["new", "acknowledged", "resolved"]), f"u{rng.randrange(5)}"))
    table = IncidentTable(spark, str(tmp_path / "t"), window_minutes=10)
    for number in range(5):
        table.merge(alerts(spark, rows[number::5]), number)
        if number == 2:
            table.fold()
    whole = alerts(spark, rows)
    got = with_names(table.incidents(), table.names())
    assert rows_of(got) == rows_of(correlate(whole, window_minutes=10))
    assert rows_of(table.names()) == rows_of(incident_names(whole, window_minutes=10))
    table.merge(alerts(spark, []), 5)
    assert rows_of(with_names(table.incidents(), table.names())) == rows_of(got)

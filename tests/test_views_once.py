from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import registry, views
from quillwatch.operators.alerts import enrich_detections
from quillwatch.session import spread_rows, stored

ROWS = 32
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    at = datetime(2024, 1, 3, 8)
    rows = [
        (n, at + timedelta(minutes=n), n % 5, "view", 1.0, '{"k": 1}') for n in range(ROWS)
    ]  # two rows for every one of the sixteen statements, twelve of which score 0.5 or more
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(
    "name",
    ["lifecycle_effects", "lifecycle_states", "prune_event_cascade", "panel_values", "log_sink_replay"],
)
def test_a_lifecycle_query_derives_its_occurrences_once(spark, tables, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(key):
        seen.add(1)
        return key

    def enriched(detections, **options):
        rows = enrich_detections(detections, **options)
        return rows.withColumn("alert_id", counted("alert_id"))

    monkeypatch.setattr(views, "enrich_detections", enriched)
    found = views.detections(spark, tables).count()
    assert 0 < found < ROWS
    registry.QUERIES[name](spark, tables).collect()
    assert seen.value == found
    # nothing is kept for the next query
    registry.QUERIES[name](spark, tables).collect()
    assert seen.value == 2 * found


def test_a_table_of_few_row_groups_is_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(5_000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    tasks = spark.sparkContext.defaultParallelism
    wide = spread_rows(rows, "id")
    filled = wide.select(F.spark_partition_id()).distinct().count()
    assert filled >= min(tasks, 2) and wide.rdd.getNumPartitions() == 3 * tasks
    assert sorted(r.id for r in wide.collect()) == list(range(5_000))
    many = spark.range(5_000, numPartitions=tasks)
    assert spread_rows(many, "id") is many


def test_queries_without_payload_record_keys_and_times_only(spark, tables, monkeypatch):
    written = []

    def watched(frame, name):
        written.append((name, len(frame.columns)))
        return stored(frame, name)

    monkeypatch.setattr(views, "stored", watched)
    for name in ("lifecycle_effects", "lifecycle_events", "rejected_actions"):
        registry.QUERIES[name](spark, tables).collect()
    assert written == [("steps", 5)] * 3


def test_the_cascade_orders_its_steps_once(spark, tables, monkeypatch):
    written = []

    def watched(frame, name):
        written.append(name)
        return stored(frame, name)

    monkeypatch.setattr(views, "stored", watched)
    rows = registry.QUERIES["prune_event_cascade"](spark, tables).collect()
    assert rows and written == ["occurrences", "timeline"]


def test_views_of_one_query_are_one_frame(spark, tables):
    @views.one_query
    def query(spark, sf):
        assert views.recorded(spark, sf) is views.recorded(spark, sf)
        assert views.states(spark, sf) is views.states(spark, sf)
        return views.states(spark, sf)

    first, second = query(spark, tables), query(spark, tables)
    assert first is not second and first.count() == second.count() > 0
    assert views.recorded(spark, tables).inputFiles() != views.recorded(spark, tables).inputFiles()

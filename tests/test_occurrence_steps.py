"""Rows that need no folding or listing skip those steps, with the same results as the others."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import registry, views
from quillwatch.functions.text import WHITESPACE, strip
from quillwatch.operators.alerts import fingerprint, with_fingerprint
from quillwatch.operators.detection import DEFAULT_RULES, detect
from quillwatch.schemas import FINGERPRINT_FIELDS
from quillwatch.sources.audit import normalize_events

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    at = datetime(2024, 1, 3, 8)
    rows = [(n, at + timedelta(minutes=n), n % 5, "view", 1.0, '{"k": 1}') for n in range(32)]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_occurrences_list_no_indicators(spark, tables):
    plan = views.occurrences(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert DEFAULT_RULES[0].description not in plan


def test_classification_follows_the_indicators(spark, tables):
    found = detect(views.events(spark, tables)).select("classification", "indicators").collect()
    assert {bool(r.indicators) for r in found} == {True, False}
    assert all((r.classification == "suspicious_sql_activity") == bool(r.indicators) for r in found)


def test_rows_that_skip_the_fingerprint_steps_agree_with_the_others(spark):
    rng = random.Random(7)
    parts = ["Select", "a", "É", "ß", " ", "  ", "\t", "\x1f", "\x7f", '"', "\\", " ", " ", "Z", ";"]
    texts = [None, "", " ", "\x7f", "\x7f ", " \x7f", "a b", "a  b", " a", "a ", "\x1ca"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(300)]
    rows = [tuple(rng.choice(texts) for _ in FINGERPRINT_FIELDS) for _ in range(300)]
    rows += [tuple(rng.choice(["Ab c", "x", ""]) for _ in FINGERPRINT_FIELDS) for _ in range(50)]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FINGERPRINT_FIELDS))
    both = with_fingerprint(frame).withColumn("whole", fingerprint())
    assert both.where(~F.col("fingerprint").eqNullSafe(F.col("whole"))).count() == 0
    assert both.columns == [*frame.columns, "fingerprint", "whole"]


def test_events_are_stripped_and_all_violations_listed(spark):
    at = datetime(2024, 1, 3)
    ends = ["", *WHITESPACE, "\x7f", "!", "é", "a"]
    rows = [(at, f"{x}q{y}", "u", "d", None, 1.0, 1) for x in ends for y in ends]
    rows += [
        (None, None, " ", "", None, -1.0, -1),
        (at, "q", None, "d", "h", None, None),
        (at, "q", "u", "d", "h", 0.0, -2),
    ]
    kinds = (
        "event_time timestamp, query_text string, username string, database_name string, "
        "client_ip string, duration_ms double, rows_affected bigint"
    )
    raw = spark.createDataFrame(rows, kinds).withColumn("event_id", F.monotonically_increasing_id())
    events = normalize_events(raw)
    joined = events.join(raw.withColumn("event_id", F.col("event_id").cast("string")), "event_id")
    wrong = ~F.col("query").eqNullSafe(strip(F.col("query_text")))
    assert joined.count() == len(rows) and joined.where(wrong).count() == 0
    listed = events.where(F.size("violations") > 0).select("violations").collect()
    assert sorted(r.violations for r in listed) == sorted(
        [
            [
                "query is empty",
                "username is empty",
                "database is empty",
                "timestamp is missing",
                "duration_ms is negative",
                "rows_affected is negative",
            ],
            ["username is empty"],
            ["rows_affected is negative"],
        ]
    )
    assert events.where(F.col("violations").isNull()).count() == 0


@pytest.mark.parametrize("name", ["store_verification", "panel_values"])
def test_queries_that_read_the_states_twice_derive_them_once(spark, tables, monkeypatch, name):
    written, keep = [], views.stored

    def noted(frame, name):
        written.append(name)
        return keep(frame, name)

    monkeypatch.setattr(views, "stored", noted)
    assert registry.QUERIES[name](spark, tables).count() > 0
    assert sorted(written) == ["occurrences", "states"]

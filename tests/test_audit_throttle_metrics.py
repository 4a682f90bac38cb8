import json
import random
from collections import deque

from pyspark.sql import functions as F

from quillwatch.functions.hashing import GENESIS_HASH, canonical_json, sha256_hex
from quillwatch.operators.audit_chain import (
    append_audit_events,
    audit_records,
    chain_tails,
    verify_audit_log,
)
from quillwatch.operators.metrics import health_summary, hold_rule, required_down, route_template
from quillwatch.operators.throttle import request_pressure, throttle
from quillwatch.plans.exports import outbox
from quillwatch.sources.lines import numbered_lines


def chain(count, legacy=0):
    lines, previous = [], GENESIS_HASH
    for n in range(1, count + 1):
        record = {"type": "audit", "action": f"a{n}", "details": {"n": n, "é": 1e-4}}
        if n <= legacy:
            previous = sha256_hex(canonical_json(record))
        else:
            record |= {"sequence": n, "previous_hash": previous}
            record["record_hash"] = sha256_hex(canonical_json(record))
            previous = record["record_hash"]
        lines.append(json.dumps(record))
    return lines


def edit(line, **changes):
    return json.dumps(json.loads(line) | changes)


def test_verification_variants(spark):
    good = chain(9, legacy=2)
    variants = {
        "good": (good, (True, 9, 7, 2, None, "ok")),
        "blank": ([good[0], " ", *good[1:]], (True, 9, 7, 2, None, "ok")),
        "tampered": ([*good[:4], edit(good[4], action="x"), *good[5:]],
                     (False, 5, 2, 2, 5, "record_hash_mismatch")),
        "resequenced": ([*good[:5], edit(good[5], sequence=99), *good[6:]],
                        (False, 6, 3, 2, 6, "invalid_sequence")),
        "relinked": ([*good[:3], edit(good[3], previous_hash="0" * 64), *good[4:]],
                     (False, 4, 1, 2, 4, "previous_hash_mismatch")),
        "broken": ([*good[:3], "{", *good[3:]], (False, 4, 1, 2, 4, "invalid_json")),
        "list": (["[1]", *good], (False, 1, 0, 0, 1, "record_is_not_an_object")),
        "float": ([*good[:2], edit(good[2], sequence="3")], (False, 3, 0, 2, 3, "invalid_sequence")),
    }
    rows = [
        (name, n, line)
        for name, (lines, _) in variants.items()
        for n, line in enumerate(lines, start=1)
    ]
    frame = spark.createDataFrame(rows, "chain string, line_no long, raw string")
    for block in (2, 3, 1000):
        got = {
            r.chain: (r.valid, r.records, r.chained_records, r.legacy_records, r.failure_line,
                      r.message)
            for r in verify_audit_log(frame, chain="chain", block_lines=block).collect()
        }
        assert got == {name: expected for name, (_, expected) in variants.items()}


def test_append_continues_a_file(spark, tmp_path):
    log = tmp_path / "audit.jsonl"
    log.write_text("\n".join(chain(5, legacy=1)) + "\n")
    lines = numbered_lines(spark, str(log))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3, 4, 5]
    tails = chain_tails(audit_records(lines))
    entries = tails.select("chain", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select(
        "chain", F.lit("2026-01-01T00:00:00+00:00").alias("at"),
        F.col("k").cast("string").alias("order_key"), F.lit(" go ").alias("action"),
        F.lit("success").alias("status"), F.lit('{"b": 1, "a": 2}').alias("details"),
    )
    added = append_audit_events(tails, entries).orderBy("sequence").collect()
    assert [r.sequence for r in added] == [6, 7, 8]
    with log.open("a") as stream:
        stream.write("\n".join(r.raw for r in added) + "\n")
    row = verify_audit_log(numbered_lines(spark, str(log))).first()
    assert (row.valid, row.records, row.chained_records) == (True, 8, 7)


def test_throttle_matches_sequential_limiter(spark):
    rng = random.Random(5)
    rows, expected, pressure = [], {}, {}
    for key in range(6):
        at, held, seen = 1_700_000_000_000_000, deque(), deque()
        for n in range(400):
            at += rng.choice([1, 100_000, 2_000_000, 9_000_000, 70_000_000 if n % 40 == 0 else 1])
            request = f"{key}-{n:04d}"
            rows.append((request, f"k{key}", at))
            while held and held[0] <= at - 60_000_000:
                held.popleft()
            if len(held) >= 5:
                wait = max(1, (60_000_000 - (at - held[0])) // 1_000_000)
                expected[request] = (False, wait)
            else:
                held.append(at)
                expected[request] = (True, None)
            seen.append(at)
            while seen[0] <= at - 60_000_000:
                seen.popleft()
            pressure[request] = len(seen)
    frame = spark.createDataFrame(rows, "request_id string, client string, m long").select(
        "request_id", "client", F.timestamp_micros("m").alias("ts")
    )
    got = {r.request_id: (r.accepted, r.retry_after) for r in throttle(frame, limit=5).collect()}
    assert got == expected
    assert {False, True} == {ok for ok, _ in expected.values()}
    counted = {r.request_id: r.in_last_minute for r in request_pressure(frame, limit=5).collect()}
    assert counted == pressure


def test_routes_health_and_rules(spark):
    paths = {
        "/api/v1/alerts/a1": "/api/v1/alerts/{alert_id}",
        "/api/v1/alerts/a1/ack": "/api/v1/alerts/{alert_id}/ack",
        "/api/v1/alerts/a1/x": "/api/v1/alerts/a1/x",
        "/api/v1/incidents/i/assessment": "/api/v1/incidents/{incident_id}/assessment",
        "  ": "/",
        "/health/live": "/health/live",
    }
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.t for r in frame.select("p", route_template(F.col("p")).alias("t")).collect()}
    assert got == paths
    probes = spark.createDataFrame(
        [("api", True, True), ("grafana", False, False)],
        "name string, required boolean, healthy boolean",
    )
    row = health_summary(probes).first()
    assert (row.status, row.healthy_count, row.optional_failures) == ("healthy", 1, ["grafana"])
    up = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "component string, value int")
    need = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "component string, value int")
    assert [r.component for r in required_down(up, need).collect()] == ["a"]
    samples = [("s", 1_700_000_000 + 15 * i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, 1, 1, 0])]
    series = spark.createDataFrame(samples, "series string, t long, v int").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    for block in (20, 86_400):
        spells = hold_rule(series, F.col("v") > 0, hold_seconds=60, block_seconds=block)
        found = sorted((r.samples, r.fires) for r in spells.collect())
        assert found == [(2, False), (5, True)]


def test_outbox_signature(spark):
    import hashlib
    import hmac

    frame = spark.createDataFrame([("é", 0.0001)], "b string, a double")
    row = outbox(frame, secret="s", sent_at="2026-01-01T00:00:00Z").first()
    assert row.body == '{"a":0.0001,"b":"é"}' and row.timestamp == "1767225600"
    digest = hmac.new(b"s", f"1767225600.{row.body}".encode(), hashlib.sha256).hexdigest()
    assert row.signature == "sha256=" + digest

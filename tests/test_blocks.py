"""Operators that cut a hot key into blocks, against one pass in order."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import throttle as limiter
from quillwatch.operators.lifecycle import lifecycle_timeline
from quillwatch.operators.metrics import counter_increase, hold_rule

MINUTE = 60_000_000


def limited(rows, limit):
    out, held = {}, {}
    for request, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        window = held.setdefault(key, deque())
        while window and window[0] <= at - MINUTE:
            window.popleft()
        if len(window) >= limit:
            out[request] = (False, max(1, (MINUTE - (at - window[0])) // 1_000_000))
        else:
            window.append(at)
            out[request] = (True, None)
    return out


@pytest.mark.parametrize("rounds", [0, 6])
def test_throttle_of_a_client_with_most_requests(spark, rounds):
    """One client is over its limit for hours, with and without pauses; ids beyond 2**53."""
    rng = random.Random(4)
    rows, number = [], 2**60
    for key in range(4):
        at = 1_700_000_000_000_000
        for n in range(2500 if key == 0 else 120):
            at += rng.choice([100_000, 2_000_000, 9_000_000, 25_000_000])
            if n % 400 == 399:
                at += 3 * MINUTE // 4  # a pause within a spell
            number += 1
            rows.append((number, f"k{key}", at))
    frame = spark.createDataFrame(rows, "request_id long, client string, m long").select(
        "request_id", "client", F.timestamp_micros("m").alias("ts")
    )
    done = limiter.throttle(frame, limit=4, block_seconds=600, rounds=rounds)
    got = {r.request_id: (r.accepted, r.retry_after) for r in done.collect()}
    assert got == limited(rows, 4)


def test_lifecycle_of_an_alert_with_most_steps(spark):
    rng = random.Random(6)
    occ, act, want = [], [], {}
    for alert, count in (("hot", 900), ("a", 20), ("b", 5)):
        at, state = 1_700_000_000_000_000, "none"
        for k in range(count):
            at += rng.choice([0, 1, 300_000, 40_000_000])
            kind = rng.choice("ooooar")
            key = f"{alert}{k:04d}"
            if kind == "o":
                occ.append((alert, key, at))
            else:
                act.append((alert, key, "acknowledged" if kind == "a" else "resolved", at))
        steps = [(t, 0, k, "o") for i, k, t in occ if i == alert]
        steps += [(t, 1, k, a[0]) for i, k, a, t in act if i == alert]
        for _, _, key, kind in sorted(steps):
            if kind == "o":
                effect = {"none": "created", "resolved": "reopened"}.get(state, "occurrence")
                state = "acknowledged" if state == "acknowledged" else "new"
            elif kind == "a":
                effect = "acknowledged" if state == "new" else "rejected"
                state = "acknowledged" if effect == "acknowledged" else state
            else:
                effect = "resolved" if state in ("new", "acknowledged") else "rejected"
                state = "resolved" if effect == "resolved" else state
            if effect != "occurrence":
                want[alert, key] = effect
    o = spark.createDataFrame(occ, "alert_id string, occurrence_key string, m long").select(
        "alert_id", "occurrence_key", F.timestamp_micros("m").alias("last_seen")
    )
    a = spark.createDataFrame(act, "alert_id string, action_key string, action string, m long").select(
        "alert_id", "action_key", "action", F.timestamp_micros("m").alias("at"),
        F.lit("x").alias("actor"), F.lit(None).cast("string").alias("note"),
    )
    for seconds in (60, 900):
        rows = lifecycle_timeline(o, a, block_seconds=seconds).where("effect <> 'occurrence'")
        assert {(r.alert_id, r.step_key): r.effect for r in rows.collect()} == want
    plan = lifecycle_timeline(o, a)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_hold_spells_across_blocks(spark):
    rng = random.Random(2)
    samples, want = [], set()
    for name in range(5):
        t, spell = 1_700_000_000, []
        for _ in range(300):
            t += rng.choice([5, 15, 60, 400])
            ok = rng.random() < (1.0 if name == 0 else 0.8)
            samples.append((f"s{name}", t, ok))
            if ok:
                spell.append(t)
            elif spell:
                want.add((f"s{name}", tuple(spell)))
                spell = []
        if spell:
            want.add((f"s{name}", tuple(spell)))
    frame = spark.createDataFrame(samples, "series string, t long, ok boolean").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    expected = sorted(
        (s, x[0], x[-1], len(x), next((t for t in x if t >= x[0] + 120), None)) for s, x in want
    )
    for block in (30, 1000, 10**7):
        rows = hold_rule(frame, F.col("ok"), hold_seconds=120, block_seconds=block).select(
            "series", F.unix_seconds("started"), F.unix_seconds("ended"), "samples",
            F.unix_seconds("fires_at"),
        )
        assert sorted(map(tuple, rows.collect())) == expected


def increase_of(points, at, span):
    inside = [(t, v) for t, v in points if at - span < t <= at]
    if len(inside) < 2:
        return None
    growth = 0.0
    for (_, a), (_, b) in zip(inside, inside[1:], strict=False):
        growth += b if b < a else b - a
    covered = inside[-1][0] - inside[0][0]
    mean = covered / (len(inside) - 1)
    lead, trail = inside[0][0] - (at - span), at - inside[-1][0]
    lead, trail = (x if x < mean * 1.1 else mean / 2 for x in (lead, trail))
    if growth > 0:
        lead = min(lead, covered * inside[0][1] / growth)
    return growth * (covered + lead + trail) / covered


def test_increase_with_resets(spark):
    rng = random.Random(7)
    rows, points = [], {}
    for name in ("a", "b"):
        t, value = 1_700_000_000, 0.0
        for _ in range(200):
            t += rng.choice([10, 30, 90, 700])
            value = 1.0 if rng.random() < 0.05 else value + rng.randrange(4)
            rows.append((name, t, value))
            points.setdefault(name, []).append((t, value))
    samples = spark.createDataFrame(rows, "series string, t long, value double").select(
        "series", F.timestamp_seconds("t").alias("ts"), "value"
    )
    asked = [(n, p[0] + d) for n, x in points.items() for p in x for d in (0, 45)]
    at = spark.createDataFrame(asked, "series string, t long").select(
        "series", F.timestamp_seconds("t").alias("at")
    )
    got = counter_increase(samples, at, range_seconds=300).select(
        "series", F.unix_seconds("at").alias("t"), "increase"
    )
    for r in got.collect():
        want = increase_of(points[r.series], r.t, 300)
        assert r.increase == (None if want is None else pytest.approx(want, rel=1e-12))

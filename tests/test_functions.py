import json
import random

from pyspark.sql import functions as F

from quillwatch.functions.numeric import clamp_unit, fixed_text, positive_long, round_unit
from quillwatch.functions.text import (
    casefold,
    collapse_spaces,
    json_ascii_string,
    json_number,
    json_string,
    preview,
    strip,
)
from quillwatch.functions.times import iso_text, parse_iso
from quillwatch.operators.alerts import fingerprint, with_fingerprint

TEXTS = [
    " É ß İstanbul ΟΔΟΣ  ",
    "a\x1fb\x1c",
    'plain "q" \\ / \x7f',
    "😀 é \x01",
    "ꭰ Ꭰ ſ ẞ µ",
    "\x85 x　",
    "",
    "tab\tnew\nline\r\x0c\x08",
]


def test_text_matches_python(spark):
    c = F.col("s")
    rows = (
        spark.createDataFrame([(t,) for t in TEXTS], "s string")
        .select(
            "s",
            strip(c).alias("strip"),
            collapse_spaces(c).alias("collapse"),
            casefold(c).alias("fold"),
            json_string(c).alias("raw"),
            json_ascii_string(c).alias("ascii"),
        )
        .collect()
    )
    for r in rows:
        assert r["strip"] == r.s.strip()
        assert r["collapse"] == " ".join(r.s.split())
        assert r["fold"] == r.s.casefold()
        assert r["raw"] == json.dumps(r.s, ensure_ascii=False)
        assert r["ascii"] == json.dumps(r.s)


def test_rounding_matches_python(spark):
    rng = random.Random(7)
    values = {rng.random() * 10 ** -rng.randint(0, 6) for _ in range(5000)}
    values |= {k / 2**n for n in range(1, 17) for k in range(0, 2**n + 1, max(1, 2**n // 64))}
    values |= {0.0, 1.0, 5e-5, 6e-5, 4.9e-5, 0.125, 0.375}
    frame = spark.createDataFrame([(v,) for v in sorted(values)], "x double")
    x = F.col("x")
    for r in frame.select("x", round_unit(x).alias("r"), fixed_text(x, 2).alias("t")).collect():
        assert r.r == round(r.x, 4), r.x
        assert r.t == f"{r.x:.2f}", r.x


def test_number_text_and_coercions(spark):
    row = spark.createDataFrame([("7", "x", "-1", "0.25")], "a string, b string, c string, d string")
    got = row.select(
        positive_long(F.col("a")),
        positive_long(F.col("b"), 3),
        positive_long(F.col("c")),
        clamp_unit(F.col("d")),
        clamp_unit(F.col("b")),
        clamp_unit(F.lit(7.0)),
        json_number(F.lit(0.0001)),
        json_number(F.lit(1.0)),
        json_number(F.lit(0.19)),
        preview(F.lit("a  b" + "c" * 20), 10),
    ).first()
    assert tuple(got) == (7, 3, 1, 0.25, 0.0, 1.0, "0.0001", "1.0", "0.19", "a bcccc...")


def test_iso_times(spark):
    texts = [
        ("2024-01-01", "2024-01-01T00:00:00+00:00"),
        ("2024-01-01T10:00", "2024-01-01T10:00:00+00:00"),
        ("2024-01-01 10:00:00Z", "2024-01-01T10:00:00+00:00"),
        ("2024-01-01T10:00:00.5+02:00", "2024-01-01T08:00:00.500000+00:00"),
        ("nonsense", None),
        ("2024-13-01", None),
    ]
    frame = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    got = [r[0] for r in frame.select(iso_text(parse_iso(F.col("t")))).collect()]
    assert got == [e for _, e in texts]


def test_fingerprint_normalizes_and_both_forms_agree(spark):
    schema = (
        "classification string, client_ip string, database string, query string, "
        "source_system string, username string"
    )
    rows = [
        ("c", None, "Straße", "SELECT\t 1  ", "pg", "Bob"),
        ("C ", "", "STRASSE", " select 1", "PG", "bob"),
        ("c", None, "x", 'q "1" \\ \x01', "pg", "bob"),
    ]
    frame = with_fingerprint(spark.createDataFrame(rows, schema), "staged")
    got = frame.select("staged", fingerprint().alias("direct")).collect()
    assert all(r.staged == r.direct for r in got)
    assert got[0].staged == got[1].staged != got[2].staged
    import hashlib

    fields = {
        "classification": "c",
        "client_ip": "",
        "database": "strasse",
        "query": "select 1",
        "source_system": "pg",
        "username": "bob",
    }
    canonical = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0].staged == hashlib.sha256(canonical.encode()).hexdigest()


def test_iso_forms_like_python(spark):
    from datetime import UTC, datetime

    from quillwatch.functions.times import parse_iso

    texts = [
        "20240101T000000", "20240101", "2024-01-01T10", "20240101T1015", "2024-01-01T10+05",
        "2024-01-01T10:15:30+05:30:15", "20240229T101530.25Z", "2024-01-01 10:15-0330",
        "2024-01-01T10:15:30,5", "2024-01-01", "2024-01-01T10:15:30.123456+00:00",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.unix_micros(parse_iso(F.col("t"))).alias("u")).collect()
    for row in got:
        when = datetime.fromisoformat(row.t.replace(",", "."))
        when = when if when.tzinfo else when.replace(tzinfo=UTC)
        assert row.u == round(when.timestamp() * 1_000_000), row.t
    bad = spark.createDataFrame([("2024-1-1",), ("x",), ("",), ("2024-13-01",)], "t string")
    assert bad.where(parse_iso(F.col("t")).isNotNull()).count() == 0


def test_audit_page_sql():
    from quillwatch.sources.audit import audit_page_sql

    assert audit_page_sql('a"b') == '"public"."a""b"'
    page = audit_page_sql("audit", since="2024-01-01' OR 1=1", limit=5)
    assert "event_time > TIMESTAMP '2024-01-01'' OR 1=1'" in page
    assert page.endswith("ORDER BY event_time LIMIT 5) AS page")


def test_title_case_like_python(spark):
    from quillwatch.functions.text import title_case

    texts = ["very-high", "o'brien x2y", "ÉTÉ d'or", "", "a_b  C"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", title_case(F.col("t")).alias("u")).collect():
        assert row.u == row.t.title()

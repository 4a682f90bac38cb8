import re

import pytest
from pyspark.sql import functions as F

from quillwatch.operators.detection import (
    DEFAULT_RULES,
    Rule,
    analyze,
    detect,
    mask_decisions,
    match_rules,
    sql_functions,
    threshold,
)
from quillwatch.sources.audit import normalize_events, quarantined, scan_audit

DOTALL = {"grant-privileges", "revoke-privileges"}


def frame(spark, statements):
    return spark.createDataFrame([(s,) for s in statements], "query string")


@pytest.mark.parametrize(
    "statement, score, severity",
    [
        ("SELECT id, name FROM customers WHERE id = 10;", 0.0, "info"),
        ("DROP DATABASE production;", 0.95, "critical"),
        ("DROP TABLE customers;", 0.80, "high"),
        ("DELETE FROM transactions;", 0.85, "high"),
        ("SELECT a FROM t UNION SELECT b FROM u", 0.55, "medium"),
        ("EXEC xp_cmdshell 'whoami';", 0.95, "critical"),
        ("SELECT 1 -- note", 0.2, "low"),
    ],
)
def test_expected_scores(spark, statement, score, severity):
    row = analyze(frame(spark, [statement])).first()
    assert (row.risk_score, row.severity) == (score, severity)
    assert row.is_anomalous == (score >= 0.5)
    if not score:
        assert row.indicators == [] and row.classification == "normal_sql_activity"
        assert row.explanation.startswith("No suspicious SQL pattern")
    else:
        assert row.explanation.startswith(f"The event received a risk score of {score:.2f}. ")


def test_rules_match_python_regexes(spark):
    statements = [
        "OR é=é", "x OR 1=10", "DELETE FROM t;\n", "DELETE FROM t; SELECT 1", "select ſleep(1)",
        "drop table x", "drop\x1ctable x", "GRANT a\nb TO c", "²DROP TABLE x", "́drop table x",
        "OR 'a'='a'", "WAITFOR x", "/*", 'DELETE FROM "a".[b]', "revoke x　from y",
        "xtruncate t", "truncate\n", "LOAD_FILE (", "union  all\tselect", "ORDER BY 1=1",
        "pg_ſleep", "DROP  DATABASEx", "or \"a\" = 'a'", "éxp_cmdshell", "xp_cmdshell-",
    ]
    got = match_rules(frame(spark, statements)).select("query", "rule_mask").collect()
    for row in got:
        for bit, rule in enumerate(DEFAULT_RULES):
            flags = re.IGNORECASE | (re.DOTALL if rule.name in DOTALL else 0)
            expected = bool(re.search(rule.pattern, row.query, flags))
            assert bool(row.rule_mask >> bit & 1) == expected, (row.query, rule.name)


def test_every_rule_subset_scores_exactly(spark):
    masks = spark.range(0, 1 << 12).withColumnRenamed("id", "rule_mask")
    rows = mask_decisions(masks, DEFAULT_RULES, "d", "1").select("rule_mask", "risk_score").collect()
    assert len(rows) == 4096
    for row in rows:
        safety = 1.0
        for bit, rule in enumerate(DEFAULT_RULES):
            if row.rule_mask >> bit & 1:
                safety *= 1.0 - rule.weight
        assert row.risk_score == (round(1.0 - safety, 4) if row.rule_mask else 0.0)


def test_many_rules_without_table_and_custom_rule(spark):
    rules = [Rule(f"r{i}", rf"\bword{i}\b", 0.1, f"w{i}") for i in range(20)]
    row = detect(frame(spark, ["word3 and word19"]), rules).where("risk_score > 0.1").first()
    assert row.indicators == ["w3", "w19"] and row.risk_score == 0.19


def test_detector_outside_range_stops(spark):
    def bad(events):
        return events.withColumns(
            {
                "risk_score": F.lit(1.5),
                "severity": F.lit("high"),
                "classification": F.lit("c"),
                "indicators": F.array(F.lit("i")),
                "detector_name": F.lit("n"),
            }
        )

    with pytest.raises(Exception, match="between 0.0 and 1.0"):
        analyze(frame(spark, ["x"]), detector=bad).collect()


def test_threshold_checks(spark):
    with pytest.raises(ValueError):
        threshold(frame(spark, ["x"]), 1.5)
    with pytest.raises(ValueError):
        threshold(frame(spark, ["x"]), 0.5, "urgent")


def test_sql_functions(spark):
    sql_functions(spark)
    got = spark.sql("select risk_score('drop table t -- x') s, risk_severity('OR 1=1') v").first()
    assert (got.s, got.v) == (0.84, "medium")


def test_scan_and_quarantine(spark):
    rows = spark.sql(
        "select timestamp'2026-01-01 00:00:00' event_time, ' SELECT 1 ' query_text, 'u' username, "
        "'d' database_name, null client_ip, 1.5D duration_ms, 1L rows_affected union all "
        "select timestamp'2026-01-02 00:00:00', '  ', 'u', null, 'i', -1D, -2L"
    )
    events = normalize_events(rows)
    bad = quarantined(events).first()
    assert bad.violations == [
        "query is empty", "database is empty", "duration_ms is negative",
        "rows_affected is negative",
    ]
    assert events.where("size(violations) = 0").first().query == "SELECT 1"
    with pytest.raises(Exception, match="Bad audit row"):
        normalize_events(rows, mode="failfast").collect()
    assert scan_audit(rows, since="2026-01-01 00:00:00").count() == 1
    assert scan_audit(rows, limit=1).first().query_text == " SELECT 1 "
    with pytest.raises(ValueError):
        scan_audit(rows, limit=0)


def test_word_boundaries_like_python(spark):
    import re

    patterns = [
        r"\b(foo|bar)\b", r"\b\w+\s+from\b", r"\b[a-z]+\b", r"x\b\.", r"[\w]\b-\bq", r"\bfoo?\b",
        r"\\b", r"(ab)\b\s\b(cd)", r"é\b",
    ]
    texts = ["select foo from t", "bar", "foobar", "x.", "a-q", "fo", "a\\b", "ab cd", "é", "éa", "-"]
    rows = spark.createDataFrame([(t,) for t in texts], "query string")
    rules = [Rule(f"r{i}", p, 0.1, f"d{i}") for i, p in enumerate(patterns)]
    for row in match_rules(rows, rules).collect():
        for bit, pattern in enumerate(patterns):
            expected = re.search(pattern, row.query, re.IGNORECASE) is not None
            assert bool(row.rule_mask >> bit & 1) == expected, (row.query, pattern)

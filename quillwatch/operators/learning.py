"""Three-level assessment of an incident: detection, response, governance.

Pure projections on incident rows; they add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.numeric import clamp_unit, positive_long, round_unit
from quillwatch.functions.text import casefold, strip

# Share of each severity, and the weights of the four factors.
SEVERITY_SHARE = {"info": 0.05, "low": 0.15, "medium": 0.35, "high": 0.65, "critical": 0.90}
RISK_WEIGHT = 0.45
SEVERITY_WEIGHT = 0.30
RECURRENCE_WEIGHT = 0.15
DIVERSITY_WEIGHT = 0.10


def detection_loop(risk: Column, alerts: Column, occurrences: Column, classes: Column) -> Column:
    return F.struct(
        F.lit("detect_and_explain").alias("objective"),
        round_unit(risk, 4).alias("signal_strength"),
        alerts.alias("evidence_alerts"),
        occurrences.alias("observed_occurrences"),
        classes.alias("classifications"),
    )


def response_loop(severity: Column, alerts: Column, occurrences: Column) -> Column:
    urgent = severity.isin("critical", "high")
    repeated = occurrences >= 3
    return F.struct(
        F.lit("adapt_response").alias("objective"),
        F.when(urgent, "immediate_human_review")
        .when(repeated, "enhanced_monitoring_and_control_tuning")
        .otherwise("standard_analyst_review")
        .alias("response_mode"),
        F.when(urgent, "urgent")
        .when(repeated, "elevated")
        .otherwise("normal")
        .alias("response_priority"),
        severity.isin("medium", "high", "critical").alias("preserve_evidence"),
        ((occurrences > alerts) | repeated).alias("recurrence_detected"),
    )


def governance_loop(severity: Column, occurrences: Column) -> Column:
    action = (
        F.when((severity == "critical") | (occurrences >= 5), "policy_and_control_review")
        .when((severity == "high") | (occurrences >= 3), "control_effectiveness_review")
        .otherwise("retain_current_policy")
    )
    return F.struct(
        F.lit("reflect_on_governance").alias("objective"),
        action.alias("governance_action"),
        (action != "retain_current_policy").alias("requires_documented_rationale"),
        (occurrences >= 3).alias("feedback_candidate"),
    )


def learning_score(
    risk: Column, severity: Column, occurrences: Column, classes: Column
) -> Column:
    """Weighted sum of risk, severity, recurrence and diversity, at most 1, not rounded.

    Terms are added left to right so that the double is reproducible.
    """
    share = F.lit(SEVERITY_SHARE["info"])
    for name, value in SEVERITY_SHARE.items():
        share = F.when(severity == name, F.lit(value)).otherwise(share)
    recurrence = F.least(F.lit(1.0), occurrences / F.lit(10.0))
    diversity = F.least(F.lit(1.0), F.size(F.array_distinct(classes)) / F.lit(4.0))
    total = (
        risk * F.lit(RISK_WEIGHT)
        + share * F.lit(SEVERITY_WEIGHT)
        + recurrence * F.lit(RECURRENCE_WEIGHT)
        + diversity * F.lit(DIVERSITY_WEIGHT)
    )
    return F.least(F.lit(1.0), total)


def assess(incidents: DataFrame) -> DataFrame:
    """Incidents with the nested column ``triple_loop``."""
    severity = casefold(F.coalesce("severity", F.lit("info")))
    prepared = incidents.withColumns(
        {
            "_severity": severity,
            "_risk": clamp_unit(F.col("risk_score")),
            "_alerts": positive_long(F.col("alert_count")),
            "_classes": F.filter(
                F.coalesce("classifications", F.array().cast("array<string>")),
                lambda c: strip(c) != "",
            ),
        }
    ).withColumn("_occurrences", positive_long(F.col("occurrence_count"), F.col("_alerts")))
    risk, alerts, occurrences, classes, level = (
        F.col("_risk"),
        F.col("_alerts"),
        F.col("_occurrences"),
        F.col("_classes"),
        F.col("_severity"),
    )
    scored = prepared.withColumn("_score", learning_score(risk, level, occurrences, classes))
    urgent = level.isin("high", "critical")
    loops = F.struct(
        detection_loop(risk, alerts, occurrences, classes).alias("loop1_detection"),
        response_loop(level, alerts, occurrences).alias("loop2_adaptation"),
        governance_loop(level, occurrences).alias("loop3_reflection"),
        round_unit(F.col("_score"), 4).alias("learning_score"),
        (urgent | (occurrences >= 3)).alias("escalation_required"),
        urgent.alias("human_approval_required"),
    )
    return scored.withColumn("triple_loop", loops).drop(
        "_severity", "_risk", "_alerts", "_classes", "_occurrences", "_score"
    )

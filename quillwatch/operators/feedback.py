"""Policy recommendations from incidents, and analyst decisions on them.

A recommendation is only ever proposed; nothing here applies one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.domains import DECISIONS
from quillwatch.functions.numeric import clamp_unit, fixed_text, positive_long, round_unit
from quillwatch.functions.text import (
    fold_key,
    json_ascii_string,
    json_number,
    json_object,
    json_string,
    optional_text,
    sha256_prefixed,
    strip,
)
from quillwatch.functions.times import iso_text
from quillwatch.operators.once import computed_once
from quillwatch.schemas import FEEDBACK, RECOMMENDATION

RECOMMENDATION_COLUMNS = tuple(c.split()[0] for c in RECOMMENDATION.split(", "))
FEEDBACK_COLUMNS = tuple(c.split()[0] for c in FEEDBACK.split(", "))
MIN_RATIONALE = 8


def _json_or_null(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(json_ascii_string(c))


def _required(c: Column, what: str) -> Column:
    """Stripped text; blank or missing text stops the job."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text != "", text).otherwise(
        F.raise_error(F.lit(f"{what} cannot be empty")).cast("string")
    )


def recommend(
    assessed: DataFrame, *, created_at: str, previous_recommendation_id: Column | None = None
) -> DataFrame:
    """One proposed recommendation per assessed incident.

    The identifier depends on the incident, the proposal, the score and the previous
    recommendation, not on the time. An incident without id or action stops the job.
    """
    previous = optional_text(
        F.lit(None).cast("string")
        if previous_recommendation_id is None
        else previous_recommendation_id
    )
    named = assessed.select(
        _required(F.col("incident_id"), "incident_id").alias("incident_id"),
        _required(
            F.coalesce(
                "triple_loop.loop3_reflection.governance_action", F.lit("retain_current_policy")
            ),
            "proposed_action",
        ).alias("proposed_action"),
        round_unit(clamp_unit(F.col("triple_loop.learning_score")), 4).alias("learning_score"),
        F.coalesce(F.nullif(fold_key(F.col("severity")), F.lit("")), F.lit("unknown")).alias(
            "severity"
        ),
        positive_long(F.col("occurrence_count")).alias("occurrences"),
        previous.alias("previous_recommendation_id"),
    )
    canonical = json_object(
        {
            "incident_id": json_ascii_string(F.col("incident_id")),
            "learning_score": json_number(F.col("learning_score")),
            "previous_recommendation_id": _json_or_null(F.col("previous_recommendation_id")),
            "proposed_action": json_ascii_string(F.col("proposed_action")),
        }
    )
    rationale = F.concat(
        F.lit("Review "),
        "proposed_action",
        F.lit(" for "),
        "severity",
        F.lit(" incident "),
        "incident_id",
        F.lit("; observed occurrences="),
        F.col("occurrences").cast("string"),
        F.lit(", learning score="),
        fixed_text(F.col("learning_score"), 4),
        F.lit("."),
    )
    return computed_once(
        named, recommendation_id=sha256_prefixed("prec_", canonical)
    ).select(
        "recommendation_id",
        "incident_id",
        "proposed_action",
        rationale.alias("rationale"),
        "learning_score",
        F.lit("proposed").alias("status"),
        F.lit(True).alias("requires_human_approval"),
        F.lit(False).alias("auto_apply"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        "previous_recommendation_id",
    )


def feedback_id_of() -> Column:
    return sha256_prefixed(
        "fdbk_",
        json_object(
            {
                "analyst": json_ascii_string(F.col("analyst")),
                "created_at": json_string(iso_text(F.col("created_at"))),
                "decision": json_ascii_string(F.col("decision")),
                "rationale": json_ascii_string(F.col("rationale")),
                "recommendation_id": json_ascii_string(F.col("recommendation_id")),
            }
        ),
    )


def build_feedback(entries: DataFrame) -> DataFrame:
    """Check and identify analyst entries.

    ``entries``: recommendation_id, incident_id, analyst, decision, rationale,
    created_at. Invalid entries keep a ``problem`` and get no identifier.
    """
    cleaned = entries.withColumns(
        {
            "analyst": strip(F.coalesce("analyst", F.lit(""))),
            "rationale": strip(F.coalesce("rationale", F.lit(""))),
            "created_at": F.col("created_at").cast("timestamp"),
        }
    )
    problem = (
        F.when(F.col("analyst") == "", "analyst cannot be empty")
        .when(F.col("rationale") == "", "rationale cannot be empty")
        .when(
            F.length("rationale") < MIN_RATIONALE,
            f"rationale must contain at least {MIN_RATIONALE} characters",
        )
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
        .when(F.col("created_at").isNull(), "created_at must be a timestamp with a zone")
    )
    checked = computed_once(cleaned, problem=problem)
    named = computed_once(checked, _id=feedback_id_of())
    return named.withColumn(
        "feedback_id", F.when(F.col("problem").isNull(), F.col("_id"))
    ).select(*FEEDBACK_COLUMNS, "problem")


def conflicting_ids(frame: DataFrame, key: str) -> DataFrame:
    """Identifiers that occur with more than one content."""
    # a struct compares nulls by their place, which a hash of the values does not
    content = F.struct(*[c for c in frame.columns if c != key])
    return (
        frame.groupBy(key)
        .agg(F.min(content).alias("low"), F.max(content).alias("high"))
        .where(~F.col("low").eqNullSafe(F.col("high")))
        .select(key)
    )


def save_recommendations(stored: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent save: the union without repeats, and the ids that conflict.

    A conflicting id keeps its stored row; of rows that conflict only among the added ones the
    first by time stays.
    """
    both = stored.select(*RECOMMENDATION_COLUMNS).unionByName(added.select(*RECOMMENDATION_COLUMNS))
    conflicts = conflicting_ids(both, "recommendation_id")
    fresh = (
        added.groupBy("recommendation_id")
        .agg(F.min(F.struct(F.col("created_at").alias("_at"), *RECOMMENDATION_COLUMNS)).alias("first"))
        .select("first.*")
        .select(*RECOMMENDATION_COLUMNS)
        .join(stored.select("recommendation_id"), "recommendation_id", "left_anti")
    )
    return stored.select(*RECOMMENDATION_COLUMNS).unionByName(fresh), conflicts


def judge_feedback(recommendations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every distinct feedback row with its ``verdict``.

    The earliest matching decision on a proposed recommendation is accepted. All others
    say why not: unknown recommendation, wrong incident, already decided, or conflicting
    identifier. Repeats of the same row are one row.
    """
    # the identifier is a content hash, so more than one row per id is the rare conflict
    same_id = Window.partitionBy("feedback_id")
    distinct = (
        feedback.select(*FEEDBACK_COLUMNS)
        .dropDuplicates()
        .withColumn("conflict", F.count("*").over(same_id) > 1)
    )
    target = recommendations.select(
        "recommendation_id",
        F.col("incident_id").alias("target_incident"),
        F.col("status").alias("target_status"),
    )
    matched = distinct.join(target, "recommendation_id", "left")
    able = (
        ~F.col("conflict")
        & (F.col("incident_id") == F.col("target_incident"))
        & (F.col("target_status") == "proposed")
    )
    flagged = matched.withColumn("able", F.coalesce(able, F.lit(False)))
    # a minimum per recommendation combines map-side; no ordered window over its feedback
    first = (
        flagged.where("able")
        .groupBy("recommendation_id")
        .agg(F.min(F.struct("created_at", "feedback_id")).alias("first"))
        .select(F.col("first.feedback_id").alias("feedback_id"), F.lit(True).alias("wins"))
    )
    verdict = (
        F.when(F.col("conflict"), "conflicting identifier")
        .when(F.col("target_incident").isNull(), "recommendation not found")
        .when(F.col("incident_id") != F.col("target_incident"), "incident does not match")
        .when(F.col("wins"), "accepted")
        .otherwise("already decided")
    )
    return (
        flagged.join(first, "feedback_id", "left")
        .withColumn("verdict", verdict)
        .select(*FEEDBACK_COLUMNS, "verdict")
    )


def apply_feedback(recommendations: DataFrame, judged: DataFrame) -> DataFrame:
    """Recommendations with the status their accepted decision gives them."""
    # at most one accepted row per recommendation
    decided = judged.where(F.col("verdict") == "accepted").select("recommendation_id", "decision")
    status = (
        F.when(F.col("decision") == "accept", "accepted")
        .when(F.col("decision") == "reject", "rejected")
        .when(F.col("decision") == "revision_required", "revision_required")
        .otherwise(F.col("status"))
    )
    return (
        recommendations.join(decided, "recommendation_id", "left")
        .withColumn("status", status)
        .select(*RECOMMENDATION_COLUMNS)
    )


def unmatched_feedback(recommendations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback whose recommendation does not exist."""
    return feedback.join(
        recommendations.select("recommendation_id"), "recommendation_id", "left_anti"
    )


def list_recommendations(recommendations: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Newest first, optionally of one incident."""
    wanted = (incident_id or "").strip()
    kept = recommendations.where(F.col("incident_id") == wanted) if wanted else recommendations
    return kept.orderBy(F.col("created_at").desc(), "recommendation_id")


def list_feedback(
    feedback: DataFrame, incident_id: str | None = None, recommendation_id: str | None = None
) -> DataFrame:
    """Newest first, optionally of one incident or recommendation."""
    kept = feedback
    for column, value in (("incident_id", incident_id), ("recommendation_id", recommendation_id)):
        wanted = (value or "").strip()
        if wanted:
            kept = kept.where(F.col(column) == wanted)
    return kept.orderBy(F.col("created_at").desc(), "feedback_id")

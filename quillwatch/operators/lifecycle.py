"""Alert lifecycle: full history from raw occurrences and analyst actions, status
changes on a stored state, and replay of an append-only log.

No task walks all rows of an alert. Occurrences are reduced to one row per alert and second
before they are ordered, because one alert may own a large part of all occurrences. Only
occurrences that share a second with an action on the same alert are kept by instant, since
their order against it matters. What is left is ordered in blocks of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.text import strip
from quillwatch.operators.alerts import REOPEN_ACTOR, REOPEN_NOTE, collapse_occurrences
from quillwatch.operators.blocks import time_block
from quillwatch.operators.extra import newest_extra, with_extra
from quillwatch.schemas import ALERT_COLUMNS

ACKNOWLEDGE = "acknowledged"
RESOLVE = "resolved"

#: States of an alert, and the codes of steps.
NONE, NEW, ACKNOWLEDGED, RESOLVED = range(4)
_OCCURS, _ACKS, _RESOLVES, _OTHER = range(4)


def _place_of(code: int) -> Column:
    """Place of the step if it is of this kind."""
    return F.when(F.col("code") == code, F.col("place"))


def _entered(placed: DataFrame) -> DataFrame:
    """``alert_id, block, entry``: the state that each block is entered in."""
    ordered = Window.partitionBy("alert_id").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("alert_id", "block").agg(
        F.max("opens").alias("run"),
        F.max(_place_of(_OCCURS)).alias("occurs"),
        F.max(_place_of(_RESOLVES)).alias("resolves"),
        F.max(_place_of(_ACKS)).alias("acks"),
    )
    resolves_last = F.col("resolves") > F.coalesce("occurs", F.lit(0))
    turned = F.when(resolves_last, _RESOLVES).when(F.col("occurs").isNotNull(), _OCCURS)
    linked = heads.withColumn("turned", turned).withColumn(
        "turned_in", F.last("turned", ignorenulls=True).over(before)
    )
    # a block of a run that an earlier block began does not begin one
    begins = (F.col("turned") == _OCCURS) & (
        F.col("resolves").isNotNull() | ~F.col("turned_in").eqNullSafe(F.lit(_OCCURS))
    )
    run = F.when(begins, F.struct("block", "run"))
    acks = F.when(F.col("acks").isNotNull(), F.struct("block", "acks"))
    return linked.select(
        "alert_id",
        "block",
        F.when(F.max("occurs").over(before).isNull(), NONE)
        .when(F.col("turned_in") == _RESOLVES, RESOLVED)
        .when(
            F.last(acks, ignorenulls=True).over(before) > F.last(run, ignorenulls=True).over(before),
            ACKNOWLEDGED,
        )
        .otherwise(NEW)
        .alias("entry"),
    )


def _state_before() -> Column:
    """State before a step, from the entry of its block and the steps before it there."""
    entry, run, acks = F.col("entry"), F.col("run"), F.col("acks")
    fresh = F.col("resolves").isNotNull() | entry.isin(NONE, RESOLVED)
    kept = F.when((entry == NEW) & acks.isNotNull(), ACKNOWLEDGED).otherwise(entry)
    return (
        F.when(F.col("turned").isNull(), kept)
        .when(
            F.col("turned") == _RESOLVES,
            F.when((entry == NONE) & run.isNull(), NONE).otherwise(RESOLVED),
        )
        .when(fresh, F.when(acks > run, ACKNOWLEDGED).otherwise(NEW))
        .otherwise(kept)
    )


def lifecycle_timeline(
    occurrences: DataFrame, actions: DataFrame, *, block_seconds: int = 900
) -> DataFrame:
    """Ordered steps per alert with the effect of each one.

    ``occurrences``: alert_id, occurrence_key, last_seen. ``actions``: alert_id,
    action_key, action (acknowledged / resolved), at, actor, note. At equal times
    occurrences come before actions, then keys decide.

    Result: alert_id, step_key, at, kind, effect, actor, note. ``effect`` is created,
    occurrence, reopened, acknowledged, resolved or rejected. An ``occurrence`` row can
    stand for several; created and reopened rows carry the key of the one that did it.

    The state before a step follows from the last resolve or occurrence before it, from the
    first occurrence of its run (occurrences without a resolve between them) and from the last
    acknowledge. The steps of an alert are cut into blocks of ``block_seconds``; each block finds
    these places on its own, and only its summary, one row a block, is put in order to find the
    state each block is entered in. Every pass is linear in the steps. Steps without an alert or
    a time have no row.
    """
    second = F.date_trunc("second", F.col("at"))
    steps = occurrences.select(
        "alert_id", F.col("occurrence_key").alias("step_key"), F.col("last_seen").alias("at")
    ).withColumn("cell", second)
    acts = actions.select(
        "alert_id",
        F.col("action_key").alias("step_key"),
        "at",
        "action",
        "actor",
        "note",
    ).withColumn("cell", second)
    contested = acts.select("alert_id", "cell").distinct().withColumn("contested", F.lit(True))
    # occurrences of one instant precede its actions, so the first of them stands for all
    reduced = (
        # seconds first: ids begin alike, so a sort by them compares whole texts
        steps.join(contested, ["cell", "alert_id"], "left")
        .groupBy("cell", "alert_id", F.when(F.col("contested"), F.col("at")).alias("instant"))
        .agg(F.min(F.struct("at", "step_key")).alias("opening"))
        .select(
            "alert_id",
            F.col("opening.step_key").alias("step_key"),
            F.col("opening.at").alias("at"),
            F.lit(None).cast("string").alias("action"),
            F.lit(None).cast("string").alias("actor"),
            F.lit(None).cast("string").alias("note"),
        )
    )
    code = (
        F.when(F.col("action").isNull(), F.lit(_OCCURS))
        .when(F.col("action") == ACKNOWLEDGE, F.lit(_ACKS))
        .when(F.col("action") == RESOLVE, F.lit(_RESOLVES))
        .otherwise(F.lit(_OTHER))
    )
    known = acts.drop("cell").withColumn("action", F.coalesce("action", F.lit("")))
    # never null, so that the join below puts no filter on one of its sides only and both read
    # the same shuffled steps
    block = F.coalesce(time_block(F.col("at"), block_seconds), F.lit(-(2**63)))
    merged = reduced.unionByName(known).withColumns({"code": code, "block": block})
    inside = Window.partitionBy("alert_id", "block").orderBy(
        "at", F.col("code") > 0, "step_key", "code", "action", "actor", "note"
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("code").isin(_OCCURS, _RESOLVES), F.col("code"))
    placed = merged.withColumns(
        {
            "place": F.row_number().over(inside),
            "turned": F.last(turn, ignorenulls=True).over(before),
        }
    ).withColumn(
        "opens",
        F.when(
            (F.col("code") == _OCCURS) & ~F.col("turned").eqNullSafe(F.lit(_OCCURS)), F.col("place")
        ),
    )
    walked = (
        placed.withColumns(
            {
                "run": F.max("opens").over(before),
                "resolves": F.max(_place_of(_RESOLVES)).over(before),
                "acks": F.max(_place_of(_ACKS)).over(before),
            }
        )
        .join(_entered(placed), ["alert_id", "block"])
        .where(F.col("at").isNotNull())
        .withColumn("before", _state_before())
    )
    before, code, action = F.col("before"), F.col("code"), F.col("action")
    occurrence_effect = (
        F.when(before == NONE, "created").when(before == RESOLVED, "reopened").otherwise("occurrence")
    )
    accepted = ((code == _RESOLVES) & before.isin(NEW, ACKNOWLEDGED)) | (
        (code == _ACKS) & (before == NEW)
    )
    return walked.select(
        "alert_id",
        "step_key",
        "at",
        F.when(code == _OCCURS, "occurrence").otherwise(F.nullif(action, F.lit(""))).alias("kind"),
        F.when(code == _OCCURS, occurrence_effect)
        .when(accepted, action)
        .otherwise("rejected")
        .alias("effect"),
        "actor",
        "note",
    )


def lifecycle_states(occurrences: DataFrame, timeline: DataFrame) -> DataFrame:
    """Final alert rows: deduplicated occurrences plus the last accepted change."""
    changes = timeline.where(F.col("effect").isin("reopened", ACKNOWLEDGE, RESOLVE))
    reopened = F.col("effect") == "reopened"
    last = changes.groupBy("alert_id").agg(
        F.max(
            F.struct(
                F.col("at"),
                # at equal times an occurrence precedes the actions
                (~reopened).alias("is_action"),
                F.col("step_key"),
                F.col("effect"),
                F.when(reopened, F.lit(REOPEN_ACTOR)).otherwise(F.col("actor")).alias("actor"),
                F.when(reopened, F.lit(REOPEN_NOTE)).otherwise(F.col("note")).alias("note"),
            )
        ).alias("last")
    )
    effect = F.col("last.effect")
    return (
        collapse_occurrences(occurrences)
        .join(last, "alert_id", "left")
        .withColumns(
            {
                "status": F.when(effect.isNull() | (effect == "reopened"), F.lit("new")).otherwise(
                    effect
                ),
                "updated_by": F.col("last.actor"),
                "status_note": F.col("last.note"),
                "status_updated_at": F.col("last.at"),
                "last_action": effect,
            }
        )
        .transform(with_extra)
        .select(*ALERT_COLUMNS)
    )


def lifecycle_events(occurrences: DataFrame, timeline: DataFrame) -> DataFrame:
    """One event row per occurrence and per accepted action, none for rejected ones."""
    special = timeline.where(F.col("effect").isin("created", "reopened")).select(
        "alert_id", F.col("step_key").alias("occurrence_key"), "effect"
    )
    from_rows = (
        occurrences.join(special, ["alert_id", "occurrence_key"], "left")
        .select(
            "alert_id",
            F.col("occurrence_key").alias("step_key"),
            F.coalesce("effect", F.lit("occurrence")).alias("event_type"),
            F.col("last_seen").alias("timestamp"),
            "batch_id",
        )
        .withColumn(
            "actor", F.when(F.col("event_type") == "reopened", F.lit(REOPEN_ACTOR))
        )
        .withColumn("note", F.when(F.col("event_type") == "reopened", F.lit(REOPEN_NOTE)))
    )
    from_actions = timeline.where(
        (F.col("kind") != "occurrence") & (F.col("effect") != "rejected")
    ).select(
        "alert_id",
        "step_key",
        F.col("effect").alias("event_type"),
        F.col("at").alias("timestamp"),
        F.lit(None).cast("string").alias("batch_id"),
        "actor",
        "note",
    )
    return from_rows.unionByName(from_actions)


def rejected_actions(timeline: DataFrame) -> DataFrame:
    return timeline.where(F.col("effect") == "rejected")


def update_statuses(state: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a set of analyst actions to the stored state.

    ``actions``: alert_id, action_key, action, at, actor, note. Returns the changed state
    rows and a verdict for every action: ``accepted`` or the reason it was refused.

    Per alert only the first acknowledge and the first resolve can succeed, and the
    acknowledge only on a new alert and before that resolve, so two minimums decide.
    """
    order = F.struct("at", "action_key")
    known = ("new", ACKNOWLEDGE, RESOLVE)
    valid = actions.where(F.col("action").isin(*known) & (strip(F.col("actor")) != ""))
    firsts = (
        valid.groupBy("alert_id")
        .agg(
            F.min(F.when(F.col("action") == RESOLVE, order)).alias("resolve"),
            F.min(F.when(F.col("action") == ACKNOWLEDGE, order)).alias("ack"),
        )
        .join(state.select("alert_id", "status"), "alert_id")
    )
    open_alert = F.col("status") != RESOLVE
    ack_wins = (
        (F.col("status") == "new")
        & F.col("ack").isNotNull()
        & (F.col("resolve").isNull() | (F.col("ack") < F.col("resolve")))
    )
    winners = firsts.select(
        "alert_id",
        "status",
        F.when(open_alert, F.col("resolve")).alias("resolve"),
        F.when(open_alert & ack_wins, F.col("ack")).alias("ack"),
    )
    wins = (
        winners.select(
            "alert_id", F.explode(F.array_compact(F.array("ack", "resolve"))).alias("win")
        )
        .select("alert_id", F.col("win.action_key").alias("action_key"))
        .withColumn("wins", F.lit(True))
    )
    judged = actions.join(wins, ["alert_id", "action_key"], "left").join(
        winners.select(
            "alert_id", F.col("status").alias("status_before"), "resolve"
        ),
        "alert_id",
        "left",
    )
    after_resolve = (F.col("status_before") == RESOLVE) | (order > F.col("resolve"))
    verdict = (
        F.when(F.col("wins"), "accepted")
        .when(strip(F.coalesce("actor", F.lit(""))) == "", "actor cannot be empty")
        .when(F.col("action") == "new", "alerts reopen through detection only")
        .when(~F.col("action").isin(*known), "unknown status")
        .when(F.col("status_before").isNull(), "alert not found")
        .when(after_resolve, "a resolved alert cannot be modified until it is reopened")
        .otherwise("alert is already acknowledged")
    )
    verdicts = judged.withColumn("verdict", verdict).drop("wins", "resolve", "status_before")
    last = (
        verdicts.where(F.col("verdict") == "accepted")
        .groupBy("alert_id")
        .agg(F.max(F.struct("at", "action_key", "action", "actor", "note")).alias("last"))
    )
    changed = (
        state.join(last, "alert_id")
        .withColumns(
            {
                "status": F.col("last.action"),
                "updated_by": strip(F.col("last.actor")),
                "status_note": strip(F.col("last.note")),
                "status_updated_at": F.col("last.at"),
                "last_action": F.col("last.action"),
            }
        )
        .transform(with_extra)
        .select(*ALERT_COLUMNS)
    )
    return changed, verdicts


_LOG_PAYLOAD = (
    "fingerprint",
    "severity",
    "risk_score",
    "database",
    "username",
    "client_ip",
    "classification",
    "source_system",
    "query",
    "batch_id",
    "generated_at",
)
_LOG_HISTORY = ("updated_by", "status_note", "status_updated_at", "last_action")


def replay_log(occurrences: DataFrame, updates: DataFrame) -> DataFrame:
    """Current alert states from an append-only log (see ``sources.alert_log``).

    Records apply in line order. The first occurrence sets the status, only updates
    change it afterwards; updates before the first occurrence are dropped. A field keeps
    its last written value whichever kind of record wrote it, and an empty note does not
    overwrite an earlier one. Keys that the schema does not name stay in ``extra``, each with
    the last value that an alert record gave it.
    """
    update = F.col("_update")
    line = F.struct("file", "line_no")

    def newest(value: Column, of_update: bool) -> Column:
        rows = value.isNotNull() & (update == F.lit(of_update))
        return F.max(F.when(rows, F.struct(line.alias("line"), value.alias("v"))))

    def written(key: str, value: Column) -> Column:
        rows = update & F.array_contains("_fields", key)
        return F.max(F.when(rows, F.struct(line.alias("line"), value.alias("v"))))

    noted = updates.select(
        "file",
        "line_no",
        "alert_id",
        F.lit(True).alias("_update"),
        F.col("fields").alias("_fields"),
        *[F.col(c).alias(f"_{c}") for c in ("status", "actor", "note", "timestamp", "action")],
    )
    rows = occurrences.withColumn("_update", F.lit(False)).unionByName(
        noted, allowMissingColumns=True
    )
    # of every field only the newest update matters; it counts if it stands behind the opening
    last = rows.groupBy("alert_id").agg(
        F.min(F.when(~update, F.struct(line.alias("line"), F.col("status")))).alias("opening"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *[newest(F.col(name), False).alias(name) for name in (*_LOG_PAYLOAD, *_LOG_HISTORY)],
        written("status", F.col("_status")).alias("new_status"),
        written("actor", F.col("_actor")).alias("new_updated_by"),
        newest(F.col("_note"), True).alias("new_status_note"),
        written("timestamp", F.col("_timestamp")).alias("new_status_updated_at"),
        written("action", F.col("_action")).alias("new_last_action"),
    )

    def counts(new: Column) -> Column:
        return new.isNotNull() & (new["line"] > F.col("opening.line"))

    def later(name: str) -> Column:
        old, new = F.col(name), F.col(f"new_{name}")
        takes_new = counts(new) & (old.isNull() | (new["line"] > old["line"]))
        return F.when(takes_new, new["v"]).otherwise(old["v"]).alias(name)

    states = last.where(F.col("opening").isNotNull()).select(
        "alert_id",
        F.col("fingerprint.v").alias("fingerprint"),
        F.coalesce(
            F.when(counts(F.col("new_status")), F.col("new_status.v")), "opening.status"
        ).alias("status"),
        "occurrence_count",
        "first_seen",
        "last_seen",
        *[F.col(f"{name}.v").alias(name) for name in _LOG_PAYLOAD if name != "fingerprint"],
        *[later(name) for name in _LOG_HISTORY],
    )
    others = newest_extra(with_extra(occurrences), "alert_id", ("file", "line_no"))
    return states.join(others, "alert_id", "left")

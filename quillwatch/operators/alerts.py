"""From detections to deduplicated alerts, and merging a batch into the alert state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.text import (
    casefold,
    collapse_spaces,
    fold_key,
    is_ascii,
    json_object,
    json_string,
    optional_text,
    strip,
)
from quillwatch.functions.times import iso_text
from quillwatch.operators.extra import merged_extra, newest_extra, spliced, with_extra
from quillwatch.operators.once import computed_once
from quillwatch.schemas import ALERT_COLUMNS, DETECTION_COLUMNS, FINGERPRINT_FIELDS

REOPEN_NOTE = "A new matching database event reopened the resolved alert."
REOPEN_ACTOR = "system"

# Columns of an occurrence that the newest one decides.
PAYLOAD = (
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


def fingerprint(**columns: Column) -> Column:
    """SHA-256 over the canonical JSON of the six identity fields.

    Columns default to those of the same name. Null counts as empty, ends are stripped,
    case is folded, and whitespace inside the statement is collapsed.
    """
    fields = {}
    for name in FINGERPRINT_FIELDS:
        value = F.coalesce(columns.get(name, F.col(name)).cast("string"), F.lit(""))
        normal = casefold(collapse_spaces(value)) if name == "query" else fold_key(value)
        fields[name] = json_string(normal)
    return F.coalesce(F.sha2(json_object(fields), 256), F.lit(""))


#: Stands between the fields of an identity while they are tested; no field is changed by it.
_BETWEEN = "\x7f"


def with_fingerprint(records: DataFrame, out: str = "fingerprint") -> DataFrame:
    """The same as :func:`fingerprint` for a whole frame, one projection per step.

    Each step reads plain columns of the step before, and the hash itself is computed
    once however it is filtered or joined on later. Fields of printable ASCII without quotes,
    backslashes, outer blanks and double blanks only have to be lower-cased; one test over all
    of them tells such rows, and only the others go through the steps.
    """
    names = {f: f"_print_{f}" for f in FINGERPRINT_FIELDS}
    values = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in names}
    between = F.lit(_BETWEEN)
    joined = F.concat(between, *[part for v in values.values() for part in (v, between)])
    text = F.col("_print_joined")
    plain = (
        is_ascii(text)
        & ~F.contains(text, F.lit("  "))
        & ~F.contains(text, F.lit(f" {_BETWEEN}"))
        & ~F.contains(text, F.lit(f"{_BETWEEN} "))
        & ~text.rlike(r'[\x00-\x1f"\\]')
    )
    tested = records.withColumn("_print_joined", joined).withColumn("_print_plain", plain)
    odd = ~F.col("_print_plain")
    texts = {
        temp: F.when(odd, (collapse_spaces if f == "query" else strip)(values[f]))
        for f, temp in names.items()
    }
    folded = {temp: casefold(F.col(temp)) for temp in names.values()}
    quoted = {temp: json_string(F.col(temp)) for temp in names.values()}
    staged = tested.withColumns(texts).withColumns(folded).withColumns(quoted)
    simple = json_object({f: F.concat(F.lit('"'), v, F.lit('"')) for f, v in values.items()})
    canonical = json_object({f: F.col(temp) for f, temp in names.items()})
    normal = F.when(odd, canonical).otherwise(F.lower(simple))
    hashed = F.coalesce(F.sha2(normal, 256), F.lit(""))
    return computed_once(staged, **{out: hashed}).drop(
        *names.values(), "_print_joined", "_print_plain"
    )


def alert_id_of(print_of: Column) -> Column:
    return F.concat(F.lit("alrt_"), F.substring(print_of, 1, 24))


def flat_records(analyzed: DataFrame) -> DataFrame:
    """The nine export columns, time as ISO text."""
    return analyzed.withColumn("timestamp", iso_text(F.col("timestamp"))).select(
        *DETECTION_COLUMNS
    )


def enrich_detections(
    detections: DataFrame,
    *,
    batch_id: str | Column,
    generated_at: str | Column,
    status: str = "new",
) -> DataFrame:
    """One occurrence per detection with identity and lifecycle columns.

    ``occurrence_key`` identifies the occurrence: the event id where there is one,
    otherwise it is derived from identity, time and batch.
    """
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    made = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    made = made.cast("timestamp")
    seen = F.coalesce(F.col("timestamp"), made)
    key = (
        F.col("event_id")
        if "event_id" in detections.columns
        else F.sha2(F.concat_ws("|", F.col("fingerprint"), seen.cast("string"), batch), 256)
    )
    return (
        with_fingerprint(detections)
        .withColumns(
            {
                "alert_id": alert_id_of(F.col("fingerprint")),
                "occurrence_key": key,
                "batch_id": batch,
                "generated_at": made,
                "status": F.lit(status),
                "occurrence_count": F.lit(1).cast("bigint"),
                "first_seen": seen,
                "last_seen": seen,
            }
        )
        .select(
            "occurrence_key",
            "alert_id",
            "status",
            "occurrence_count",
            "first_seen",
            "last_seen",
            *PAYLOAD,
        )
    )


def collapse_occurrences(occurrences: DataFrame) -> DataFrame:
    """One row per alert: summed count, first and last time, newest payload.

    Every aggregate has a partial form, so a fingerprint that makes up a large part of
    the batch is reduced before the shuffle.
    """
    newest = F.max(F.struct("last_seen", "occurrence_key", *PAYLOAD))
    rows = (
        occurrences.groupBy("alert_id")
        .agg(
            F.sum("occurrence_count").alias("occurrence_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min(F.struct("first_seen", "occurrence_key")).alias("opening"),
            newest.alias("newest"),
        )
        .select(
            "alert_id",
            "occurrence_count",
            "first_seen",
            "last_seen",
            F.col("opening.occurrence_key").alias("opening_key"),
            *[F.col(f"newest.{name}").alias(name) for name in PAYLOAD],
        )
    )
    if "extra" not in occurrences.columns:
        return rows
    others = newest_extra(occurrences, "alert_id", ("last_seen", "occurrence_key"))
    return rows.join(others, "alert_id", "left")


def merge_batch(state: DataFrame, occurrences: DataFrame, *, generated_at: str) -> DataFrame:
    """New state rows of the alerts a batch touches, with ``event_type`` and ``opening_key``.

    ``event_type`` is what the first occurrence of the batch does to the alert: created,
    reopened or occurrence. The old rows are cut down to the touched alerts first, so a
    small batch never shuffles a large state.
    """
    batch = with_extra(collapse_occurrences(occurrences))
    old = restrict_to_batch(with_extra(state), occurrences).select(
        "alert_id",
        *[
            F.col(name).alias(f"old_{name}")
            for name in (
                "status",
                "occurrence_count",
                "first_seen",
                "last_seen",
                "updated_by",
                "status_note",
                "status_updated_at",
                "last_action",
                "extra",
            )
        ],
    )
    joined = batch.join(old, "alert_id", "left")
    known = F.col("old_status").isNotNull()
    reopened = known & (F.col("old_status") == "resolved")
    made = F.lit(generated_at).cast("timestamp")

    def history(name: str, on_reopen: Column) -> Column:
        return F.when(reopened, on_reopen).otherwise(F.col(f"old_{name}")).alias(name)

    return joined.select(
        "alert_id",
        "fingerprint",
        F.when(reopened | ~known, F.lit("new")).otherwise(F.col("old_status")).alias("status"),
        (F.col("occurrence_count") + F.coalesce("old_occurrence_count", F.lit(0))).alias(
            "occurrence_count"
        ),
        F.least("first_seen", "old_first_seen").alias("first_seen"),
        F.greatest("last_seen", "old_last_seen").alias("last_seen"),
        *PAYLOAD[1:],
        history("updated_by", F.lit(REOPEN_ACTOR)),
        history("status_note", F.lit(REOPEN_NOTE)),
        history("status_updated_at", made),
        history("last_action", F.lit("reopened")),
        merged_extra(F.col("old_extra"), F.col("extra")).alias("extra"),
        F.when(~known, "created")
        .when(reopened, "reopened")
        .otherwise("occurrence")
        .alias("event_type"),
        "opening_key",
    )


def upsert(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Whole current state: changed rows win over old rows with the same alert id."""
    kept = state.join(changed.select("alert_id"), "alert_id", "left_anti")
    return (
        with_extra(kept)
        .select(*ALERT_COLUMNS)
        .unionByName(with_extra(changed).select(*ALERT_COLUMNS))
    )


def batch_events(occurrences: DataFrame, merged: DataFrame) -> DataFrame:
    """One lifecycle event per occurrence of the batch.

    The opening occurrence of each alert takes the alert's event type, all others are
    plain occurrences. The join is on the occurrence itself, so one busy alert does not
    pile up in one task.
    """
    special = merged.select(
        F.col("alert_id"),
        F.col("opening_key").alias("occurrence_key"),
        F.col("event_type").alias("opening_type"),
    )
    typed = occurrences.join(special, ["alert_id", "occurrence_key"], "left").withColumn(
        "event_type", F.coalesce("opening_type", F.lit("occurrence"))
    )
    reopened = F.col("event_type") == "reopened"
    payload = F.to_json(
        F.struct("alert_id", *PAYLOAD, "first_seen", "last_seen", "occurrence_count", "status")
    )
    return typed.select(
        F.sha2(F.concat_ws("|", "alert_id", "batch_id", "occurrence_key"), 256).alias("event_key"),
        "alert_id",
        "event_type",
        F.col("last_seen").alias("timestamp"),
        optional_text(F.col("batch_id")).alias("batch_id"),
        F.when(reopened, F.lit(REOPEN_ACTOR)).alias("actor"),
        F.when(reopened, F.lit(REOPEN_NOTE)).alias("note"),
        payload.alias("payload_json"),
    )


def restrict_to_batch(states: DataFrame, batch: DataFrame) -> DataFrame:
    """Current alerts that occur in the batch."""
    return states.join(batch.select("alert_id"), "alert_id", "left_semi")


def merge_import(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Existing alerts overwritten, not added to, by imported ones with the same id."""
    return upsert(existing, imported)


def imported_events(imported: DataFrame) -> DataFrame:
    """A ``migrated`` event for every imported alert."""
    return with_extra(imported).select(
        F.sha2(F.concat_ws("|", "alert_id", F.lit("migrated"), "batch_id"), 256).alias("event_key"),
        "alert_id",
        F.lit("migrated").alias("event_type"),
        F.col("last_seen").alias("timestamp"),
        optional_text(F.col("batch_id")).alias("batch_id"),
        F.lit("system").alias("actor"),
        F.lit("Imported from legacy JSONL lifecycle log.").alias("note"),
        spliced(F.to_json(F.struct(*ALERT_COLUMNS[:-1])), F.col("extra")).alias("payload_json"),
    )

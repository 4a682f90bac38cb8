"""Hash-chained audit log: verification in parallel, and appending.

Each record carries its number and the hash of the record before it. Checking a record
needs only its predecessor, so a chain of any length is cut into blocks of lines; the
blocks run in parallel and one summary row per block is put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.hashing import (
    GENESIS_HASH,
    canonical_json,
    inspect_audit_record,
    sha256_hex,
)
from quillwatch.functions.text import strip

BLOCK_LINES = 1_000_000


def audit_records(
    lines: DataFrame, *, chain: str = "file", block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Non-blank lines with kind, hashes, place in the chain and the hash expected before.

    ``lines``: the chain column, line_no, raw.
    """
    seen = _inspected(lines, chain, block_lines)
    blocks = seen.groupBy("chain", "block").agg(
        F.count("*").alias("size"), F.max_by("link_hash", "line_no").alias("last_link")
    )
    ordered = Window.partitionBy("chain").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select(
        "chain",
        "block",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.lag("last_link").over(ordered).alias("link_in"),
        (F.row_number().over(ordered) == 1).alias("is_first"),
    )
    inside = Window.partitionBy("chain", "block").orderBy("line_no")
    local = seen.withColumns(
        {"local_no": F.row_number().over(inside), "local_link": F.lag("link_hash").over(inside)}
    )
    expected = (
        F.when(F.col("local_no") > 1, F.col("local_link"))
        .when(F.col("is_first"), F.lit(GENESIS_HASH))
        .otherwise(F.col("link_in"))
    )
    return local.join(heads, ["chain", "block"]).select(
        "chain",
        "block",
        "line_no",
        (F.col("offset") + F.col("local_no")).alias("position"),
        "kind",
        "sequence",
        "previous_hash",
        "record_hash",
        "own_hash",
        "link_hash",
        expected.alias("expected_previous"),
    )


def audit_failures(records: DataFrame) -> DataFrame:
    """Records with ``failure``: null when the record is in order."""
    chained = F.col("kind") == "chained"
    failure = (
        F.when(F.col("kind").isin("invalid_json", "record_is_not_an_object"), F.col("kind"))
        .when(chained & ~F.col("sequence").eqNullSafe(F.col("position")), "invalid_sequence")
        .when(
            chained & ~F.col("previous_hash").eqNullSafe(F.col("expected_previous")),
            "previous_hash_mismatch",
        )
        .when(chained & (F.col("record_hash") != F.col("own_hash")), "record_hash_mismatch")
    )
    return records.withColumn("failure", failure)


def verify_audit_log(
    lines: DataFrame, *, chain: str = "file", block_lines: int = BLOCK_LINES
) -> DataFrame:
    """One row per chain: valid, records, chained_records, legacy_records, failure_line, message.

    Counts stop at the first failure. ``records`` is then its line number, otherwise the
    number of records.

    Each line is inspected once. A block of lines is reduced to its size, its last link, and
    the first failure that it shows whatever stands before it; what depends on earlier blocks
    stays open: the link of its first line and the number of its first chained record. These
    are closed where the summaries, one row a block, are put in order.
    """
    return _closed_blocks(_block_summaries(_inspected(lines, chain, block_lines)))


def _inspected(lines: DataFrame, chain: str, block_lines: int) -> DataFrame:
    text = strip(F.col("raw"))
    return (
        lines.where(text != "")
        .select(
            F.col(chain).alias("chain"),
            "line_no",
            F.floor(F.col("line_no") / F.lit(block_lines)).cast("bigint").alias("block"),
            inspect_audit_record(text).alias("r"),
        )
        .select("chain", "line_no", "block", "r.*")
    )


def _block_summaries(seen: DataFrame) -> DataFrame:
    """One row per block; failures are (line_no, rank, failure, chained, legacy before them)."""
    inside = Window.partitionBy("chain", "block").orderBy("line_no")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    chained, legacy = F.col("kind") == "chained", F.col("kind") == "legacy"
    local = seen.withColumns(
        {
            "place": F.row_number().over(inside),
            "link_before": F.lag("link_hash").over(inside),
            "chained_before": F.count_if(chained).over(earlier),
            "legacy_before": F.count_if(legacy).over(earlier),
            # the same for all records in order of a block, whatever stands before it
            "shift": F.when(chained, F.col("sequence") - F.row_number().over(inside)),
        }
    )
    whole = Window.partitionBy("chain", "block")
    opening = F.min(F.when(chained, F.struct("line_no", "shift")))
    local = local.withColumn("opening", opening.over(whole))

    def at(rank: int, failure: Column | str) -> Column:
        text = F.lit(failure) if isinstance(failure, str) else failure
        return F.struct(
            "line_no", F.lit(rank).alias("rank"), text.alias("failure"),
            "chained_before", "legacy_before",
        )

    first = F.col("place") == 1
    shown = (
        F.when(~chained & ~legacy, at(0, F.col("kind")))
        .when(
            chained
            & (F.col("shift").isNull() | ~F.col("shift").eqNullSafe(F.col("opening.shift"))),
            at(1, "invalid_sequence"),
        )
        .when(
            chained & ~first & ~F.col("previous_hash").eqNullSafe(F.col("link_before")),
            at(2, "previous_hash_mismatch"),
        )
        .when(chained & (F.col("record_hash") != F.col("own_hash")), at(3, "record_hash_mismatch"))
    )
    return local.groupBy("chain", "block").agg(
        F.count("*").alias("size"),
        F.count_if(chained).alias("chained"),
        F.count_if(legacy).alias("legacy"),
        F.max(F.struct("line_no", "link_hash"))["link_hash"].alias("last_link"),
        F.min(shown).alias("shown"),
        # open: holds if the records before the block number this much
        F.min(F.when(chained, F.struct(at(1, "invalid_sequence").alias("f"), "shift"))).alias("number"),
        # open: holds if this is the link of the record before
        F.min(
            F.when(
                first & chained, F.struct(at(2, "previous_hash_mismatch").alias("f"), "previous_hash")
            )
        ).alias("link"),
    )


def _closed_blocks(blocks: DataFrame) -> DataFrame:
    ordered = Window.partitionBy("chain").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    link_in = F.when(F.row_number().over(ordered) == 1, F.lit(GENESIS_HASH)).otherwise(
        F.lag("last_link").over(ordered)
    )
    placed = blocks.withColumns(
        {
            "records_before": sum_before("size"),
            "link_in": link_in,
            "all_chained": sum_before("chained"),
            "all_legacy": sum_before("legacy"),
        }
    )
    failure = F.least(
        "shown",
        F.when(~F.col("number.shift").eqNullSafe(F.col("records_before")), F.col("number.f")),
        F.when(~F.col("link.previous_hash").eqNullSafe(F.col("link_in")), F.col("link.f")),
    )
    first = F.struct(
        "block", failure.alias("f"), F.col("all_chained").alias("c"), F.col("all_legacy").alias("l")
    )
    summary = placed.groupBy("chain").agg(
        F.min(F.when(failure.isNotNull(), first)).alias("first"),
        F.sum("chained").alias("chained"),
        F.sum("legacy").alias("legacy"),
    )
    broken = F.col("first").isNotNull()
    line = F.col("first.f.line_no")
    return summary.withColumns(
        {
            "chained": F.when(broken, F.col("first.c") + F.col("first.f.chained_before")).otherwise(
                F.col("chained")
            ),
            "legacy": F.when(broken, F.col("first.l") + F.col("first.f.legacy_before")).otherwise(
                F.col("legacy")
            ),
        }
    ).select(
        "chain",
        (~broken).alias("valid"),
        F.when(broken, line).otherwise(F.col("chained") + F.col("legacy")).alias("records"),
        F.col("chained").alias("chained_records"),
        F.col("legacy").alias("legacy_records"),
        line.alias("failure_line"),
        F.coalesce("first.f.failure", F.lit("ok")).alias("message"),
    )


def chain_tails(records: DataFrame) -> DataFrame:
    """Record count and last link hash per chain; a bad line stops the job."""
    checked = records.where(
        F.when(F.col("link_hash").isNotNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("Audit log: "), "kind")).cast("boolean")
        )
    )
    return checked.groupBy("chain").agg(
        F.max("position").alias("sequence"),
        F.max_by("link_hash", "position").alias("link_hash"),
    )


APPENDED = "chain string, sequence bigint, record_hash string, previous_hash string, raw string"


def append_audit_events(
    tails: DataFrame, entries: DataFrame, *, record_type: str = "audit_event"
) -> DataFrame:
    """New lines for every chain, linked to its tail.

    ``entries``: chain, at (timestamp text), order_key, action, status, details (JSON
    object text or null). Chains are independent; within one the hashes follow each other,
    so its entries pass through one task in order while only the last hash is held.
    """
    heads = tails.select(
        "chain",
        F.lit(0).alias("rank"),
        F.lit("").alias("order_key"),
        "sequence",
        F.col("link_hash").alias("link"),
        *[F.lit(None).cast("string").alias(c) for c in ("at", "action", "status", "details")],
    )
    named = entries.withColumns(
        {"action": strip(F.col("action")), "status": strip(F.col("status"))}
    ).where(
        F.when((F.col("action") != "") & (F.col("status") != ""), F.lit(True)).otherwise(
            F.raise_error(F.lit("Audit action and status cannot be empty")).cast("boolean")
        )
    )
    rows = named.select(
        "chain",
        F.lit(1).alias("rank"),
        F.col("order_key").cast("string").alias("order_key"),
        F.lit(None).cast("bigint").alias("sequence"),
        F.lit(None).cast("string").alias("link"),
        "at",
        "action",
        "status",
        "details",
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        chain, sequence, previous = None, 0, GENESIS_HASH
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.chain != chain:
                    chain, sequence, previous = row.chain, 0, GENESIS_HASH
                if row.rank == 0:
                    sequence, previous = int(row.sequence), row.link
                    continue
                sequence += 1
                record = {
                    "type": record_type,
                    "sequence": sequence,
                    "timestamp": row.at,
                    "action": row.action,
                    "status": row.status,
                    "details": json.loads(row.details) if row.details else {},
                    "previous_hash": previous,
                }
                record["record_hash"] = sha256_hex(canonical_json(record))
                raw = json.dumps(record, sort_keys=True, ensure_ascii=False)
                out.append((chain, sequence, record["record_hash"], previous, raw))
                previous = record["record_hash"]
            yield pd.DataFrame(
                out, columns=["chain", "sequence", "record_hash", "previous_hash", "raw"]
            )

    return (
        heads.unionByName(rows)
        .repartition("chain")
        .sortWithinPartitions("chain", "rank", "order_key")
        .mapInPandas(link, APPENDED)
    )

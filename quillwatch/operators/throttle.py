"""Request limits per key over a sliding minute."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.operators.blocks import rolling_count
from quillwatch.session import stored

SPAN_SECONDS = 60
_SPAN = SPAN_SECONDS * 1_000_000


def request_pressure(
    requests: DataFrame, *, limit: int, key: str = "client", ts: str = "ts"
) -> DataFrame:
    """Every request with the number in its last minute and whether that is over the limit.

    Here refused requests count too.
    """
    counted = rolling_count(requests, [key], ts, seconds=SPAN_SECONDS, out="in_last_minute")
    return counted.withColumn("over_limit", F.col("in_last_minute") > limit)


def throttle(
    requests: DataFrame,
    *,
    limit: int,
    key: str = "client",
    ts: str = "ts",
    request_id: str = "request_id",
    block_seconds: int = 3_600,
    rounds: int = 4,
) -> DataFrame:
    """Verdict per request when only accepted requests count: accepted, retry_after.

    A request with at most ``limit`` requests of any kind in its minute is accepted
    whatever happened before, so only the others need history. These are grouped into
    spells with less than a minute between them; a spell depends on nothing but itself
    and the minute before it, so spells are decided independently.

    A spell is cut into blocks of ``block_seconds``. All blocks are decided at once as if nothing
    had been accepted before them. What a block leaves in the window is then compared with what
    the next one was decided with, and only blocks that began with another window are decided
    again, until none is left. A client at its limit without a pause carries its phase from block
    to block: what still changes after ``rounds`` is decided in order, by one task a spell from
    its first open block on. Rows stream through a task; it holds the accepted requests of the
    last minute only.
    """
    if not 1 <= limit <= 100_000:
        raise ValueError("limit must be between 1 and 100000")
    if block_seconds < SPAN_SECONDS:
        raise ValueError("a block cannot be shorter than the limiter's span")
    counted = (
        request_pressure(requests, limit=limit, key=key, ts=ts)
        .withColumn("_at", F.unix_micros(F.col(ts)))
        .withColumn("_cell", F.floor(F.col("_at") / F.lit(_SPAN)).cast("bigint"))
    )
    spells = _spells(counted.where("over_limit"), key)
    # the minute before a spell starts in the cell before its first one at the earliest
    covered = spells.select(
        key,
        "_spell",
        "_from",
        "_to",
        F.explode(F.sequence(F.col("_first_cell") - 1, F.col("_last_cell"))).alias("_cell"),
    )
    inputs = (
        counted.join(covered, [key, "_cell"])
        .where((F.col("_at") > F.col("_from") - _SPAN) & (F.col("_at") <= F.col("_to")))
        .select(
            F.col(key).cast("string").alias("key"),
            F.col("_spell").alias("spell"),
            F.floor(F.col("_at") / F.lit(block_seconds * 1_000_000)).cast("bigint").alias("block"),
            F.col("_at").alias("at"),
            F.col(request_id).alias("request_id"),
            F.col("over_limit").alias("undecided"),
        )
    )
    inputs = stored(inputs, "throttle-inputs")
    decided = _decided(inputs, _settled_groups(inputs, limit, block_seconds, rounds), limit)
    return (
        counted.join(decided.withColumnRenamed("request_id", request_id), request_id, "left")
        .withColumns(
            {
                "accepted": F.coalesce("accepted", F.lit(True)),
                "retry_after": F.col("retry_after"),
            }
        )
        .drop("_at", "_cell")
    )


_GROUP = ["key", "spell", "block"]
#: Time of the row that carries a group's window; before all requests.
_FIRST = -(1 << 62)


def _settled_groups(
    inputs: DataFrame, limit: int, block_seconds: int, rounds: int
) -> DataFrame:
    """Groups of blocks that are decided together, with the window each begins with.

    key, spell, block, first: a block belongs to the group of block ``first``; ``entry`` are the
    times in the window at its start, for the first block of a group only.
    """
    ids = stored(inputs.select(*_GROUP).distinct(), "throttle-blocks")
    none = F.array().cast("array<bigint>")
    if ids.groupBy("key", "spell").count().where("count > 1").isEmpty():
        return ids.select(*_GROUP, F.col("block").alias("first"), none.alias("entry"))
    tail = _tails(inputs, ids.withColumn("entry", none), limit, block_seconds)
    blocks = stored(tail, "throttle-tails")
    order = Window.partitionBy("key", "spell").orderBy("block")
    for turn in range(rounds + 1):
        follows = F.lag("block").over(order) == F.col("block") - 1
        due = F.when(follows, F.lag("tail").over(order))
        judged = stored(blocks.withColumn("due", F.coalesce(due, none)), "throttle-judged")
        stale = judged.where(F.col("due") != F.col("entry"))
        if turn == rounds or stale.isEmpty():
            break
        again = _tails(inputs, stale.select(*_GROUP, F.col("due").alias("entry")), limit, block_seconds)
        kept = judged.where(F.col("due") == F.col("entry")).drop("due")
        blocks = stored(kept.unionByName(again), "throttle-tails")
    opening = F.min(F.when(F.col("due") != F.col("entry"), F.col("block"))).over(
        Window.partitionBy("key", "spell")
    )
    return judged.select(
        *_GROUP, F.least("block", opening).alias("first"), F.col("due").alias("entry")
    )


def _streamed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups in order, the entry window of each group before them.

    No column but the window is null, as pandas would turn whole numbers beside a null to doubles.
    """
    members = rows.join(groups.select(*_GROUP, "first"), _GROUP).withColumn(
        "entry", F.lit(None).cast("array<bigint>")
    )
    heads = groups.where(F.col("block") == F.col("first")).select(
        *_GROUP, F.lit(_FIRST).cast("bigint").alias("at"),
        F.lit(0).cast(rows.schema["request_id"].dataType).alias("request_id"),
        F.lit(False).alias("undecided"), "first", "entry",
    )
    return (
        members.unionByName(heads)
        .repartition("key", "spell", "first")
        .sortWithinPartitions("key", "spell", "first", "at", "request_id")
    )


def _tails(inputs: DataFrame, entries: DataFrame, limit: int, block_seconds: int) -> DataFrame:
    """key, spell, block, entry, tail: the window that each block leaves at its end."""
    groups = entries.withColumn("first", F.col("block"))
    width = block_seconds * 1_000_000

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, entry = None, []
        held: deque[int] = deque()

        def left() -> dict:
            end = (current[2] + 1) * width
            return {
                "key": [current[0]], "spell": [current[1]], "block": [current[2]],
                "entry": [entry], "tail": [[t for t in held if t > end - _SPAN]],
            }

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.entry is not None:
                    if current is not None:
                        yield pd.DataFrame(left())
                    current, entry = (row.key, row.spell, row.first), list(row.entry)
                    held = deque(entry)
                    continue
                at = int(row.at)
                while held and held[0] <= at - _SPAN:
                    held.popleft()
                if len(held) < limit:
                    held.append(at)
        if current is not None:
            yield pd.DataFrame(left())

    return _streamed(inputs, groups).mapInPandas(
        follow, "key string, spell bigint, block bigint, entry array<bigint>, tail array<bigint>"
    )


def _decided(inputs: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """request_id, accepted, retry_after of the undecided requests."""
    return _streamed(inputs, groups).mapInPandas(_decider(limit), _decision_schema(inputs))


def _spells(over: DataFrame, key: str) -> DataFrame:
    """Spells of over-limit requests per key, found on one row per key and minute."""
    cells = over.groupBy(key, "_cell").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    ordered = Window.partitionBy(key).orderBy("_cell")
    gap = F.col("_low") - F.lag("_high").over(ordered)
    return (
        cells.withColumn("_opens", F.coalesce((gap >= _SPAN).cast("int"), F.lit(1)))
        .withColumn("_spell", F.sum("_opens").over(ordered))
        .groupBy(key, "_spell")
        .agg(
            F.min("_low").alias("_from"),
            F.max("_high").alias("_to"),
            F.min("_cell").alias("_first_cell"),
            F.max("_cell").alias("_last_cell"),
        )
    )


def _decision_schema(inputs: DataFrame) -> str:
    id_type = inputs.schema["request_id"].dataType.simpleString()
    return f"request_id {id_type}, accepted boolean, retry_after bigint"


def _decider(limit: int):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[int] = deque()
        for batch in batches:
            ids, verdicts, waits = [], [], []
            for row in batch.itertuples(index=False):
                if row.entry is not None:
                    held = deque(row.entry)
                    continue
                at = int(row.at)
                while held and held[0] <= at - _SPAN:
                    held.popleft()
                full = len(held) >= limit
                if row.undecided:
                    ids.append(row.request_id)
                    verdicts.append(not full)
                    waits.append(max(1, (_SPAN - (at - held[0])) // 1_000_000) if full else None)
                if not full:
                    held.append(at)
            yield pd.DataFrame(
                {
                    "request_id": ids,
                    "accepted": verdicts,
                    "retry_after": pd.array(waits, dtype="Int64"),
                }
            )

    return decide

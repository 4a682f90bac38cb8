"""Running and rolling computations that stay parallel inside one large key.

A plain window with ``partitionBy(key)`` puts the whole key into one task. Here a key is
cut into blocks; each block runs on its own and only one summary row per block is put in
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_block(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def rolling_count(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    seconds: int,
    out: str,
    block_seconds: int = 3_600,
) -> DataFrame:
    """Add the number of rows of the key in ``(ts - seconds, ts]``, the row included.

    Every block also receives the last ``seconds`` of the block before it; those copies
    are counted but not returned.
    """
    if block_seconds < seconds:
        raise ValueError("a block cannot be shorter than the rolling span")
    here = time_block(F.col(ts), block_seconds)
    reach = time_block(F.col(ts) + F.make_dt_interval(secs=F.lit(seconds)), block_seconds)
    copies = frame.withColumn("_home", here).withColumn(
        "_block", F.explode(F.sequence(F.col("_home"), reach))
    )
    micros = F.unix_micros(F.col(ts))
    span = (
        Window.partitionBy(*keys, "_block")
        .orderBy(micros)
        .rangeBetween(-(seconds * 1_000_000) + 1, 0)
    )
    return (
        copies.withColumn(out, F.count("*").over(span))
        .where(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )

"""One hash-chained audit record per micro-batch, the same however often an epoch is replayed.

    <root>/number=<epoch>/   the line of that epoch

A record continues the chain of the lines of lower epochs, and its time comes from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.operators.audit_chain import append_audit_events
from quillwatch.plans.changes import number_of_file, set_path, written


def audit_lines(spark: SparkSession, root: str, *, chain: str = "watch") -> DataFrame:
    """Lines of a watch's audit log: chain, line_no (the epoch), raw."""
    numbers = written(spark, root)
    if not numbers:
        return spark.createDataFrame([], "chain string, line_no bigint, raw string")
    return _lines(spark, root, numbers, chain)


def _lines(spark: SparkSession, root: str, numbers: list[int], chain: str) -> DataFrame:
    lines = spark.read.text([set_path(root, n) for n in numbers])
    return lines.select(
        F.lit(chain).alias("chain"), number_of_file().alias("line_no"), F.col("value").alias("raw")
    )


def append_epoch(
    spark: SparkSession, root: str, epoch: int, *, at: str, status: str, details: DataFrame,
    chain: str = "watch", action: str = "alert_batch",
) -> None:
    """Write the record of an epoch; ``details`` is one row, its columns are the details."""
    earlier = [n for n in written(spark, root) if n < epoch]
    none = "chain string, sequence bigint, link_hash string"
    tails = spark.createDataFrame([], none)
    if earlier:
        tails = _lines(spark, root, earlier[-1:], chain).select(
            "chain",
            F.get_json_object("raw", "$.sequence").cast("bigint").alias("sequence"),
            F.get_json_object("raw", "$.record_hash").alias("link_hash"),
        )
    entry = details.select(
        F.lit(chain).alias("chain"),
        F.lit(at).alias("at"),
        F.lit("1").alias("order_key"),
        F.lit(action).alias("action"),
        F.lit(status).alias("status"),
        F.to_json(F.struct(*details.columns), {"ignoreNullFields": "false"}).alias("details"),
    )
    line = append_audit_events(tails, entry).select("raw")
    line.coalesce(1).write.mode("overwrite").text(set_path(root, epoch))

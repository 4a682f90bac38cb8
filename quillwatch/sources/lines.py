"""Text files as numbered lines, without sorting or a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, raw`` for every line of every file under ``path`` and its folders.

    Rows of one file split are read in order by one task, so a line number is the number
    of lines in earlier splits plus the position inside the split. Only the per-split
    counts are shuffled; they are as many as the file has splits.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("value").alias("raw"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
        )
        .withColumn("position", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("file", "split_start").agg(
        F.min("position").alias("first_position"), F.count("*").alias("lines")
    )
    before = Window.partitionBy("file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "file",
        "split_start",
        (
            F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1 - F.col("first_position")
        ).alias("shift"),
    )
    return lines.join(offsets, ["file", "split_start"]).select(
        "file", (F.col("position") + F.col("shift")).alias("line_no"), "raw"
    )

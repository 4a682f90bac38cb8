"""Numbered change sets of a keyed table, read in one scan however many there are.

    <root>/<part>/number=0000000007/     rows that one batch wrote
    <root>/<part>-folded/number=.../     all rows up to and with that number

A set counts once Spark has written its ``_SUCCESS``. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = re.compile(r"number=(\d+)$")


def written(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete sets below ``folder``, by one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/number=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = (str(status.getPath().getParent().getName()) for status in found)
    return sorted(int(match[1]) for match in map(_NUMBER.search, names) if match)


def drop_before(spark: SparkSession, folder: str, number: int) -> None:
    """Delete the sets below a number that later ones have taken over."""
    for old in written(spark, folder):
        if old < number:
            path = spark._jvm.org.apache.hadoop.fs.Path(set_path(folder, old))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def set_path(folder: str, number: int) -> str:
    return f"{folder}/number={number:010d}"


def number_of_file() -> Column:
    """Number of the set that a row was read from."""
    return F.regexp_extract("_metadata.file_path", r"number=(\d+)/", 1).cast("bigint")


def read_sets(
    spark: SparkSession, root: str, part: str, schema: str, before: int | None = None
) -> DataFrame:
    """Rows of the newest folded set and of all change sets after it, with their ``number``.

    With ``before`` only sets of a lower number are read.
    """
    fits = [n for n in written(spark, f"{root}/{part}-folded") if before is None or n < before]
    folded = fits[-1] if fits else -1
    later = [
        n
        for n in written(spark, f"{root}/{part}")
        if n > folded and (before is None or n < before)
    ]
    paths = [set_path(f"{root}/{part}", n) for n in later]
    if folded >= 0:
        paths.append(set_path(f"{root}/{part}-folded", folded))
    if not paths:
        return spark.createDataFrame([], schema).withColumn("number", F.lit(0).cast("bigint"))
    return spark.read.schema(schema).parquet(*paths).withColumn("number", number_of_file())

"""Computing an expensive column exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are not copied into later filters.

    A filter on an ordinary projected column is pushed below the projection with the whole
    expression inlined, so a hash or a set of regexes would run once to filter and again to
    project. Generator output is a boundary for that rule; filters on other columns still
    move down.
    """
    struct = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select("*", F.inline(F.array(struct)))

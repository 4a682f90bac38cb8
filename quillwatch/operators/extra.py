"""Alert keys that the schema does not name: ``extra``, a map from key to JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.text import json_string

EXTRA_TYPE = "map<string,string>"


def with_extra(frame: DataFrame) -> DataFrame:
    """The frame with an ``extra`` column, null where it has none."""
    if "extra" in frame.columns:
        return frame
    return frame.withColumn("extra", F.lit(None).cast(EXTRA_TYPE))


def unknown_keys(document: Column, keys: Column, known: Sequence[str]) -> Column:
    """Keys of a JSON object (a variant) outside ``known``; null without any."""
    names = F.array(*(F.lit(name) for name in known))
    entries = F.transform_values(document.cast("map<string,variant>"), lambda _, x: F.to_json(x))
    others = F.map_filter(entries, lambda key, _: ~F.array_contains(names, key))
    return F.when(F.size(F.array_except(keys, names)) > 0, others)


def merged_extra(old: Column, new: Column) -> Column:
    """Both maps in one; a key of both takes its new value."""
    kept = F.map_filter(old, lambda key, _: ~F.map_contains_key(new, key))
    return F.coalesce(F.map_concat(kept, new), new, old)


def newest_extra(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``key, extra``: of every unknown key the value of the last row that has it.

    Only rows with such keys are moved, and they are reduced by key and name before they meet.
    """
    return (
        rows.select(key, F.struct(*order).alias("_order"), F.explode("extra"))
        .groupBy(key, F.col("key").alias("_name"))
        .agg(F.max_by("value", "_order").alias("_value"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("extra"))
    )


def spliced(text: Column, extra: Column) -> Column:
    """JSON text of an object with the unknown keys behind the known ones."""
    pairs = F.transform(
        F.array_sort(F.map_entries(extra)),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]),
    )
    more = F.concat(
        F.left(text, F.length(text) - 1),
        F.when(text == "{}", "").otherwise(","),
        F.array_join(pairs, ","),
        F.lit("}"),
    )
    return F.when(F.size(extra) > 0, more).otherwise(text)

"""Exact deduplication with a split between heavy and light digests (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import fresh, materialize, small_side

BLANKS = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Every run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalized(text), "UTF-8"), 256)


def heavy_candidates(
    keyed: DataFrame, key: str, counters: int = 1024, winners: int = 256
) -> DataFrame:
    """At most ``winners`` keys; holds every key with more than 3.5 / counters of the rows.

    The summary is the Misra-Gries one of Spark's frequent-item sketch: a bounded table of
    counters, lowered together when it is full. Summaries of tasks are merged in 64 groups
    first, so the last merge reads 64 rows however many tasks there were.
    """
    sketches = keyed.groupBy((F.spark_partition_id() % 64).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate({key}, {counters})").alias("sketch")
    )
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(  # grouped: empty tasks send nothing
        F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch")
    )
    return merged.select(
        F.explode(F.expr(f"approx_top_k_estimate(sketch, {winners})")).alias("entry")
    ).select(F.col("entry.item").alias(key))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of blanks became one space; of
    equal texts the smallest id stays. Digests found frequent by a Misra-Gries summary are
    counted exactly, and their (at most 256) winners are broadcast, so their rows meet no
    shuffle; all other digests are grouped by an ordinary shuffle of (id, digest).

    Null text counts as empty. A null id ranks after every other id; a group of null ids only
    keeps all its rows. Rows repeated with one id and one text are one document: each of them
    counts in group_size and gets the same decision. An empty table gives no rows; further
    columns are ignored.
    """
    keyed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
    )
    rules = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    verified = materialize(
        keyed.join(F.broadcast(heavy_candidates(keyed, "text_sha256")), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(*rules)
        .where("group_size > 1")
    )
    heavy = keyed.join(F.broadcast(verified), "text_sha256")
    light = keyed.join(F.broadcast(verified), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(*rules).where("group_size > 1")
    single = light.join(groups, "text_sha256", "left").select(
        "text_sha256",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id"))
        .otherwise(F.col("keep_id"))
        .alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    return heavy.unionByName(single).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns.

    Null and empty texts are one text, a text of blanks only another. Rows repeated with one id
    and text are one document and stay together, as do all rows of a group of null ids only; an
    empty table gives no rows.
    """
    removed = materialize(
        exact_dedup(docs).where("not kept").select("doc_id", "text_sha256").distinct()
    )
    id_name, key_name = fresh(docs, "removed_id", "removed_key")
    removed = removed.toDF(id_name, key_name)
    return docs.join(
        small_side(removed),
        F.col("doc_id").eqNullSafe(F.col(id_name))
        & (digest(F.col("text")) == F.col(key_name)),
        "left_anti",
    )


ORACLE = r"""
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
      FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                   AS text_sha256 FROM documents)
      WINDOW w AS (PARTITION BY text_sha256))
"""

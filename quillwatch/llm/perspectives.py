"""Chat formatting: every participant of a dialogue once as the assistant (built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block and messages of a part: dialogues with turn numbers below it, of no more
#: messages than it, are rendered whole.
CHUNK = 1024
SYSTEM = "system"
END = "<|end|>\n"


def escaped(content: Column) -> Column:
    """Text without marks of the format: a backslash more between < and | wherever they meet.

    Taking one of the backslashes away again gives the text as it was.
    """
    return F.regexp_replace(content, r"<(\\*)\|", r"<\\$1|")


def user_mark(speaker: str) -> Column:
    """The head of a user's message: the name as JSON, in which < and > are spelled out."""
    name = F.to_json(F.struct(F.col(speaker).alias("speaker")))
    for sign, code in (("<", "\\u003c"), (">", "\\u003e")):
        name = F.replace(name, F.lit(sign), F.lit(code))
    return F.concat(F.lit("<|user name="), name, F.lit("|>\n"))


def perspective_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Render each dialogue from the side of each of its participants.

    Every speaker but the system is a participant. For participant p the messages of p become
    those of the assistant and carry loss; other speakers become users under their own name;
    system messages stay what they are. One row per (conv_id, perspective, block, part):
    n_messages, n_trained, text, and mask_spans, the [start, end) character ranges of ``text``
    that carry loss (content and end mark of the assistant's messages).

    A block holds the turns of one ``chunk``-wide range of turn numbers, and a part at most
    ``chunk`` of its messages, so no row grows with the length of a dialogue; a dialogue within
    these bounds is one row per participant. A longer one is cut, and its parts have no history.
    A conversation that holds a third of all rows is spread over its blocks: its participants are
    dealt to each block, and turns meet them by (conv_id, block).

    Marks of the format that stand in a message are escaped (see ``escaped``), so no text can
    open or end a message.

    Null text is an empty message, a null speaker the participant with the empty name, null
    turns form a block of their own (-1), ordered by speaker and text. Tied turns are ordered by speaker and
    text; repeated rows are repeated messages. A null conv_id is one conversation. A dialogue of
    system messages only has no participant and no row. An empty table
    gives no rows. Further columns are ignored.
    """
    turns = conversations.select(
        F.struct("conv_id").alias("conv"),  # never null, so null ids are one key
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-1).cast("long")))
    people = (
        turns.where(F.col("speaker") != SYSTEM)
        .select("conv", F.col("speaker").alias("perspective"))
        .distinct()
    )
    dealt = turns.select("conv", "block").distinct().join(people, "conv")
    order = Window.partitionBy("conv", "block").orderBy(
        F.col("turn").asc_nulls_last(), "speaker", "content"
    )
    placed = turns.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "part", F.floor(F.col("place") / chunk)
    )
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(user_mark("speaker"))
    )
    key = ["conv", "perspective", "block", "part"]
    seen = placed.join(dealt, ["conv", "block"]).select(
        *key, "place", own.alias("own"), head.alias("head"),
        F.concat(escaped(F.col("content")), F.lit(END)).alias("body"),
    )
    upto = F.sum(F.length("head") + F.length("body")).over(
        Window.partitionBy(*key).orderBy("place")
    )
    rows = (
        seen.withColumn("ends", upto)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("place", "own", "head", "body", "ends"))).alias("m"))
    )
    spans = F.transform(
        F.filter("m", lambda x: x["own"]),
        lambda x: F.struct(
            (x["ends"] - F.length(x["body"])).cast("int").alias("start"),
            x["ends"].cast("int").alias("end"),
        ),
    )
    return rows.select(
        F.col("conv.conv_id").alias("conv_id"),
        "perspective",
        "block",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        F.size(F.filter("m", lambda x: x["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        spans.alias("mask_spans"),
    )


def perspective_digests(conversations: DataFrame) -> DataFrame:
    """``perspective_chats`` with the spans as text, so that any engine can compare the rows."""
    return perspective_chats(conversations).withColumn(
        "mask_spans",
        F.array_join(
            F.transform(
                "mask_spans",
                lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        ),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS content,
         coalesce(CAST(floor(turn / 1024.0) AS BIGINT), -1) AS block FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block
                               ORDER BY turn NULLS LAST, speaker, content) - 1 AS place FROM t),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
seen AS (
  SELECT p.conv_id, q.perspective, p.block, p.place // 1024 AS part, p.place,
         p.speaker = q.perspective AS own,
         CASE WHEN p.speaker = q.perspective THEN '<|assistant|>' || chr(10)
              WHEN p.speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name={"speaker":"' || replace(replace(p.speaker, '<', '\u003c'), '>', '\u003e')
                   || '"}|>' || chr(10) END AS head,
         regexp_replace(p.content, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id),
sized AS (
  SELECT *, sum(length(head) + length(body)) OVER (
              PARTITION BY conv_id, perspective, block, part ORDER BY place) AS upto FROM seen)
SELECT conv_id, perspective, block, part, count(*) AS n_messages,
       count(*) FILTER (WHERE own) AS n_trained,
       string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ','
                ORDER BY place) FILTER (WHERE own), '') AS mask_spans
FROM sized GROUP BY ALL
"""

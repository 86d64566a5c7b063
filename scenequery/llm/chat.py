"""Chat formatting by perspective rotation.

For every participant of a conversation (a role other than ``system``) the dialogue is
rendered with that speaker as the assistant, the others as users by name and the system's
turns as they are; the mask marks the speaker's own words and the closing mark after them.

A dialogue is rendered whole, in one row for each speaker, as long as a row can hold it: up to
``most_chars`` characters, which in UTF-8 stay below the 2 GB that a text can have. A longer one is
cut between turns into parts of about so many; turns get their place in the conversation from a
distributed running sum of lengths, in the order of turn, role and text.
A further part begins with the conversation's first system turn once more, if it has one in an
earlier part: ``n_repeated`` characters. Without these, the parts in order are the whole dialogue.

Defined results: a null text is rendered as empty; a turn with a null role is a user named
``unknown`` in every rendering and no participant; null turn numbers come first; a null
conv_id is a conversation; repeated rows are turns of their own; conversations without a
participant and empty tables give no rows; extra columns are ignored; marks inside a text or a
role are broken up with a space, and line ends in a role become spaces; very long texts are
rendered whole, in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, running_total, saved

OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
#: Characters of a dialogue that are rendered as one, about; a row can't hold many more.
MOST_CHARS = 1 << 27
#: Characters of a turn besides its text and role, about.
_AROUND = 40


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def _head(role: Column, speaker: Column) -> Column:
    name = _plain(F.translate(F.coalesce(role, F.lit("unknown")), "\n\r", "  "))
    who = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotated(conversations: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_repeated, text and mask: (start, length) of the characters to learn."""
    turns = conversations.select("conv_id", "turn", "role", _plain(F.coalesce("text", F.lit(""))).alias("body"))
    turns = turns.withColumn("size", (F.length("body") + F.coalesce(F.length("role"), F.lit(0)) + _AROUND).cast("long"))
    placed = running_total(turns, ["conv_id"], ["turn", "role", "body"], "size", "pos", "turns")
    placed = saved(placed.select("conv_id", "role", "body", "pos", F.expr(f"pos div {most_chars}").alias("part")), "placed")
    speakers = placed.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    # the first system turn once more, for every part after its own
    first = placed.where(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("_conv")).agg(F.min(F.struct("pos", "part", "body")).alias("s"))
    there = placed.select("conv_id", "part").distinct()
    again = there.join(first, there["conv_id"].eqNullSafe(first["_conv"])).where("s.part < part").select("conv_id", F.lit(SYSTEM).alias("role"), "s.body", F.lit(-1).cast("long").alias("pos"), "part")
    rows = placed.unionByName(again)
    seen = rows.join(speakers, rows["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")
    mine = F.col("role").eqNullSafe(F.col("speaker"))
    seen = seen.select("conv_id", "speaker", "part", "pos", _head(F.col("role"), F.col("speaker")).alias("head"), "body", mine.alias("mine"))
    size = (F.length("head") + F.length("body") + len(CLOSE) + 1).cast("long")
    before = Window.partitionBy("conv_id", "speaker", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turn = F.struct("pos", F.concat("head", "body", F.lit(CLOSE), F.lit("\n")).alias("text"))
    own = F.when(F.col("mine"), F.struct((F.col("start") + F.length("head")).alias("start"), (F.length("body") + len(CLOSE)).cast("long").alias("length")))
    parts = seen.groupBy("conv_id", "speaker", "part").agg(
        F.count_if(F.col("pos") >= 0).alias("n_turns"),
        F.coalesce(F.sum(F.when(F.col("pos") < 0, size)), F.lit(0)).cast("long").alias("n_repeated"),
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]), "").alias("text"),
        F.array_sort(F.collect_list(own)).alias("mask"),
    )
    return parts


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    return rotated(read_table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def oracle_sql(most_chars: int = MOST_CHARS) -> str:
    plain = "replace(replace({}, '" + OPEN + "', '<| im_start|>'), '" + CLOSE + "', '<| im_end|>')"
    name = plain.format("translate(coalesce(role, 'unknown'), chr(10) || chr(13), '  ')")
    return f"""
WITH bodies AS (SELECT conv_id, turn, role, {plain.format("coalesce(text, '')")} AS body FROM conversations),
ordered AS (
  SELECT *, CAST(coalesce(sum(length(body) + coalesce(length(role), 0) + {_AROUND}) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM bodies),
placed AS (SELECT conv_id, role, body, pos, pos // {most_chars} AS part FROM ordered),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
firsts AS (SELECT conv_id, arg_min(body, pos) AS body, arg_min(part, pos) AS part FROM placed WHERE role = '{SYSTEM}' GROUP BY conv_id),
all_rows AS (SELECT conv_id, role, body, pos, part FROM placed UNION ALL SELECT p.conv_id, '{SYSTEM}', f.body, -1, p.part FROM (SELECT DISTINCT conv_id, part FROM placed) p JOIN firsts f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.part < p.part),
seen AS (
  SELECT p.conv_id, speaker, part, pos, body, coalesce(role = speaker, false) AS mine,
    '{OPEN}' || CASE WHEN role = '{SYSTEM}' THEN '{SYSTEM}' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || {name} END || chr(10) AS head
  FROM all_rows p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
spans AS (
  SELECT *, length(head) + length(body) + {len(CLOSE) + 1} AS size, coalesce(sum(length(head) + length(body) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM seen)
SELECT conv_id, speaker, part, count(*) FILTER (pos >= 0) AS n_turns, CAST(coalesce(sum(size) FILTER (pos < 0), 0) AS BIGINT) AS n_repeated,
  string_agg(head || body || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || (length(body) + {len(CLOSE)}), ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM spans GROUP BY conv_id, speaker, part"""

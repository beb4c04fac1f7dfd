"""Multi-party chat formatting: the dialogue from each participant's side.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, system turns as they are and everyone else as a named user; the mask holds the
stretches (code points, end exclusive) of the assistant's texts with their closing sign.

No text or name can forge a sign: in both, ``<|`` and ``|>`` get a backslash between their two
characters, and one more for each that is already there, so that what was written can be had
back and no sign but the renderer's own is left.

Offsets need no rendering per speaker: a turn starts where the turns before it end if all
were rendered as users, moved by the header's difference for each earlier turn of its own
speaker. So both running sums are taken once per turn.

Edge cases: turns are ordered by turn, role and text, nulls first; a null role is the
speaker ``unknown``, a null text is empty; repeated turns stay; a conversation without
participants (only system turns) gives no row; a turn whose ``conv_id`` is null belongs to no
known conversation and is one of its own, whatever share of the table such turns are; an empty
table gives an empty result; other columns are ignored. A result row holds a whole dialogue,
so a task needs memory for its longest conversation, very long texts included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
OWN_HEADER, SYSTEM_HEADER, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    """The text with each sign's two characters kept apart."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def rotate(turns: DataFrame) -> DataFrame:
    """``(conv_id, speaker, n_turns, n_own, rendered, mask, masked_chars)`` of ``turns(conv_id, turn, role, text)``."""
    role, text = F.coalesce("role", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", escaped(role).alias("role"), escaped(text).alias("text"))
    is_system = F.col("role") == SYSTEM
    header = F.when(is_system, F.lit(SYSTEM_HEADER)).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    rows = rows.select("*", F.length(header).alias("head"), F.concat(header, "text", F.lit(END)).alias("other"))
    known, lone = rows.where("conv_id IS NOT NULL"), rows.where("conv_id IS NULL")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    talk = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    speaker = Window.partitionBy("conv_id", "role").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    known = known.withColumn("place", place).withColumn("before", F.coalesce(F.sum(F.length("other")).over(talk), F.lit(0).cast("long")))
    known = _turns(known.withColumn("earlier", F.count("*").over(speaker)))
    lone = _turns(lone.withColumn("place", F.lit(1)).withColumn("before", F.lit(0).cast("long")).withColumn("earlier", F.lit(0).cast("long")))
    whole = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return _views(whole.unionByName(lone.select("conv_id", F.array("t").alias("ts"))))


def _turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, t)``: each turn with its place and where its text lies if its speaker is the assistant."""
    start = F.col("before") + F.col("earlier") * (F.lit(len(OWN_HEADER)) - F.col("head")) + len(OWN_HEADER)
    return rows.select(
        "conv_id",
        F.struct("place", "role", "other", "text", start.alias("start"), (start + F.length("text") + len(END)).alias("stop")).alias("t"),
    )


def _views(whole: DataFrame) -> DataFrame:
    """A row for each participant of each conversation ``(conv_id, ts)``."""
    speakers = F.sort_array(F.array_distinct(F.filter(F.transform("ts", lambda t: t["role"]), lambda r: r != SYSTEM)))
    whole = whole.select("conv_id", "ts", F.explode(speakers).alias("speaker"))
    own = F.filter("ts", lambda t: t["role"] == F.col("speaker"))
    piece = F.transform("ts", lambda t: F.when(t["role"] == F.col("speaker"), F.concat(F.lit(OWN_HEADER), t["text"], F.lit(END))).otherwise(t["other"]))
    masked = F.aggregate(own, F.lit(0).cast("long"), lambda n, t: n + t["stop"] - t["start"])
    return whole.select(
        "conv_id",
        "speaker",
        F.size("ts").cast("long").alias("n_turns"),
        F.size(own).cast("long").alias("n_own"),
        F.array_join(piece, "").alias("rendered"),
        F.array_join(F.transform(own, lambda t: F.concat_ws(":", t["start"], t["stop"])), ",").alias("mask"),
        masked.alias("masked_chars"),
    )


ORACLE_SQL = r"""
WITH raw AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
esc AS (
    SELECT conv_id, lone, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS role,
           regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS text
    FROM raw),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text) AS place FROM esc),
v AS (SELECT DISTINCT conv_id, lone, role AS speaker FROM t WHERE role <> 'system'),
p AS (
    SELECT v.conv_id, v.lone, v.speaker, t.place, t.role = v.speaker AS own,
           CASE WHEN t.role = v.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head,
           t.text || '<|end|>' || chr(10) AS body
    FROM v JOIN t ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.lone IS NOT DISTINCT FROM t.lone),
q AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, lone, speaker ORDER BY place) AS stop FROM p)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, string_agg(head || body, '' ORDER BY place) AS rendered,
       string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (WHERE own) AS mask,
       CAST(sum(length(body)) FILTER (WHERE own) AS BIGINT) AS masked_chars
FROM q GROUP BY conv_id, lone, speaker
"""

"""Chat formatting: every participant's view of a multi-party dialogue, as training text with loss masks.

For each conversation and each of its speakers (distinct roles but `system`), the dialogue is rendered once with that
speaker as ``assistant`` and all others as ``user name=<speaker>``; system turns stay system turns.  A turn is
``<|im_start|>HEADER\nTEXT<|im_end|>\n``.  The mask says, run by run in the order of the text, how many code points
carry no loss (0: headers, other speakers) or loss (1: the perspective's own text with its end mark), as ``n:0,n:1``.

Only DataFrame functions: one aggregation by conversation, sorting within the array, and higher-order functions.

Defined cases: turns are ordered by turn number (null first), then role, then text (null as empty); a null role is
the speaker ``unknown``; a null conversation id is a conversation of its own; repeated rows are repeated turns; a
conversation of system turns only has no participants and gives no rows; an empty table gives no rows; extra columns
are ignored.  The marks themselves inside a text are taken apart (``<|im_start|>`` becomes ``<| im_start|>``) so that no text can
forge a turn.

Scale: one shuffle by conversation.  One output row holds a whole dialogue, which is what a training sample is; a row
is rendered per participant, so cost is turns times participants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticore.llm.common import need

START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1|>")


def perspectives(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, n_turns, n_own, text, mask, n_chars, n_loss."""
    need(turns, conversation, turn, role, text)
    said = F.struct(
        F.col(turn).alias("turn"),
        F.regexp_replace(F.coalesce(F.col(role), F.lit("unknown")), r"[\r\n]+", " ").alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    talks = turns.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    speakers = F.array_distinct(F.filter(F.col("turns.role"), lambda r: r != "system"))
    views = talks.withColumn("perspective", F.explode(speakers))
    own = lambda t: t.role == F.col("perspective")
    head = lambda t: F.concat(F.lit(START), F.when(own(t), F.lit("assistant")).when(t.role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), _safe(t.role))), F.lit("\n"))
    body = lambda t: F.concat(_safe(t.text), F.lit(END))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), own(t).alias("own")))
    views = views.select("conv_id", "perspective", parts.alias("parts"))
    # a run is: header, own text with its end mark, and the line end, or a whole turn of somebody else
    mask = F.transform("parts", lambda p: F.when(p.own, F.concat(F.length(p.head).cast("string"), F.lit(":0,"), F.length(p.body).cast("string"), F.lit(":1,1:0"))).otherwise(F.concat((F.length(p.head) + F.length(p.body) + 1).cast("string"), F.lit(":0"))))
    total = lambda parts: F.aggregate(F.transform(parts, lambda p: F.length(p.head) + F.length(p.body) + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    mine = F.filter("parts", lambda p: p.own)
    return views.select(
        "conv_id",
        "perspective",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.size(mine).cast("bigint").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("text"),
        F.array_join(mask, ",").alias("mask"),
        total(F.col("parts")).alias("n_chars"),
        F.aggregate(F.transform(mine, lambda p: F.length(p.body)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_loss"),
    )


def op10_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM conversations),
views AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
parts AS (
  SELECT v.conv_id, v.perspective, s.k, s.role = v.perspective AS own,
    '<|im_start|>' || CASE WHEN s.role = v.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system'
      ELSE 'user name=' || regexp_replace(s.role, '<\|(im_start|im_end)\|>', '<| \1|>', 'g') END || chr(10) AS head,
    regexp_replace(s.text, '<\|(im_start|im_end)\|>', '<| \1|>', 'g') || '<|im_end|>' AS body
  FROM views v JOIN said s ON v.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  string_agg(CASE WHEN own THEN length(head) || ':0,' || length(body) || ':1,1:0' ELSE (length(head) + length(body) + 1) || ':0' END, ',' ORDER BY k) AS mask,
  CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_loss
FROM parts GROUP BY conv_id, perspective
"""

"""Chat formatting: one rendering of a dialogue for every participant (DataFrame functions only).

For each participant of a conversation the dialogue is told with that speaker
as ``assistant`` and all others as named users; system turns stay system. The
result is a row per perspective and turn: the rendered segment and the span in
it that is trained on. A dialogue of any length so never has to fit in one
task; its segments in the order of ``turn`` (ties: ``speaker``, then
``segment``) are the whole rendering.

Participants are found with partial aggregation. A conversation that holds a
third of all rows is dealt over ``SALTS`` parts before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM, NOBODY = "system", "unknown"
SALTS = 64


def _segment(role: Column, name: Column, text: Column) -> tuple[Column, Column]:
    """Header and body of one rendered turn; only users carry a name."""
    named = F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit(""))
    return F.concat(F.lit("<|im_start|>"), role, named, F.lit("\n")), F.concat(text, F.lit("<|im_end|>"))


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
                        text: str = "text") -> DataFrame:
    """Rows ``conv_id, perspective, turn, speaker, role, segment, mask_start, mask_end``.

    ``segment`` is the rendered turn; code points ``mask_start`` up to, without,
    ``mask_end`` of it are trained on: text and end mark of the perspective's
    own turns, else an empty span (0, 0). Defined cases: a null speaker is the
    participant "unknown"; null text is empty; a null conversation is one of
    its own, a null turn stays null; repeated rows each give a segment in each
    perspective. A conversation of system turns only has no participant and so
    no rows. An empty table gives an empty result; further columns are left out.
    """
    who = F.coalesce(F.col(speaker), F.lit(NOBODY))
    said = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), who.alias("speaker"),
                        F.coalesce(F.col(text), F.lit("")).alias("said"))
    said = said.withColumn("salt", F.pmod(F.xxhash64("turn", "speaker", "said"), F.lit(SALTS)))
    people = (said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective"))
              .distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    seen = said.join(people, said["conv_id"].eqNullSafe(people["of"]) & (said["salt"] == people["part"]))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    head, body = _segment(F.col("role"), F.col("speaker"), F.col("said"))
    return (seen.withColumn("role", role)
            .select("conv_id", "perspective", "turn", "speaker", "role", F.concat(head, body).alias("segment"),
                    F.when(own, F.length(head)).otherwise(0).alias("mask_start"),
                    F.when(own, F.length(head) + F.length(body)).otherwise(0).alias("mask_end")))


ORACLE_SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (SELECT s.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
         FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.of),
made AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head, said || '<|im_end|>' AS body FROM seen)
SELECT conv_id, perspective, turn, speaker, role, head || body AS segment,
       CAST(CASE WHEN speaker = perspective THEN length(head) ELSE 0 END AS INTEGER) AS mask_start,
       CAST(CASE WHEN speaker = perspective THEN length(head) + length(body) ELSE 0 END AS INTEGER) AS mask_end
FROM made
"""

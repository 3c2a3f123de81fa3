"""Multi-party dialogues rendered from every participant's side (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import table

#: Fixed values of the rendering: a turn is its header, its text and its end.
HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
SPEAKER, OTHER, INSTRUCTION = "assistant", "user", "system"
#: Turns of a rendering whose lengths are summed together; longer dialogues are summed in parts of so many.
PART = 4096


def participants(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker): who takes part in a dialogue; the instruction's role and null roles do not."""
    return turns.filter(F.col("role").isNotNull() & (F.col("role") != INSTRUCTION)).select("conv_id", F.col("role").alias("speaker")).distinct()


def rendered(role: str, speaker: str, text: str) -> tuple[Column, Column]:
    """The header and the body of one turn as `speaker` sees it: own turns as the assistant's, others as users with a name."""
    name = F.when(F.col(role) == F.col(speaker), F.lit(SPEAKER)).when(F.col(role) == INSTRUCTION, F.lit(INSTRUCTION)).otherwise(
        F.concat(F.lit(f"{OTHER} name="), F.coalesce(F.regexp_replace(F.col(role), r"[|<>\s]", "_"), F.lit("unknown"))))
    return F.concat(F.lit(HEAD), name, F.lit(MIDDLE)), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(END))


def rotate(turns: DataFrame) -> DataFrame:
    """One row for every turn of every rendering: conv_id, speaker, turn, segment, start, mask_start, mask_end.

    turns: conv_id, turn, role, text. Every participant of a dialogue has a rendering, in which the segments follow
    each other by turn (then role and text, if a turn number repeats). start is the segment's first code point in the
    rendering. mask_start and mask_end bound what is trained, the body of the speaker's own turns; elsewhere both are
    null. A null text is empty, a null role an unknown user, a null turn number comes first; a dialogue of
    instructions alone has no rendering, nor have turns without a conv_id, which name no dialogue, nor an empty table. A rendering stays in rows, one a turn: no dialogue,
    however long, has to fit into one row, and places are summed in parts of PART turns.
    """
    base = turns.select("conv_id", "turn", "role", "text")
    head, body = rendered("role", "speaker", "text")
    rows = base.join(participants(base), "conv_id").withColumns({"_head": head, "_body": body})
    rows = rows.withColumn("_size", (F.length("_head") + F.length("_body")).cast("long"))
    rows = rows.withColumn("_part", F.floor(F.coalesce("turn", F.lit(-1)) / PART))
    sums = rows.groupBy("conv_id", "speaker", "_part").agg(F.sum("_size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("conv_id", "speaker").orderBy("_part")) - F.col("_sum")
    rows = rows.join(sums.select("conv_id", "speaker", "_part", ahead.alias("_ahead")), ["conv_id", "speaker", "_part"])
    order = Window.partitionBy("conv_id", "speaker", "_part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_ahead") + F.sum("_size").over(order) - F.col("_size")
    own = F.col("role") == F.col("speaker")
    return rows.select("conv_id", "speaker", "turn", F.concat("_head", "_body").alias("segment"), start.alias("start"),
                       F.when(own, start + F.length("_head")).alias("mask_start"), F.when(own, start + F.col("_size")).alias("mask_end"))


def joined(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker, rendering, masks): each rendering as one text, for dialogues that fit into a row."""
    rows = rotate(turns)
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    masks = F.transform(F.filter("_p", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return rows.groupBy("conv_id", "speaker").agg(parts.alias("_p")).select(
        "conv_id", "speaker", F.array_join(F.col("_p.segment"), "").alias("rendering"), masks.alias("masks"))


def op7(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT c.conv_id, p.speaker, c.turn, c.role, c.text,
    '<|' || CASE WHEN c.role = p.speaker THEN 'assistant' WHEN c.role = 'system' THEN 'system'
      ELSE 'user name=' || coalesce(regexp_replace(c.role, '[|<>\\s]', '_', 'g'), 'unknown') END || '|>' || chr(10) AS head,
    coalesce(c.text, '') || '<|end|>' || chr(10) AS body
  FROM conversations c JOIN p ON c.conv_id = p.conv_id
), s AS (
  SELECT *, CAST(length(head) + length(body) AS BIGINT) AS size FROM r
), o AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM s
)
SELECT conv_id, speaker, turn, head || body AS segment, start,
  CASE WHEN role = speaker THEN start + length(head) END AS mask_start, CASE WHEN role = speaker THEN start + size END AS mask_end
FROM o
"""

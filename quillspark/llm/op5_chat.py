"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering in which their turns are the assistant's, those of the others are
named users', and system turns stay system turns; the mask tells which characters are to be learned: the text and end
mark of the assistant's turns. Participants are the distinct roles of a dialogue other than the system role.

Turns are in the order of turn, role, and a hash of the text. A dialogue is cut into chunks of `chunk_turns` turn
numbers, and a chunk that many rows share is cut further by that order, so a dialogue that holds a third of all rows
is rendered in bounded pieces; a rendering is its chunks' texts joined in order. A text is shuffled once, before it
is rendered for each participant. Mask spans count code points of their chunk.

Defined results: a null text is empty, a null role is the participant `unknown`, null turn numbers come first, null
dialogue keys are one dialogue; equal rows are one turn; a dialogue with system turns only has no rendering. Control
marks within texts and roles are broken by a backslash, and line ends within roles are written as a backslash and a
letter, so neither can open a turn. The output is turns times participants, as the method asks: a dialogue in which
each turn has a speaker of its own grows with the square of its turns. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
CHUNK_TURNS = 256
#: Rows of a chunk; above, it is cut further.
CHUNK_ROWS = 1024


def _unmarked(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def _render(turn: Column, speaker: Column) -> Column:
    """(text, size before the learned part, size of the learned part) of a turn as the speaker's rendering has it."""
    name = F.replace(F.replace(_unmarked(turn["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    head = F.when(turn["role"] == SYSTEM, F.lit("<|im_start|>system\n")).when(turn["role"] == speaker, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), name, F.lit("\n")))
    body = F.concat(turn["text"], F.lit("<|im_end|>"))
    learned = F.when((turn["role"] == speaker) & (turn["role"] != SYSTEM), F.length(body)).otherwise(0)
    return F.struct(F.concat(head, body, F.lit("\n")).alias("text"), F.length(head).alias("lead"), learned.alias("learned"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each dialogue, participant and chunk: conv, speaker, chunk, n_turns, rendering, mask (array of start, end)."""
    safe = _unmarked(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), safe.alias("text")).distinct()
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("block", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(2**62))))
    counts = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    heavy = counts.where(F.col("n") > chunk_rows).select(F.col("conv").alias("hc"), F.col("block").alias("hb"), F.ceil(F.log2(F.col("n") / chunk_rows)).cast("int").alias("bits"))
    # Most tables have no such chunk; the join is left to the adaptive planner, as their number is not bounded.
    cut = rows.join(heavy, rows["conv"].eqNullSafe(heavy["hc"]) & (rows["block"] == heavy["hb"]), "left")
    # Within a heavy chunk, the order of turn, role and hash goes on; equal turns and roles are cut by leading bits of the hash.
    lead = F.expr("shiftrightunsigned(h ^ (-9223372036854775807L - 1), 64 - bits)")
    part = F.when(F.col("bits").isNull(), F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("long").alias("b"))).otherwise(F.struct(F.col("turn").alias("t"), F.col("role").alias("r"), lead.alias("b")))
    pieces = cut.select("conv", F.struct("block", part.alias("part")).alias("place"), "turn", "role", "h", "text")
    chunks = pieces.groupBy("conv", "place").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "h", "text"))).alias("turns"))
    number = Window.partitionBy("conv").orderBy("place")
    numbered = pieces.select("conv", "place").distinct().withColumn("chunk", F.row_number().over(number) - 1)
    chunks = chunks.join(numbered.select(F.col("conv").alias("nc"), F.col("place").alias("np"), "chunk"), chunks["conv"].eqNullSafe(F.col("nc")) & chunks["place"].eqNullSafe(F.col("np"))).drop("nc", "np")
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv").alias("sc"), F.col("role").alias("speaker")).distinct()
    each = chunks.join(speakers, chunks["conv"].eqNullSafe(speakers["sc"])).select("conv", "chunk", "turns", "speaker")
    made = each.withColumn("made", F.transform("turns", lambda t: _render(t, F.col("speaker"))))
    sizes = made.withColumn("sizes", F.transform("made", lambda m: F.length(m["text"])))
    spans = F.filter(
        F.transform("made", lambda m, i: F.struct((F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda s, x: s + x) + m["lead"]).alias("start"), m["learned"].alias("learned"))),
        lambda s: s["learned"] > 0,
    )
    return sizes.select(
        F.col("conv").alias(conv), "speaker", "chunk", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("made", lambda m: m["text"]), "").alias("rendering"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["learned"]).alias("end"))).alias("mask"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("conv_id", "speaker", "chunk", "n_turns", F.length("rendering").cast("long").alias("n_chars"), F.sha2("rendering", 256).alias("rendering_sha256"), spans.alias("mask"), "rendering")


#: For dialogues of up to 256 turn numbers from 0 on, as all tables have; turns there have numbers of their own.
ORACLE = r"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS t FROM conversations
),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
made AS (
  SELECT r.conv_id, speaker, turn, role,
    CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10) WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || replace(replace(replace(role, '<|', '<\|'), chr(10), '\n'), chr(13), '\r') || chr(10) END AS head,
    t || '<|im_end|>' AS body
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, body) - length(body) - 1 AS start FROM made
)
SELECT conv_id, speaker, 0 AS chunk, count(*) AS n_turns, length(string_agg(head || body || chr(10), '' ORDER BY turn, role)) AS n_chars,
  sha256(string_agg(head || body || chr(10), '' ORDER BY turn, role)) AS rendering_sha256,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY start) FILTER (WHERE role = speaker), '') AS mask,
  string_agg(head || body || chr(10), '' ORDER BY turn, role) AS rendering
FROM placed GROUP BY conv_id, speaker
"""

"""Chat formatting: every dialogue rendered once from each participant's side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import running

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
INSTRUCTIONS = ("system",)


def perspective_segments(turns: DataFrame, instructions: tuple[str, ...] = INSTRUCTIONS, block_turns: int = 64) -> DataFrame:
    """One row per dialogue, participant and turn: what the turn renders to and what of it is trained on.

    Every distinct role of a dialogue outside ``instructions`` is a participant. Seen from one of
    them, their own turns are the assistant's, those of the others are a user's with the speaker's
    name, and instruction turns keep their role. ``start`` and ``stop`` are code-point offsets in the
    rendered dialogue (stop exclusive); train_start and train_stop bound the assistant's words with
    their end mark and are null elsewhere. ``place`` counts the turns from 0.

    Turns are ordered by turn, then role, then text, nulls last. Offsets are two-level running
    sums over blocks of turns, so no task needs a whole dialogue; the participants are joined
    per dialogue. Null roles speak as ``unknown``, a null text is empty, turns without a conv_id form one
    dialogue. A dialogue of instructions only gives no row; repeated turns are rendered as often as they stand.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("said"),
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("dialogue"),
    ).withColumn("late", F.col("turn").isNull())
    rows = rows.withColumn("block", F.when(F.col("late"), F.lit(1 << 40)).otherwise(F.floor(F.col("turn") / block_turns)).cast("long"))
    people = rows.where(~F.col("speaker").isin(*instructions)).select("dialogue", F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, "dialogue")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(mine, F.lit(f"{BEGIN}assistant\n")).when(
        F.col("speaker").isin(*instructions), F.concat(F.lit(BEGIN), "speaker", F.lit("\n"))
    ).otherwise(F.concat(F.lit(f"{BEGIN}user name="), "speaker", F.lit("\n")))
    seen = seen.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("said"), F.lit(END)))
    order = ["late", "turn", "speaker", "said"]
    placed = running(seen.withColumn("size", F.length("segment")), ["dialogue", "perspective"], "block", order, {"start": "size", "place": "1"})
    trained = F.when(mine, F.col("start") + F.col("head"))
    stop = F.col("start") + F.col("size")
    return placed.select(
        "conv_id", "perspective", "place", "turn", "speaker", "segment", "start", stop.alias("stop"),
        trained.alias("train_start"), F.when(mine, stop - 1).alias("train_stop"),
    )


def render(segments: DataFrame, window_chars: int = 1 << 20) -> DataFrame:
    """The segments joined to texts: conv_id, perspective, window, text, spans (start, stop in the text).

    A dialogue becomes one text, or several in turn order where it is longer than ``window_chars``; a
    window takes the segments that start in it, so a row is bounded by the window and one segment.
    """
    rows = segments.withColumn("window", F.floor(F.col("start") / window_chars))
    packed = rows.groupBy("conv_id", "perspective", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "segment", "train_start", "train_stop"))).alias("parts"), F.min("start").alias("base")
    )
    spans = F.transform(
        F.filter("parts", lambda p: p["train_start"].isNotNull()),
        lambda p: F.struct((p["train_start"] - F.col("base")).alias("start"), (p["train_stop"] - F.col("base")).alias("stop")),
    )
    return packed.select("conv_id", "perspective", "window", F.array_join(F.col("parts.segment"), "").alias("text"), spans.alias("spans"))

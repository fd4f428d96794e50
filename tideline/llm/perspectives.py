"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a dialogue the dialogue is rendered with that speaker
as the assistant and all others as named users; the mask marks what the
assistant says, with its closing marker.  Narrators (by default ``system``)
are rendered as themselves and get no perspective of their own.

A dialogue is rendered in blocks of consecutive turns, and a block in parts of
at most ``part_rows`` rows, so no value ever holds a dialogue of unbounded
length: the parts of a perspective, in the order of (block, part), are the whole
rendering.  A dialogue of up to ``block_turns`` turns, of one row each, is a
single part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 64
PART_ROWS = 1024

#: The template.
ASSISTANT = "<|assistant|>\n"
USER = "<|user name="
NARRATOR = "<|"
OPEN = "|>\n"
END = "<|end|>\n"


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per dialogue, participant, block and part.

    Returns conv_id, perspective, block, part, n_turns, rendered, mask
    (array<struct<start, stop>>, in code points of this block's text) and
    n_masked (code points under the mask).

    Defined cases: turns are ordered by (turn, speaker, text), a null turn last
    in a block of its own; a null text is empty, a null speaker is named
    ``unknown``; rows with a null conv_id form one dialogue; repeated rows are
    repeated turns; "<|" inside a text or a name becomes "<\\|", so that only
    the template makes markers; an empty table gives an empty result.  Other
    columns are not read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    at = turns[turn].cast("long")
    rows = turns.select(
        turns[conv_id].alias("conv_id"),
        at.alias("turn"),
        safe(F.coalesce(turns[speaker].cast("string"), F.lit("unknown"))).alias("speaker"),
        safe(F.coalesce(turns[text].cast("string"), F.lit(""))).alias("body"),
        F.coalesce(F.floor(at / block_turns), F.lit((1 << 63) - 1)).cast("long").alias("block"),
    )
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit((1 << 63) - 1)))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "body"))
    rows = rows.withColumn("part", F.floor((place - 1) / part_rows).cast("long"))
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("turns"))
    people = rows.filter(~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("_conv_id"), F.col("speaker").alias("perspective")).distinct()
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv_id")))
    mine = lambda t: t["speaker"] == F.col("perspective")

    def head(t: Column) -> Column:
        told = F.concat(F.lit(NARRATOR), t["speaker"], F.lit(OPEN))
        user = F.concat(F.lit(USER), t["speaker"], F.lit(OPEN))
        return F.when(mine(t), F.lit(ASSISTANT)).when(t["speaker"].isin(*narrators), told).otherwise(user)

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit(END)).alias("said"), mine(t).alias("mine")))
    seen = seen.select("conv_id", "perspective", "block", "part", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p["head"]) + F.length(p["said"])).cast("long").alias("pos"),
            F.when(p["mine"], F.array_append(acc["spans"], F.struct((acc["pos"] + F.length(p["head"])).cast("long").alias("start"), (acc["pos"] + F.length(p["head"]) + F.length(p["said"])).cast("long").alias("stop")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["said"])), "")
    out = seen.select("conv_id", "perspective", "block", "part", "n_turns", rendered.alias("rendered"), spans.alias("mask"))
    return out.withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]))

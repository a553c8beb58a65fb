"""Chat formatting by perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.operators.ordering import row_number_over

#: Roles that set the scene and never speak.
SYSTEM = "system"
#: Turns of a rendered part; a longer dialogue comes in several, together whole.
PART_TURNS = 256
END = "<|end|>"
UNKNOWN = "unknown"


def _safe(text: Column) -> Column:
    """Markers in a text are broken up, so that only the format makes them."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, system: str = SYSTEM, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, speaker, part, n_turns, text, mask)`` for every participant of every
    conversation in ``turns(conv_id, turn, role, text)``.

    Each participant (a role other than ``system``) is the assistant of one rendering, in which
    all others are users under their names. ``mask`` lists the ``start-end`` offsets, ends
    exclusive and in code points, of what the assistant says with its end marker, comma-joined.

    Turns are ordered by turn, role and text. Places come from numbering all rows over a range
    partitioning, so that a conversation that holds a third of all turns is spread over tasks;
    it meets its speakers by blocks of ``part_turns`` turns and is rendered in parts of ``part_turns`` turns, each with its own offsets, and no task
    holds more than one part at once.

    Rows without a conv_id belong to no dialogue and are left out. A null turn comes first, a
    null text is empty, a null role is the user ``unknown`` whom no rendering puts first. Tied
    and repeated rows are turns of their own. A dialogue without participants, and an empty
    table, give no rows; other columns are not read.
    """
    read = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    numbered = row_number_over(read, ["conv_id", "turn", "role", "text"], "rn")
    block = lambda rn: F.floor(F.col(rn) / part_turns)
    starts = numbered.groupBy("conv_id").agg(F.min("rn").alias("first"), F.max("rn").alias("last"))
    speakers = numbered.filter(F.col("role") != system).select("conv_id", F.col("role").alias("speaker")).distinct()
    # Speakers go to every block of turns, so that turns meet them by block and not by dialogue.
    blocks = speakers.join(starts, "conv_id").select("conv_id", "speaker", "first", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    views = numbered.withColumn("block", block("rn")).join(blocks, ["conv_id", "block"])

    mine = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    named = F.concat(F.lit("<|user name="), _safe(F.coalesce("role", F.lit(UNKNOWN))), F.lit("|>\n"))
    head = F.when(mine, "<|assistant|>\n").when(F.col("role") == system, "<|system|>\n").otherwise(named)
    place = F.col("rn") - F.col("first")
    said = views.select(
        "conv_id",
        "speaker",
        F.floor(place / part_turns).cast("long").alias("part"),
        F.struct(
            place.alias("place"),
            F.concat(head, _safe(F.col("text")), F.lit(f"{END}\n")).alias("segment"),
            F.length(head).alias("head"),
            mine.alias("mine"),
        ).alias("said"),
    )
    parts = said.groupBy("conv_id", "speaker", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def step(state: Column, t: Column) -> Column:
        length = F.length(t["segment"])
        span = F.concat_ws("-", state["at"] + t["head"], state["at"] + length - 1)
        return F.struct((state["at"] + length).alias("at"), F.when(t["mine"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return parts.select(
        "conv_id",
        "speaker",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: t["segment"]), "").alias("text"),
        F.aggregate("said", start, step, lambda state: F.array_join(state["spans"], ",")).alias("mask"),
    )

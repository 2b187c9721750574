"""Multi-party perspective rotation of conversations (operator 4).

For every participant of a conversation the dialogue is rendered with this speaker as the assistant and
all others as users who are named. A turn is one segment

    <|role name=speaker|>\\n text <|end|>\\n        (no name for the assistant and the system)

and only what the assistant says (text and end mark) is to be learned: target_start and target_length are
the place of the mask within the segment. System turns belong to no participant and stay system turns in
every perspective. The dialogue of a perspective is its segments in the order of (turn, place), so no
conversation has to be gathered in one task.

What is said holds no marks of its own: in a text "<|" becomes "< |", and in a speaker's name "|>" becomes
"| >" as well, so no text can forge a turn or a mask.

Nulls and edge cases: a null text is empty; a null or empty role is the speaker "unknown"; rows with a
null conv_id are one conversation; null turns come first; repeated rows are rendered as often as they
occur, and rows of equal turn are told apart by `place`, by speaker and text; a conversation of system
turns alone has no perspective; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"
SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, place, role, segment, target_start, target_length."""
    speaker = F.when(F.coalesce(F.trim("role"), F.lit("")) == "", "unknown").otherwise(F.replace(F.replace(F.trim("role"), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")))
    said = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), speaker.alias("speaker"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("speaker", "text")
    said = said.withColumn("place", F.row_number().over(order))
    people = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    met = said.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    named = F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise("")
    head = F.concat(F.lit("<|"), role, named, F.lit("|>\n"))
    own = role == "assistant"
    return met.select(
        "conv_id", "perspective", "turn", "place", role.alias("role"), F.concat(head, "text", F.lit(END)).alias("segment"),
        F.when(own, F.length(head)).otherwise(0).alias("target_start"), F.when(own, F.length("text") + len(END)).otherwise(0).alias("target_length"),
    )

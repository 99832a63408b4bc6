"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is the assistant once: their turns are
rendered as the assistant's and are the ones to learn from, everybody else's as
turns of users that carry a name.  Turns of instruction roles stay as they are
and nobody takes their place.

One row is one turn in one rendering, in the order ``turn`` says, so however
long a conversation is no task needs to hold it; the rendered dialogue is the
concatenation of ``rendered`` in that order (turns of one number by role, then
by what they say), and ``dialogue_offsets`` says where each turn stands in it.

What marks a turn cannot be said in one: ``<|`` inside a text or a name is
rendered as ``<\\|``.

Cases: a turn without ``conv_id`` or ``role`` belongs to no rendering; null
text renders as empty text; repeated turns are rendered as often as they stand
there; a conversation of instructions only, like an empty table, gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that give instructions and take no part in the talk.
INSTRUCTION_ROLES = ("system",)


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, instruction_roles: tuple[str, ...] = INSTRUCTION_ROLES) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, learn, n_chars and n_learn for every turn and participant.

    The join is on the conversation alone, between its turns and its distinct
    participants: rows leave it one by one, and where a conversation holds much of
    the table, adaptive execution splits its turns and repeats its participants.
    """
    t = turns.where(F.col("conv_id").isNotNull() & F.col("role").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("said")
    )
    people = t.where(~F.col("speaker").isin(*instruction_roles)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    instructs = F.col("speaker").isin(*instruction_roles)
    own = F.col("speaker") == F.col("perspective")
    role = F.when(instructs, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~instructs & ~own, F.col("speaker"))
    head = F.concat(F.lit("<|"), _plain(F.col("role")), F.coalesce(F.concat(F.lit(" name="), _plain(F.col("name"))), F.lit("")), F.lit("|>\n"))
    out = t.join(people, "conv_id").select("conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), "said", (own & ~instructs).alias("learn"))
    return out.select(
        "conv_id", "perspective", "turn", "role", "name", F.concat(head, _plain(F.col("said")), F.lit("<|end|>\n")).alias("rendered"), "learn",
        F.length("said").cast("bigint").alias("n_chars"), F.when(F.col("learn"), F.length("said")).otherwise(0).cast("bigint").alias("n_learn"),
    )


def dialogue_offsets(rendered: DataFrame) -> DataFrame:
    """``rotate``'s rows with ``start`` and ``stop``, in characters of the whole rendered dialogue: learnt turns are its mask.

    A running sum over sorted rows, so a dialogue is never held in one piece.
    """
    w = Window.partitionBy("conv_id", "perspective").orderBy("turn", "role", "name", "rendered").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("rendered").cast("bigint")).over(w)
    return rendered.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("rendered"))

"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; a mask says which characters are trained on (the
speaker's own words and end marks). Turns are numbered by distributed positions and rendered in
parts of at most ``turns_per_part`` turns, so no conversation is collected whole; the parts of a
perspective, in order, are its dialogue. By its definition the output holds every turn once per
participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import positions

# The marks of the chat template.
END = "<|end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"


def _plain(c: Column) -> Column:
    """No text can look like a mark of the template."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, turns_per_part: int = 256) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, speaker, part, n_turns, dialogue, mask, n_trained.

    ``mask`` is an array of (length, trained) runs over the characters of ``dialogue``.
    Participants are the distinct roles but the system; the system stays the system in every
    perspective. A NULL role speaks as an unnamed user and has no perspective; NULL texts are
    empty; turns come by turn (NULL first), then role, then text; repeated rows are repeated
    turns; a NULL conv_id is a conversation of its own. Other columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        "turn",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    numbered = positions(rows, ["conv", "conv_id"], ["turn", "role", "text"])
    turn = F.struct("pos", "role", _plain(F.col("text")).alias("text"))
    parts = numbered.groupBy("conv", "conv_id", F.floor((F.col("pos") - 1) / turns_per_part).alias("part")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    speakers = rows.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
    rotated = parts.join(speakers, F.col("conv") == F.col("c"))

    def segment(t: Column) -> Column:
        own = t.role.eqNullSafe(F.col("speaker"))
        head = (
            F.when(own, F.lit("<|assistant|>\n"))
            .when(t.role == SYSTEM, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), _plain(F.coalesce(t.role, F.lit(UNNAMED))), F.lit("|>\n")))
        )
        return F.struct(own.alias("own"), head.alias("head"), F.concat(t.text, F.lit(END)).alias("body"))

    rendered = rotated.withColumn("segments", F.transform("turns", segment))
    run = lambda n, trained: F.struct(n.cast("long").alias("length"), trained.alias("trained"))
    mask = F.flatten(
        F.transform(
            "segments",
            lambda s: F.array(run(F.length(s["head"]), F.lit(False)), run(F.length(s["body"]), s["own"])),
        )
    )
    trained = F.aggregate(
        "segments", F.lit(0).cast("long"), lambda n, s: n + F.when(s["own"], F.length(s["body"])).otherwise(F.lit(0))
    )
    return rendered.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("dialogue"),
        mask.alias("mask"),
        trained.alias("n_trained"),
    )

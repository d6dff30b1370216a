"""Plain transcripts made from the ``conversations`` table, with the true states of their lines.

Every conversation is written in one of four styles; in each style a quarter of the turns lack their marker, and
two styles put a blank line between turns.  Choices are hashes of ids, so any table gives the same transcripts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm import transcripts as T

STYLES = (  # marker by role (system, user, assistant), that of any other role by its name, blank line between turns
    (("System: ", "User: ", "Assistant: "), ("", ": "), True),
    (("### Instructions: ", "### Human: ", "### AI: "), ("### ", ": "), False),
    (("[system] ", "[customer] ", "[agent] "), ("[", "] "), True),
    (("System: ", "Q: ", "A: "), ("", ": "), False),
)


def _style(values) -> Column:
    pick = F.pmod(F.xxhash64(F.lit("style"), "conv"), F.lit(len(STYLES)))
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(pick == i, F.lit(v)).otherwise(out)
    return out


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, ord, text, truth (true state of each line, a byte each), fold (0..4 by conversation): a piece per turn.

    A piece is the blank line of its style (but for turn 0), the marker and the turn's text as it is.  Roles other than the three
    known ones go by their own name where a marker can hold it, else without marker; NULL texts are NULL pieces.
    """
    c = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role"), "text")
    known = F.coalesce(F.col("role"), F.lit("user"))
    r = F.when(known == "system", 0).when(known == "user", 1).when(known == "assistant", 2).otherwise(3)
    name = F.when(known.rlike("^[A-Za-z][A-Za-z0-9_-]{0,23}$"), F.concat(_style([s[1][0] for s in STYLES]), known, _style([s[1][1] for s in STYLES])))
    c = c.withColumn("r", r).withColumn("m", F.when(F.col("r") == 0, _style([s[0][0] for s in STYLES]))
                                        .when(F.col("r") == 1, _style([s[0][1] for s in STYLES]))
                                        .when(F.col("r") == 2, _style([s[0][2] for s in STYLES])).otherwise(name))
    bare = (F.pmod(F.xxhash64(F.lit("mark"), "conv", "turn"), F.lit(4)) == 0) | F.col("m").isNull()
    c = c.withColumn("m", F.when(~bare, F.col("m"))).withColumn("gap", _style([s[2] for s in STYLES]) & (F.coalesce("turn", F.lit(0)) != 0))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    state = lambda part: F.char(3 * F.col("r") + part)
    truth = F.concat(F.when(F.col("gap"), F.char(F.lit(T.SEPARATOR))).otherwise(F.lit("")),
                     F.when(F.col("m").isNull(), state(T.FIRST)).otherwise(state(T.MARKED)), F.repeat(state(T.LATER), lines - 1))
    text = F.concat(F.when(F.col("gap"), F.lit("\n")).otherwise(F.lit("")), F.coalesce("m", F.lit("")), "text")
    return c.select(F.col("conv").alias("conv_id"), F.col("turn").alias("ord"), text.alias("text"),
                    F.when(F.col("text").isNotNull(), truth.cast("binary")).alias("truth"), F.pmod(F.xxhash64(F.lit("fold"), "conv"), F.lit(5)).alias("fold"))

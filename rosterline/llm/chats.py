"""Chat formatting after collapsing cumulative snapshots, in DataFrame operations only.

Logs often hold a conversation once per turn, each copy longer than the one before. A turn's digest
chains its role, its text and the digest before it, so equal digests mean equal beginnings. A
conversation whose last digest is an inner digest of another one is a snapshot of it and is dropped by
an anti-join. Digests are made distinct before the join, so a beginning that a third of all
conversations share costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.llm.common import written

TURN = ("<|", "|>\n", "\n")


def turn_digest(before: Column, role: Column, text: Column) -> Column:
    """SHA-256 over the digest before, the role and the text, each with its length; null is not empty."""

    def part(value: Column) -> Column:
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(before, F.lit("|"), part(role), F.lit("|"), part(text)).cast("binary"), 256)


def collapse(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, digests``: the maximal conversations, turns in order.

    ``turns`` needs ``conv_id, turn, role, text``. Turns sort by number (null first), ties by role and
    text; a turn repeated in all four columns counts once. Each row without a ``conv_id`` is a conversation
    of its own, so such rows never gather. Of identical conversations the smallest id stays (null last).
    """
    one = F.struct("turn", "role", "text")
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = turns.select("conv_id", "turn", "role", "text", lone.alias("lone")).groupBy("conv_id", "lone").agg(F.sort_array(F.collect_set(one)).alias("turns")).withColumn(
        "digests",
        F.aggregate(
            "turns", F.array(F.lit("")),
            lambda done, t: F.concat(done, F.array(turn_digest(F.element_at(done, -1), t["role"], t["text"])))))
    chats = written(chats.select("conv_id", "lone", "turns", F.slice("digests", 2, F.size("digests") - 1).alias("digests")))
    last = F.element_at("digests", -1)
    inner = chats.select(F.explode(F.slice("digests", 1, F.size("digests") - 1)).alias("last")).distinct()
    keyed = chats.withColumn("last", last)
    first = keyed.groupBy("last").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "lone")).alias("first"))
    whole = first.join(inner, "last", "left_anti").select(F.col("first.conv_id").alias("_kept"), F.col("first.lone").alias("_lone"))
    same = F.col("conv_id").eqNullSafe(F.col("_kept")) & F.col("lone").eqNullSafe(F.col("_lone"))
    return chats.join(whole, same, "left_semi").drop("lone")


def render(turns: DataFrame, marks: tuple[str, str, str] = TURN) -> DataFrame:
    """Maximal conversations as text: ``conv_id, n_turns, text``.

    Each turn is ``<|role|>``, a line break, its text and a line break. A null role is ``unknown``, a
    null text is empty. An empty table gives an empty result; other columns are ignored.
    """
    open_, middle, end = marks
    said = F.transform("turns", lambda t: F.concat(
        F.lit(open_), F.coalesce(t["role"], F.lit("unknown")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(end)))
    return collapse(turns.select("conv_id", "turn", "role", "text")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("text"))

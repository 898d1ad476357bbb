"""Chat formatting with rotated perspectives: every speaker of a dialogue is the assistant once.

Turns are gathered in parts of ``TURNS`` turn numbers, and a part with more turns than that (repeated numbers, turns without
one) in pieces of ``TURNS`` turns.  So a dialogue of any length is spread over tasks, and nothing gathered is longer than a
piece.  Each piece is rendered once per speaker, as a training example with masks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import running_total
from kinweave.sources.staging import materialize

TURNS = 64


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = TURNS) -> DataFrame:
    """One row per (conversation, speaker, part, piece): conv_id, perspective, part, piece, n_turns, n_own, n_chars, masks, text.

    The part holds the turns ``part * width`` to ``part * width + width - 1`` in order, the piece ``width`` of them at most;
    ``piece`` is 0 where turn numbers are not repeated.  A turn of the perspective's
    speaker is rendered as ``<|assistant|>`` and its text, another's as ``<|user name=SPEAKER|>`` and its text, each
    ended by ``<|end|>`` and a line break.  ``masks`` lists [start, end) in code points of what the speaker says, end
    mark included: where the loss counts.

    Turns without a text are rendered with an empty one.  Turns without a role are spoken by ``unknown``, who is a
    speaker like any other.  Turns without a number come last, in part null and its pieces.  Turns with the same number follow by
    speaker and text; repeated rows are repeated.  Rows without a conversation form one conversation, null.  A speaker
    of the conversation who is silent in a part gets it without masks.  An empty table gives an empty one; names of
    other columns do not matter.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / F.lit(width)).cast("bigint").alias("part"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    speakers = rows.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    # equal rows count together; ranges of the sorted rows are the buckets of the ordinals, so no group is sorted in one place
    every = ["conv_id", "part", "turn", "speaker", "said"]
    same = rows.groupBy(*every).agg(F.count("*").alias("n")).repartitionByRange(*every)
    ranged = materialize(same.withColumn("_range", F.spark_partition_id()).withColumn("_group", F.struct("conv_id", "part")), "turns")
    late = F.coalesce(F.col("turn").cast("bigint"), F.lit(2**63 - 1))
    placed = running_total(ranged.withColumn("_late", late), ["_group"], F.col("_range"), ["_late", "speaker", "said"], F.col("n"), "first")
    last = F.col("first") + F.col("n") - 1
    cut = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(last / width))))
    copies = F.least(last, F.col("piece") * width + width - 1) - F.greatest(F.col("first"), F.col("piece") * width) + 1
    held = cut.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct(F.col("_late").alias("turn"), "speaker", "said", copies.cast("int").alias("copies")))).alias("turns"))
    held = held.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["speaker"].alias("speaker"), t["said"].alias("said")), t["copies"]))))
    both = held.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "part", "piece", "turns", "perspective")
    mine = lambda t: t["speaker"] == F.col("perspective")
    head = lambda t: F.when(mine(t), F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user name="), t["speaker"], F.lit("|>")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit("<|end|>")).alias("body"), mine(t).alias("own")))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("masks")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).cast("bigint").alias("at"),
            F.when(p["own"], F.concat(F.coalesce(a["masks"], F.array().cast("array<struct<start:bigint,end:bigint>>")),
                                      F.array(F.struct((a["at"] + F.length(p["head"])).cast("bigint").alias("start"),
                                                       (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("bigint").alias("end"))))).otherwise(a["masks"]).alias("masks")),
        lambda a: F.coalesce(a["masks"], F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return (both.withColumn("pieces", pieces).select(
        "conv_id", "perspective", "part", "piece", F.size("pieces").cast("bigint").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("bigint").alias("n_own"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n")))).alias("text"), spans.alias("masks"))
        .select("conv_id", "perspective", "part", "piece", "n_turns", "n_own", F.length("text").cast("bigint").alias("n_chars"), "masks", "text"))

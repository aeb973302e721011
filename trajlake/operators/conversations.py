"""Conversations: hashes of messages and prefixes, costs, and compaction of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions import messages


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the hash of the conversation up to that turn (WN5): one shuffle of digests, no text."""
    digests = turns.select("conv_id", "turn", messages.message_digest(F.col("role"), F.col("text")).alias("d"))
    chains = digests.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "d"))).alias("m"))
    hashed = chains.select("conv_id", F.explode(F.arrays_zip(F.col("m.turn").alias("turn"), messages.prefix_digests(F.col("m.d")).alias("prefix_hash"))).alias("x"))
    return hashed.select("conv_id", "x.turn", "x.prefix_hash")


def turn_counts(turns: DataFrame) -> DataFrame:
    """User and assistant turns, and one (AG14)."""
    return turns.groupBy("conv_id").agg((F.count_if(F.col("role").isin("user", "assistant")) + 1).alias("num_turns"))


def compact(turns: DataFrame, *, most: int, target: int) -> DataFrame:
    """The turns that stay once a conversation costs over ``most``, with their new ``position`` (WN6, H4).

    System turns move to the front; the rest is cut in chunks that start at user turns, of which the newest stays, and
    older ones while all fit in ``target``. Turns before the first user turn go. Costs are positive, so running sums
    from the end find where to stop.
    """
    conv = Window.partitionBy("conv_id")
    forward = conv.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    system = F.col("role") == "system"
    rows = turns.withColumn("cost", messages.message_cost(F.col("text")))
    rows = rows.withColumns({
        "all_cost": F.sum("cost").over(conv), "system_cost": F.sum(F.when(system, F.col("cost")).otherwise(0)).over(conv),
        "chunk": F.count_if(F.col("role") == "user").over(forward), "chunks": F.count_if(F.col("role") == "user").over(conv),
    })
    behind = conv.orderBy(F.desc("chunk")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("used", F.sum(F.when(~system, F.col("cost")).otherwise(0)).over(behind))
    whole = (F.col("all_cost") <= most) | (F.col("chunks") == 0) | F.lit(most <= 0 or target <= 0)
    kept = (F.col("chunk") > 0) & ((F.col("chunk") == F.col("chunks")) | (F.col("used") <= F.greatest(F.lit(0), F.lit(target) - F.col("system_cost"))))
    rows = rows.where(whole | system | kept)
    place = conv.orderBy(F.when(~whole & system, 0).otherwise(1), "turn")
    return rows.select("conv_id", "turn", "role", (F.row_number().over(place) - 1).cast("long").alias("position"), "cost")

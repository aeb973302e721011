"""Chat formatting: drop logged conversations that are earlier snapshots of longer ones, then render the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import cut


def _field(c: Column) -> Column:
    """A field with its length, so that joined fields can't be confused; null differs from the empty string."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, a, b): the rolling hash (a, b) of each conversation's first ``pos`` turns.

    A turn's MD5 digest covers its position, role and text; the rolling hash is the running sum of its two halves, so
    one sorted pass gives all prefixes of a conversation of any length.
    """
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).withColumn("pos", F.row_number().over(order))
    digest = F.md5(F.concat_ws("|", F.col("pos").cast("string"), _field(F.col("role")), _field(F.col("text"))))
    half = lambda start: F.conv(F.substring("_d", start, 15), 16, 10).cast("decimal(20,0)")
    placed = placed.withColumn("_d", digest)
    return placed.select("conv_id", "pos", F.count(F.lit(1)).over(conv).alias("n_turns"), F.sum(half(1)).over(so_far).alias("a"), F.sum(half(16)).over(so_far).alias("b"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one starts with; of equal ones the smallest id."""
    prefixes = cut(prefix_hashes(turns))
    whole = prefixes.where(F.col("pos") == F.col("n_turns")).groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.where(F.col("pos") < F.col("n_turns")).select("pos", "a", "b").distinct()
    return whole.join(proper, ["pos", "a", "b"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    ``rendered`` holds the turns in order, each as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a
    line break. Snapshots are found with hashes of a fixed size; only the text of conversations that stay is gathered,
    one conversation at a time.

    Defined results: turns are ordered by turn, role and text, nulls first, so ties have one order; rows logged twice
    are two turns; null roles and texts render as empty but don't equal empty ones; rows without conv_id belong to no
    conversation and are left out; an empty table gives an empty result; other columns are ignored.
    """
    keep = maximal_conversations(turns)
    rows = turns.select("conv_id", "turn", "role", "text").join(keep, "conv_id")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(ordered, line), "").alias("rendered"))

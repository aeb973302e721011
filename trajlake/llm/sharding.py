"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import cut, hex_number

#: A shard's rows are ranked in so many slices, so that no shard has to be sorted by one task.
SLICES = 1024


def _draw(key: Column, shard: int, seed: int) -> Column:
    """A uniform number in (0, 1) for a key and a shard: 48 bits of an MD5 digest, of which each serves two shards."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(str(shard // 2))))
    return (hex_number(digest, 1 + 16 * (shard % 2), 12) + F.lit(0.5)) / F.lit(float(1 << 48))


def _scores(key: Column, weights: Sequence[float], seed: int) -> list[Column]:
    """(score, -index) of each shard of weight above 0; the score is ``-weight / ln(draw)``."""
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scored = [F.struct((F.lit(float(w)) / -F.log(_draw(key, i, seed))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    if not scored:
        raise ValueError("at least one shard needs a weight above 0")
    return scored


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Index of the shard with the highest score; the lowest index wins ties.

    A shard of weight 0 gets nothing. One more shard moves only the keys that it wins, a share of
    ``weight / sum(weights)``; a null key counts as one key of its own.
    """
    return (-F.array_max(F.array(*_scores(key, weights, seed)))["i"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, *, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: key, ``size`` (bytes of text + 16), ``text_crc32``, ``shard``, ``grown_shard``, ``slot``.

    ``shard`` depends on the key and the weights alone; ``grown_shard`` is the shard once another one (of weight 1) is
    added. Slots number a shard's rows from 0 without gaps. The texts are read once and never shuffled; ranks come from
    slices of each shard whose sizes are summed first, so a shard may be far larger than a task.

    Defined results: a null text has size 16 and a null checksum; rows of one key, repeated rows and null keys share a
    shard and get different slots (ties in any order, between rows equal in all columns returned); an empty table gives
    an empty result; other columns of ``docs`` are ignored.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    k = F.col(key)
    base = docs.select(
        k.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.array_max(F.array(*_scores(k, weights, seed))).alias("_best"),
        _scores(k, [*[0.0] * len(weights), 1.0], seed)[0].alias("_new"),
    )
    shard = lambda best: (-best["i"]).cast("int")
    base = base.select("doc_id", "size", "text_crc32", shard(F.col("_best")).alias("shard"), shard(F.greatest("_best", "_new")).alias("grown_shard"))
    slice_key = F.md5(F.concat_ws(":", F.lit("slot"), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
    base = cut(base.withColumn("_slice", hex_number(slice_key, 1, 8) % SLICES))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy("shard", "_slice").count().select("shard", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_slice").orderBy("doc_id", "size", "text_crc32")
    ranked = base.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "_slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")

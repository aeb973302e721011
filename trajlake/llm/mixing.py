"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import cut, hex_number, word_count

#: Votes are whole numbers of this fraction of a seat, so that their sums don't depend on the order.
VOTE = 1 << 20


#: A stream is summed up in so many slices, so that no stream has to be sorted by one task.
SLICES = 256
#: Rows of the streams' plan that are broadcast at most; a larger plan is joined by a shuffle.
MOST_STREAMS = 100_000


def _dealt(shards: int, seed: int) -> dict[str, Column]:
    """_src, _shard and _order of a row: its source's key, its shard, and its place in the shard's order.

    All three come from the row alone. Rows without doc_id are dealt by their text.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return {"_src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "_shard": hex_number(digest, 1, 8) % shards, "_order": hex_number(digest, 9, 15)}


def _sized(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """(doc_id, _size, _src, _shard, _order) of each row, without its text."""
    return cut(docs.select("doc_id", word_count(F.col("text")).alias("_size"), *[c.alias(n) for n, c in _dealt(shards, seed).items()]))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(_src, source_size) with each source's ``target`` words.

    Sources in code-point order (null last) take the weights in turn. ``share`` times all words is spread by weight; a
    source stops at ``cap`` times its words and the rest is spread again, which is the level at which the sources in
    order of cap / weight stop filling up. The windows run over one row per source.
    """
    by_name, all_rows = Window.orderBy(F.col("_src") == "n", "_src"), Window.orderBy("_ratio", "_rank")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumns({"_cap": F.col("source_size") * F.lit(float(cap)), "_total": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filled = F.coalesce(F.sum("_cap").over(all_rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(all_rows.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (F.col("_total") - filled) / left)
    open_level = F.first(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), ignorenulls=True).over(all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("_src", "source_size", F.when(F.col("_ratio") > F.col("_level"), open_level * F.col("_weight")).otherwise(F.col("_cap")).alias("target"))


def quotas(streams: DataFrame, cap: float) -> DataFrame:
    """Sainte-Laguë within each shard: ``_quota`` whole blocks for each of the shard's sources.

    ``streams`` has (_shard, _src, _blocks, _votes), the votes in 1/VOTE of a block. A shard has as many seats as its
    votes add up to; they go to the highest quotients votes / (2 seat - 1). Only seats near a source's own share can
    be decided either way, so only those are ranked: rows stay in proportion to the sources. A source gets at most
    ``cap`` times its blocks.
    """
    shard = Window.partitionBy("_shard")
    s = streams.withColumns({"_all": F.sum("_votes").over(shard), "_sources": F.count(F.lit(1)).over(shard), "_most": F.floor(F.col("_blocks") * float(cap))})
    near = F.ceil(2.0 * F.col("_votes") * (F.col("_sources") + 1) / F.greatest(F.col("_all"), F.lit(1))) + 4
    own = F.floor(F.col("_votes") / VOTE + 0.5)
    s = s.withColumns({"_low": F.least(F.greatest(own - near, F.lit(0)), F.col("_most")), "_high": F.least(own + near, F.col("_most")), "_seats": F.floor(F.col("_all") / VOTE + 0.5)})
    s = s.withColumn("_free", F.col("_seats") - F.sum("_low").over(shard))
    seats = s.where("_high > _low").withColumn("_seat", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    best = Window.partitionBy("_shard").orderBy((F.col("_votes") / (2 * F.col("_seat") - 1)).desc(), "_src", "_seat")
    won = seats.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= F.col("_free")).groupBy("_shard", "_src").agg(F.count(F.lit(1)).alias("_won"))
    return s.join(won, ["_shard", "_src"], "left").select("_shard", "_src", (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("_quota"))


def _streams(rows: DataFrame, weights, share, cap, block, seed) -> DataFrame:
    """(_src, _shard, source_size, target, _rounds, _from, _to, _wrap): what is taken of each stream of words.

    The whole stream ``_rounds`` times, its words from ``_from`` to before ``_to``, and those before ``_wrap``.
    """
    by_stream = cut(rows.groupBy("_src", "_shard").agg(F.sum("_size").alias("_words")))
    goal = targets(by_stream.groupBy("_src").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    streams = by_stream.join(goal, "_src").withColumn("_blocks", F.greatest(F.floor((F.col("_words") + block // 2) / block), F.lit(1)))
    per_word = F.col("target") / F.greatest("source_size", F.lit(1))
    streams = cut(streams.withColumn("_votes", F.when(F.col("_words") > 0, F.floor(per_word * F.col("_blocks") * VOTE)).otherwise(0)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "_src", F.col("_shard").cast("string")))
    plan = streams.join(quotas(streams.select("_shard", "_src", "_blocks", "_votes"), cap), ["_shard", "_src"])
    first, extra = hex_number(digest, 1, 12) % F.col("_blocks"), F.col("_quota") % F.col("_blocks")
    edge = lambda k: F.floor(k * F.col("_words") / F.col("_blocks"))
    return cut(plan.withColumns({"_first": first, "_extra": extra}).select(
        "_src", "_shard", "source_size", "target",
        F.floor(F.col("_quota") / F.col("_blocks")).alias("_rounds"),
        edge(F.col("_first")).alias("_from"),
        edge(F.least(F.col("_first") + F.col("_extra"), F.col("_blocks"))).alias("_to"),
        edge(F.greatest(F.col("_first") + F.col("_extra") - F.col("_blocks"), F.lit(0))).alias("_wrap"),
    ))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their stream's plan, _run and _again (words of the row in the run and in the part before _wrap), taken.

    Rows are summed up in order within slices of a stream, and slices within the stream: no stream is sorted whole.
    """
    rows = rows.withColumn("_slice", F.shiftright("_order", 60 - (SLICES - 1).bit_length()))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = rows.groupBy("_src", "_shard", "_slice").agg(F.sum("_size").alias("_words"))
    slices = slices.select("_src", "_shard", "_slice", before(Window.partitionBy("_src", "_shard").orderBy("_slice"), "_words").alias("_offset"))
    rows = rows.withColumn("_in", before(Window.partitionBy("_src", "_shard", "_slice").orderBy("_order", "doc_id", "_size"), "_size"))
    rows = rows.join(slices.join(plan, ["_src", "_shard"]), ["_src", "_shard", "_slice"]).withColumn("_start", F.col("_offset") + F.col("_in"))
    end = F.col("_start") + F.col("_size")
    return rows.withColumns({
        "_run": F.greatest(F.least(F.col("_to"), end) - F.greatest("_from", "_start"), F.lit(0)), "_again": F.greatest(F.least(F.col("_wrap"), end) - F.col("_start"), F.lit(0)),
    }).withColumn("taken", F.col("_rounds") * F.col("_size") + F.col("_run") + F.col("_again"))


def mix_plan(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 16, shards: int = 256, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken.

    A seeded hash deals documents over ``shards`` and orders them there; in a shard, a source's words form a stream of
    about ``block``-word blocks of equal length. Per shard, Sainte-Laguë turns the targets into whole quotas of blocks.
    A quota beyond all of a source's blocks takes the whole stream again; the rest of it is a run of blocks from a
    seeded start, going round, so that few documents are taken in part. A source in a shard is off its target by
    about half a block, in either direction, and nothing is collected: hot sources are spread over all shards, and a
    shard's stream over ``SLICES`` slices. Texts are read once, to count their words, and never shuffled.

    Defined results: a null text has 0 words; a null source is a source, the last; equal rows are interchangeable; rows
    without doc_id are dealt by their text; an empty table gives an empty result; other columns, whatever their names,
    are ignored.
    """
    rows = _sized(docs, shards, seed)
    return _placed(rows, _streams(rows, weights, share, cap, block, seed)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _intervals(placed: DataFrame) -> DataFrame:
    """(_src, _shard, _lo, _hi, _top): of each stream, the places of the documents that are taken once more.

    Those are the whole documents of its run, from ``_lo`` to ``_hi``, and of the part before _wrap, up to ``_top``. A
    source's documents in part, in the order of their size, have the fractions taken added up; one is taken where the
    sum passes the next half. So at any size those are off the sum by half a document at most, and the source's words by
    half of its largest document in part. A stream has at most three of them, so the windows are small.
    """
    extra = F.col("_run") + F.col("_again")
    rows = placed.select("_src", "_shard", "_order", "_start", "_size", "_run", "_again", extra.alias("_extra")).where("_extra > 0")
    part = rows.where("_extra < _size").withColumn("_votes", F.floor(F.col("_extra") * VOTE / F.col("_size")))
    by_size = Window.partitionBy("_src").orderBy("_size", "_shard", "_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("_sum", F.sum("_votes").over(by_size) + VOTE // 2)
    part = part.where(F.floor(F.col("_sum") / VOTE) > F.floor((F.col("_sum") - F.col("_votes")) / VOTE)).drop("_votes", "_sum")
    taken = rows.where("_extra >= _size").unionByName(part)
    order = lambda words: F.when(F.col(words) > 0, F.col("_order"))
    return taken.groupBy("_src", "_shard").agg(F.min(order("_run")).alias("_lo"), F.max(order("_run")).alias("_hi"), F.max(order("_again")).alias("_top"))


def mix(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 16, shards: int = 256, seed: int = 17) -> DataFrame:
    """The mixed documents themselves, whole, with the columns of ``docs``: a row repeats as often as it is taken.

    The plan is that of ``mix_plan``, made without texts; documents at the ends of a stream's run are taken or left, so
    that the errors even out in each source. What each stream gives is a few numbers, by which every row decides for
    itself: texts are neither sorted nor, while the plan has at most ``MOST_STREAMS`` rows, shuffled.

    Defined results: documents without words are left out; rows of one doc_id, or of none with one text, are taken or
    left together; a null source is a source; an empty table gives an empty result; columns keep their names and order.
    """
    thin = _sized(docs, shards, seed)
    plan = _streams(thin, weights, share, cap, block, seed)
    again = _intervals(_placed(thin, plan))
    plan = cut(plan.select("_src", "_shard", "_rounds").join(again, ["_src", "_shard"], "left"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, (word_count(F.col("text")) > 0).alias("_words"), *[c.alias(n) for n, c in _dealt(shards, seed).items()]).where("_words")
    rows = rows.join(F.broadcast(plan) if plan.count() <= MOST_STREAMS else plan, ["_src", "_shard"])
    more = F.coalesce(F.col("_order").between(F.col("_lo"), F.col("_hi")), F.lit(False)) | F.coalesce(F.col("_order") <= F.col("_top"), F.lit(False))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), (F.col("_rounds") + more.cast("int")).cast("int")))).select("_row.*")

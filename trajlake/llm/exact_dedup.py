"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut, fold_ascii, row_key, without

#: Characters that the prefix hash covers.
PREFIX = 64


def _refined(rows: DataFrame) -> DataFrame:
    """(_len, _prefix) that several rows share: first lengths are counted, then prefix hashes of the shared lengths.

    Rows are counted in partial aggregates before anything is joined, so that a common length or a large group of
    copies is one counted row by then.
    """
    fine = rows.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    lengths = fine.groupBy("_len").agg(F.sum("n").alias("_rows")).where("_rows > 1").select("_len")
    return fine.where("n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix")


def duplicate_groups(docs: DataFrame, *, digest_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): fingerprints of documents, and the groups of at least two equal texts.

    Rows have doc_id, _print (hash of the text as it is), _len (bytes), _prefix and _full. Rows refine step by step:
    only those whose length is shared go on to the prefix hash, and only those whose length and prefix hash are shared
    to the full hash. ``digest_all`` has the first scan add every row's full hash (for callers that return it) and gives
    all rows; otherwise the texts of the rows that survive are read again for it, and only those rows are given.
    """
    text = fold_ascii(F.coalesce("text", F.lit("")))
    fields = ["doc_id", "_print", F.octet_length("_text").cast("long").alias("_len"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_prefix")]
    texts = docs.select("doc_id", F.xxhash64("text").alias("_print"), text.alias("_text"))
    full = F.sha2("_text", 256).alias("_full")
    rows = cut(texts.select(*fields, *[full] * digest_all))
    if not digest_all:
        rows = cut(texts.select(*fields, "_text").join(_refined(rows), ["_len", "_prefix"], "left_semi").select("doc_id", "_print", "_len", "_prefix", full))
    groups = rows.groupBy("_len", "_prefix", "_full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return rows, groups.join(_refined(rows), ["_len", "_prefix"], "left_semi") if digest_all else groups


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the largest doc_id stays. Defined results: a
    null text counts as empty; texts of any length are hashed whole; rows that share the largest doc_id of their group
    are all marked as kept (one document logged twice); a null doc_id stays only if its whole group has none; an empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows, groups = duplicate_groups(docs, digest_all=True)
    # Groups are checkpointed, so that the join reads two plain shuffles and Spark may split a large group's side.
    found = rows.join(cut(groups), ["_len", "_prefix", "_full"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("_full").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one of largest doc_id.

    Rows are told apart by doc_id and text, so a row goes only for its own text. Defined results: null texts are equal
    to empty ones; of rows that share the largest doc_id of their group one stays, as of repeated rows and of rows
    without doc_id; an empty table gives an empty result; columns keep their names and order.
    """
    rows, _ = duplicate_groups(docs)
    group = ["_len", "_prefix", "_full"]
    best = cut(rows.groupBy(*group).agg(F.max(F.struct("doc_id", "_print")).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    stays = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("_print") == F.col("_best._print"))
    # Each row meets its group's one line; nothing is grouped by that key afterwards, so a large group may be split.
    marked = cut(rows.join(best, group).select(row_key(F.col("doc_id")).alias("_id"), "_print", stays.alias("_stays")))
    repeated = marked.where("_stays").groupBy("_id", "_print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return without(docs, marked.where("NOT _stays").select("_id", "_print"), repeated.select("_id", "_print"))

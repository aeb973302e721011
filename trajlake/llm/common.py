"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where a local session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder, so that lineage ends here and survives lost executors."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables under the shared checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, for large tables that columns make much smaller."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hexadecimal digits of ``digest`` from the 1-based ``start``, as a long (15 digits at most)."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def row_key(doc_id: Column) -> Column:
    """``doc_id`` as text, null included: a key that joins can compare."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (_id, _print) is in ``gone``; of those in ``repeated`` one row each.

    _id is ``row_key`` of doc_id and _print the xxhash64 of the text; the two tables hold each key once. Whole rows are
    dealt out once, by a key that differs from row to row; only repeated rows are dealt out again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, row_key(F.col("doc_id")).alias("_id"), F.xxhash64("text").alias("_print"))
    repeated = cut(repeated)
    if repeated.isEmpty():
        return keyed.join(gone, ["_id", "_print"], "left_anti").select("_row.*")
    once = keyed.join(repeated, ["_id", "_print"], "left_semi").groupBy("_id", "_print").agg(F.first("_row").alias("_row"))
    return keyed.join(gone.unionByName(repeated), ["_id", "_print"], "left_anti").unionByName(once.select("_row", "_id", "_print")).select("_row.*")

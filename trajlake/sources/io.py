"""Sources and sinks: task rows, transcripts, chat events, records, trajectory dumps and results."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trajlake.functions.text import local_image

MESSAGES = "array<struct<role:string,content:string,name:string,tool_call_id:string>>"


def read_table(spark: SparkSession, path: str, *, schema: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A Parquet table (IO1, IO2); with ``limit``, the first rows of an order (SL1)."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if limit is None:
        return df
    if not order:
        raise ValueError("a limit needs an order")
    return df.orderBy(*order).limit(limit)


def read_samples(spark: SparkSession, path: str, *, image: str = "image", limit: int = -1, order: list[str] | None = None) -> DataFrame:
    """Task samples as a local runner takes them (IO2): images remapped, ``data_source`` filled in, at most ``limit``.

    ``data_source`` is the reward's name where the column is missing or null, or ``unknown``. A limit of 0 or less is none.
    """
    df = read_table(spark, path, order=order, limit=limit if limit > 0 else None)
    name = F.col("reward_name") if "reward_name" in df.columns else F.lit(None).cast("string")
    own = F.col("data_source") if "data_source" in df.columns else F.lit(None).cast("string")
    return df.withColumns({image: local_image(F.col(image)), "data_source": F.coalesce(own, name, F.lit("unknown"))})


def write_split(df: DataFrame, path: str, split: str) -> None:
    """A dataset's split, for ``read_split`` (IO4): a folder whose files are looked up by their place."""
    df.write.mode("append").parquet(f"{path}/{split}.parquet")


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split of a local dataset (IO3): files or folders ``split.fmt`` and ``split-*.fmt`` of it; none is an error."""
    return spark.read.format(fmt).load(f"{path}/{{{split}.{fmt},{split}-*.{fmt}}}")


def _yaml_as_json(texts: pd.Series) -> pd.Series:
    import yaml

    return texts.map(lambda t: json.dumps(yaml.safe_load(t)))


def read_configs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """(name, config) of JSON or YAML files that hold one mapping or a list (IO5); missing or repeated names fail.

    Files are one row each; YAML needs the yaml module on the executors.
    """
    raw = spark.read.text(path, wholetext=True)
    if fmt == "yaml":
        raw = raw.select(F.pandas_udf(_yaml_as_json, "string")("value").alias("value"))
    raw = raw.select(F.parse_json("value").alias("v"))
    many = F.schema_of_variant("v").startswith("ARRAY")
    each = raw.select(F.explode(F.when(many, F.expr("cast(v as array<variant>)")).otherwise(F.array("v"))).alias("c"))
    named = each.select(F.try_variant_get("c", "$.name", "string").alias("name"), F.to_json("c").alias("config"))
    count = F.count(F.lit(1))
    checked = named.groupBy("name").agg(F.first("config").alias("config"), count.alias("n"))
    return checked.select(F.when(F.col("name").isNull() | (F.col("n") > 1), F.raise_error(F.concat(F.lit("config without a name of its own: "), F.coalesce("name", F.lit("null"))))).otherwise(F.col("name")).alias("name"), "config")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, message) of files with one JSON list each; unreadable files have no rows (IO14).

    Folders are listed by a few tasks for each core, not by a task each.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.text(path, wholetext=True)
    finally:
        spark.conf.set(name, before)
    raw = files.select(F.input_file_name().alias("file"), F.from_json("value", MESSAGES).alias("m"))
    return raw.select("file", F.posexplode("m").alias("ordinal", "message"))


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of text lines for ``streaming.sessions.chat_events`` (IO15)."""
    return spark.readStream.text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Training records by partition (IO6, D12)."""
    records.write.mode("append").partitionBy("partition_id").parquet(path)


def write_by_key(rows: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``rows`` as a table in ``path`` whose files are dealt and sorted by ``key``, for gets that shuffle nothing (IO8).

    Tables of one number of buckets are joined by their key bucket by bucket. The table is registered in the session's
    catalog under a name of its own.
    """
    name = f"keyed_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def write_trajectories(trajectories: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept (IO10)."""
    ordered = trajectories.withColumn("schema_version", F.lit(1)).select(*sorted([*trajectories.columns, "schema_version"]))
    ordered.write.mode("append").option("ignoreNullFields", "false").json(path)


def record_problem(trajectories: DataFrame) -> Column:
    """Why a trajectory can't be dumped, null if it can: arrays that don't match, numbers that JSON can't carry."""
    kinds = dict(trajectories.dtypes)
    found = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"{c} is no finite number")) for c, t in kinds.items() if t in ("double", "float")]
    found += [F.when(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(f"{c} has a number that is not finite")) for c, t in kinds.items() if t in ("array<double>", "array<float>")]
    like = {"response_mask": "response_ids", "response_logprobs": "response_ids", "rm_scores": "response_ids"}
    found += [F.when(F.size(c) != F.size(other), F.lit(f"{c} and {other} differ in length")) for c, other in like.items() if c in kinds and other in kinds]
    found += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("prompt_ids", "response_ids") if c in kinds]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def dump(trajectories: DataFrame, path: str, problem: Column | None = None) -> None:
    """A summary as JSON lines beside the arrays as Parquet; what can't be dumped goes aside, and the job goes on (IO9).

    ``problem`` says why a row can't be dumped (``record_problem`` by default); such rows are in ``failed``, whole, as
    Parquet, with their ``reason``. Rows are checked once, on their way into the table that the others are read from.
    """
    arrays = [c for c, t in trajectories.dtypes if t.startswith("array")]
    reason = record_problem(trajectories) if problem is None else problem
    trajectories.withColumns({"reason_": reason, "ok_": reason.isNull()}).write.mode("append").partitionBy("ok_").parquet(f"{path}/all")
    own = trajectories.sparkSession.read.schema(trajectories.withColumns({"reason_": reason, "ok_": reason.isNull()}).schema).parquet(f"{path}/all")
    own.where("NOT ok_").select(*trajectories.columns, F.col("reason_").alias("failure")).write.mode("append").parquet(f"{path}/failed")
    good = own.where("ok_").select(*trajectories.columns)
    good.select(*[c for c in good.columns if c not in arrays], *[F.size(c).alias(f"{c}_len") for c in arrays]).write.mode("append").json(f"{path}/summary")


def dumped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The dumped trajectories with their arrays."""
    return spark.read.schema(f"{schema}, ok_ boolean").parquet(f"{path}/all").where("ok_").drop("ok_")


def write_snapshots(sessions: DataFrame, path: str) -> None:
    """Session metadata as one JSON document per line, nulls kept (IO11)."""
    sessions.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sessions.columns]), {"ignoreNullFields": "false"})).write.mode("append").text(path)


def write_logs(records: DataFrame, path: str) -> None:
    """Log lines routed by log_id, none dropped (IO13)."""
    records.where(F.col("log_id").isNotNull()).write.mode("append").partitionBy("log_id").text(path)


def route_logs(lines: DataFrame, folder: str, *, most: int, every: str | None = None):
    """A started query that routes log lines (log_id, value) to folders, by way of a bounded buffer per task (IO13).

    A trigger flushes what has come since the last one: each of its tasks takes ``most`` lines and counts the rest, which
    ``observe`` adds up without a shuffle. ``every`` is the time between flushes; without it all that is there is routed
    and the query ends. A trigger that is run again overwrites what it wrote. See ``routed_lines`` and ``overflow``.
    """

    def flush(batch: DataFrame, number: int) -> None:
        own = batch.where("log_id IS NOT NULL").withColumn("_kept", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) < most)
        seen = Observation(f"flush-{number}-{uuid.uuid4().hex}")
        counted = own.observe(seen, F.count_if("_kept").alias("kept"), F.count_if(~F.col("_kept")).alias("dropped"))
        counted.where("_kept").select("log_id", "value").write.mode("overwrite").partitionBy("log_id").text(f"{folder}/lines/batch={number}")
        counts = [(number, seen.get["kept"], seen.get["dropped"])]
        batch.sparkSession.createDataFrame(counts, "batch long, kept long, dropped long").coalesce(1).write.mode("overwrite").json(f"{folder}/counts/batch={number}")

    writer = lines.writeStream.foreachBatch(flush).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def routed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value, log_id) of all lines that were kept."""
    return spark.read.schema("value string, batch long, log_id string").text(f"{folder}/lines").select("value", "log_id")


def overflow(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, kept, dropped) of each flush."""
    return spark.read.schema("kept long, dropped long, batch long").json(f"{folder}/counts")


def score_records(records: DataFrame, uids: DataFrame) -> DataFrame:
    """Successful records of the given uids, pruned to keys and scores (IO8, PF13, JN5).

    Where both are tables of ``write_by_key`` with one number of buckets, their rows are merged as they lie.
    """
    own = records.where("status = 'success'").select("uid", "session", "index", "rm_scores")
    return own.join(uids.select("uid").hint("merge"), "uid", "left_semi")

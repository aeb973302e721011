"""Registered queries of sources, sinks and streams, with their DuckDB SQL.

What a sink writes goes to the folder that executors share and is read again; the SQL says what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import text
from trajlake.operators import serving, trajectories
from trajlake.session import scratch, stored
from trajlake.sources import io
from trajlake.streaming import sessions


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parquet_scan(spark, sf):
    return io.read_table(spark, f"{sf}/orders.parquet", schema="o_orderkey long, o_custkey long").select("o_orderkey", "o_custkey")


def first_rows(spark, sf):
    """The limit is the feature: the first rows in an order."""
    return io.read_table(spark, f"{sf}/orders.parquet", order=["o_custkey", "o_orderkey"], limit=25).select("o_custkey", "o_orderkey")


def sample_read(spark, sf):
    folder = scratch(spark)
    p = _t(spark, sf, "part")
    image = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("reg.example.com/")).otherwise(F.lit("")), F.lit("x/"), "p_brand", F.lit("_1776_1:v2"))
    p.select("p_partkey", image.alias("image"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("reward_name"), F.when(F.col("p_partkey") % 5 == 0, F.lit("own")).alias("data_source")).write.parquet(folder)
    return io.read_samples(spark, folder, limit=0).select("p_partkey", "image", "data_source")


def split_read(spark, sf):
    folder = scratch(spark)
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name")
    io.write_split(s.where("s_suppkey % 2 = 0"), folder, "test")
    io.write_split(s.where("s_suppkey % 2 = 1"), folder, "train")
    return io.read_split(spark, folder, "test").select("s_suppkey", "s_name")


def parquet_sink(spark, sf):
    folder = scratch(spark)
    _t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.parquet(folder)
    return io.read_table(spark, folder)


def config_files(spark, sf):
    """One file with a list of configs, one YAML document; both are read, merged by name and joined to samples."""
    folder = scratch(spark)
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    n.coalesce(1).select(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("level"))).alias("value")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value")).write.text(f"{folder}/json")
    spark.createDataFrame([("name: extra\nlevel: 99\nlist: [1, 2]\n",)], "value string").coalesce(1).write.text(f"{folder}/yaml")
    return io.read_configs(spark, f"{folder}/json").unionByName(io.read_configs(spark, f"{folder}/yaml", "yaml"))


#: Rows of a table that one task takes, so that its share doesn't grow with the table.
ROWS = 250_000


def _parts(table: DataFrame) -> int:
    """So many parts that each has about ``ROWS`` rows of a table."""
    return table.count() // ROWS + 1


def _records(spark, sf):
    """Lines as records, in parts of one size: what a task joins and sorts for a sink is of that size too."""
    lines = _t(spark, sf, "lineitem")
    n = _parts(lines)
    orders = _t(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey").repartition(n, "l_orderkey")
    lines = lines.repartition(n, "l_orderkey").join(orders, "l_orderkey")
    return lines.select(
        F.col("o_custkey").cast("string").alias("uid"), F.col("l_orderkey").cast("string").alias("session"), F.col("l_linenumber").cast("string").alias("index"), F.array(F.lit(0.0), F.col("l_discount").cast("double")).alias("rm_scores"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("status"), F.col("l_linestatus").alias("partition_id"), F.lit("x").alias("unread"),
    )


def queue_records(spark, sf):
    folder = scratch(spark)
    io.write_records(_records(spark, sf), folder)
    return io.read_table(spark, folder).select("uid", "session", "index", "status", "partition_id")


def queue_scores(spark, sf):
    """A get of keys from a table dealt by them: both sides lie in as many buckets, none is shuffled."""
    folder = scratch(spark)
    buckets = max(8, _parts(_t(spark, sf, "lineitem")))
    records = io.write_by_key(_records(spark, sf), f"{folder}/records", "uid", buckets)
    uids = _t(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("uid"))
    found = io.score_records(records, io.write_by_key(uids, f"{folder}/uids", "uid", buckets))
    return found.select("uid", "session", "index", F.col("rm_scores")[1].alias("score"))


def queue_status(spark, sf):
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("success"))
    return serving.queue_status(o)


def _short(spark, sf):
    t = trajectories.conversation_trajectories(_t(spark, sf, "conversations"))
    return t.select("conv_id", "prompt_ids", "response_ids", "response_mask", "num_turns", F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") * 0.5).alias("reward_score"), F.when(F.col("conv_id") % 3 == 0, "max_trajectory_length").alias("reason"))


def _damaged(spark, sf):
    """Trajectories of which one in eleven has a reward that is no number, and one in thirteen a mask that is too short."""
    t = _short(spark, sf)
    return t.withColumns({"reward_score": F.when(F.col("conv_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("reward_score")), "response_mask": F.when(F.col("conv_id") % 13 == 0, F.slice("response_mask", 2, F.size("response_mask"))).otherwise(F.col("response_mask"))})


def trajectory_dump(spark, sf):
    folder = scratch(spark)
    io.dump(_damaged(spark, sf), folder)
    return spark.read.schema("conv_id long, num_turns long, reason string, reward_score double, prompt_ids_len long, response_ids_len long").json(f"{folder}/summary")


def trajectory_dump_failures(spark, sf):
    """What the dump put aside, and why."""
    folder = scratch(spark)
    io.dump(_damaged(spark, sf), folder)
    return spark.read.parquet(f"{folder}/failed").select("conv_id", "failure")


def trajectory_summaries(spark, sf):
    return trajectories.summaries(_short(spark, sf), ["conv_id"])


def trajectory_lines(spark, sf):
    folder = scratch(spark)
    io.write_trajectories(_short(spark, sf).select("reason", "num_turns", "conv_id"), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


def session_snapshots(spark, sf):
    folder = scratch(spark)
    s = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    io.write_snapshots(s, folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


def routed_logs(spark, sf):
    folder = scratch(spark)
    e = _t(spark, sf, "events")
    io.write_logs(e.select(F.when(F.col("user_id") % 7 > 0, F.col("event_type")).alias("log_id"), F.concat(F.col("event_id").cast("string"), F.lit(" "), "props").alias("value")), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"), "log_id")


def routed_logs_stream(spark, sf):
    """The same lines as a stream in three triggers, through buffers that hold them all."""
    folder = scratch(spark)
    e = _t(spark, sf, "events").select(F.when(F.col("user_id") % 7 > 0, F.col("event_type")).alias("log_id"), F.concat(F.col("event_id").cast("string"), F.lit(" "), "props").alias("value"))
    e.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    io.route_logs(stream, folder, most=1 << 32).awaitTermination()
    return io.routed_lines(spark, folder).select(F.col("value").alias("line"), "log_id")


def routed_log_counts(spark, sf):
    """Kept and dropped lines of such a stream whose buffers hold a hundred lines."""
    folder = scratch(spark)
    e = _t(spark, sf, "events").select(F.when(F.col("user_id") % 7 > 0, F.col("event_type")).alias("log_id"), F.col("props").alias("value"))
    e.coalesce(1).write.parquet(f"{folder}/in")
    io.route_logs(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), folder, most=100).awaitTermination()
    n = io.overflow(spark, folder).agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return n.select((F.col("kept") + F.col("dropped")).alias("lines"), (F.col("kept") >= 100).alias("filled"), (F.col("dropped") > 0).alias("overflowed"))


def transcripts(spark, sf):
    """One file per conversation: a JSON list of its messages."""
    folder = scratch(spark)
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    c.select("conv_id", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("value")).repartition("conv_id").write.partitionBy("conv_id").text(folder)
    found = io.read_transcripts(spark, folder)
    return found.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.col("ordinal").cast("long").alias("ordinal"), "message.role", F.sha2("message.content", 256).alias("content_hash"))


def _chat(spark, sf):
    e = _t(spark, sf, "events")
    body = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("chat_id"), F.when(F.col("event_id") % 11 > 0, F.lpad(F.col("event_id").cast("string"), 12, "0")).otherwise("").alias("message_id"), F.when(F.col("event_id") % 5 == 0, "bot").otherwise("u").alias("sender_id"),
        F.when(F.col("event_id") % 7 == 0, "image").otherwise("text").alias("message_type"), F.col("props").alias("content"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("create_time"),
    ))
    return e.select(F.when(F.col("event_id") % 13 == 0, F.lit("{bad")).when(F.col("event_id") % 13 == 1, F.lit("[1]")).when(F.col("event_id") % 13 == 2, F.lit("")).otherwise(body).alias("value"))


def _chat_stream(spark, sf):
    folder = scratch(spark)
    _chat(spark, sf).write.text(f"{folder}/lines")
    return sessions.chat_events(io.chat_lines(spark, f"{folder}/lines"), "bot"), folder


def chat_stream(spark, sf):
    events, folder = _chat_stream(spark, sf)
    return sessions.run_available(events.select("chat_id", "message_id", "content"), folder)


def chat_turns_stream(spark, sf):
    """The lines in three triggers, dealt out so that no trigger's events are behind another's; a heartbeat at the end."""
    folder = scratch(spark)
    n = _parts(_t(spark, sf, "events"))
    lines = stored(_chat(spark, sf).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(3))))
    for i in range(3):
        lines.where(F.col("part") == i).select("value").repartition(n).write.mode("append").text(f"{folder}/lines")
    spark.range(1).select(F.lit('{"heartbeat":"4102444800000"}').alias("value")).coalesce(1).write.mode("append").text(f"{folder}/lines")
    stream = spark.readStream.option("maxFilesPerTrigger", n).text(f"{folder}/lines")
    turns = sessions.chat_turns(sessions.chat_events(stream, "bot", heartbeats=True), "1 day")
    return sessions.run_available(turns, folder).select("chat_id", "ordinal", "message_id")


def running_outcomes_stream(spark, sf):
    folder = scratch(spark)
    _t(spark, sf, "labels").select(F.when(F.col("quality") == 1, "resolved").otherwise("wrong").alias("outcome")).repartition(3).write.parquet(f"{folder}/in")
    stream = sessions.running_outcomes(spark.readStream.schema("outcome string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    return sessions.run_counts(stream, folder, "outcome")


_CHAT_OK = "event_id % 13 > 2 AND event_id % 11 > 0 AND event_id % 5 > 0 AND event_id % 7 > 0"

QUERIES = {
    f.__name__: f
    for f in (
        parquet_scan, first_rows, sample_read, split_read, parquet_sink, config_files, queue_records, queue_scores, queue_status, trajectory_dump, trajectory_dump_failures, trajectory_summaries, trajectory_lines, session_snapshots, routed_logs, routed_logs_stream, routed_log_counts,
        transcripts, chat_stream, chat_turns_stream, running_outcomes_stream,
    )
}


def oracle_sql(trajectory_sql: str) -> dict[str, str]:
    """``trajectory_sql`` has conv_id, prompt_len, response_len, model_tokens and num_turns of each trajectory."""
    shape = f"(SELECT *, CASE WHEN conv_id % 2 = 0 THEN conv_id * 0.5::DOUBLE END AS reward_score, CASE WHEN conv_id % 3 = 0 THEN 'max_trajectory_length' END AS reason FROM ({trajectory_sql}))"
    records = "SELECT CAST(o_custkey AS VARCHAR) AS uid, CAST(l_orderkey AS VARCHAR) AS session, CAST(l_linenumber AS VARCHAR) AS index, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS status, l_linestatus AS partition_id, CAST(l_discount AS DOUBLE) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    return {
        "parquet_scan": "SELECT o_orderkey, o_custkey FROM orders",
        "first_rows": "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 25",
        "sample_read": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x/' END || p_brand || '__1:latest' AS image, CASE WHEN p_partkey % 5 = 0 THEN 'own' WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'unknown' END AS data_source FROM part""",
        "split_read": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0",
        "parquet_sink": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "config_files": """SELECT n_name AS name, '{"level":' || n_nationkey || ',"name":"' || n_name || '"}' AS config FROM nation UNION ALL SELECT 'extra', '{"level":99,"list":[1,2],"name":"extra"}'""",
        "queue_records": f"SELECT uid, session, index, status, partition_id FROM ({records})",
        "queue_scores": f"SELECT uid, session, index, score FROM ({records}) WHERE status = 'success' AND CAST(uid AS BIGINT) % 3 = 0 AND CAST(uid AS BIGINT) IN (SELECT c_custkey FROM customer)",
        "queue_status": "SELECT o_custkey AS uid, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'finished' ELSE 'failure' END AS status FROM orders GROUP BY 1",
        "trajectory_dump": f"SELECT conv_id, num_turns, reason, reward_score, prompt_len AS prompt_ids_len, response_len AS response_ids_len FROM {shape} WHERE conv_id % 11 > 0 AND (conv_id % 13 > 0 OR response_len = 0)",
        "trajectory_dump_failures": f"SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'reward_score is no finite number' ELSE 'response_mask and response_ids differ in length' END AS failure FROM {shape} WHERE conv_id % 11 = 0 OR conv_id % 13 = 0 AND response_len > 0",
        "routed_logs_stream": "SELECT event_id || ' ' || props AS line, event_type AS log_id FROM events WHERE user_id % 7 > 0",
        "routed_log_counts": "SELECT count(*) AS lines, count(*) >= 100 AS filled, count(*) > 100 AS overflowed FROM events WHERE user_id % 7 > 0",
        "trajectory_summaries": f"SELECT conv_id, num_turns, reward_score, reason AS materialization_reason, prompt_len, response_len, model_tokens AS model_token_count FROM {shape}",
        "trajectory_lines": f"""SELECT '{{"conv_id":' || conv_id || ',"num_turns":' || num_turns || ',"reason":' || coalesce('"' || reason || '"', 'null') || ',"schema_version":1}}' AS line FROM {shape}""",
        "session_snapshots": """SELECT '{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus <> 'O' THEN '"' || o_orderstatus || '"' ELSE 'null' END || '}' AS line FROM orders""",
        "routed_logs": "SELECT event_id || ' ' || props AS line, event_type AS log_id FROM events WHERE user_id % 7 > 0",
        "transcripts": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role, sha256(text) AS content_hash FROM conversations",
        "chat_stream": f"SELECT CAST(user_id AS VARCHAR) AS chat_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id, props AS content FROM events WHERE {_CHAT_OK}",
        "chat_turns_stream": f"SELECT CAST(user_id AS VARCHAR) AS chat_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, lpad(CAST(event_id AS VARCHAR), 12, '0') AS message_id FROM events WHERE {_CHAT_OK}",
        "running_outcomes_stream": "SELECT CASE WHEN quality = 1 THEN 'resolved' ELSE 'wrong' END AS outcome, count(*) AS n FROM labels GROUP BY 1",
    }

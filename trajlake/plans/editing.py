"""Registered queries of text edits, task rows by language, batches and token counts, with their DuckDB SQL.

Proxies: ``documents`` are files and instances (source is the repository); ``events`` are an edit log by user, where
errors are undos; ``conversations`` are batches of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import edits
from trajlake.operators import hooks, routing


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numbered_views(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(edits.numbered_view(F.translate("text", "\t", " ")), 256).alias("view"))


def unique_replacements(spark, sf):
    edit = edits.replace_unique(F.col("text"), F.col("role"), F.lit("someone")).alias("e")
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.translate("text", "\t", " "), F.lit("\nby "), F.when(F.col("turn") % 3 > 0, F.col("role")).otherwise("no one")).alias("text"))
    return rows.select("conv_id", "turn", edit).select("conv_id", "turn", F.sha2("e.text", 256).alias("text_hash"), F.col("e.line").cast("long").alias("line"), F.col("e.error").startswith("old text is in lines").alias("several"))


def line_inserts(spark, sf):
    edit = edits.insert_lines(F.translate(F.coalesce("text", F.lit("")), "\t", " "), (F.col("doc_id") % 4).cast("int"), F.lit("put\nhere")).alias("e")
    return _t(spark, sf, "documents").select("doc_id", edit).select("doc_id", F.sha2("e.text", 256).alias("text_hash"), F.col("e.error").isNull().alias("done"))


def edit_replay(spark, sf):
    log = _t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "undo").otherwise("edit").alias("kind"), "props")
    return edits.replay_edits(log, "user_id", "event_id").select("user_id", "event_id", "props")


def multilingual_rows(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("instance_id"), F.coalesce("source", F.lit("")).alias("repo"))
    known = docs.select("repo").distinct().withColumn("extension", F.when(F.length("repo") % 2 == 0, "go").otherwise("zig"))
    rows = routing.multilingual_task_rows(docs, known, source="many", prompt=lambda p: F.concat(F.lit("Fix "), p, F.lit(" code.")), metadata=["instance_id"])
    task = F.col("tools_kwargs.task")
    return rows.select("data_source", F.col("prompt")[1]["content"].alias("prompt"), task["sandbox"]["image"].alias("image"), task["metadata"].alias("metadata"))


def sample_unstack(spark, sf):
    batches = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m")).select("conv_id", F.col("m.turn").alias("turn"), F.col("m.role").alias("role"))
    return routing.unstack(batches, ["turn", "role"]).select("conv_id", F.col("sample").cast("long").alias("sample"), "turn", "role")


def token_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", hooks.token_count(F.col("text")).alias("tokens"))


QUERIES = {f.__name__: f for f in (numbered_views, unique_replacements, line_inserts, edit_replay, multilingual_rows, sample_unstack, token_counts)}

ORACLE_SQL = {
    "numbered_views": r"SELECT doc_id, sha256(array_to_string(list_transform(string_split(translate(text, chr(9), ' '), chr(10)), lambda l, i: lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || l), chr(10))) AS view FROM documents",
    "unique_replacements": """WITH c AS (SELECT conv_id, turn, role, translate(text, chr(9), ' ') || chr(10) || 'by ' || CASE WHEN turn % 3 > 0 THEN role ELSE 'no one' END AS t FROM conversations),
      n AS (SELECT *, (length(t) - length(replace(t, role, ''))) // length(role) AS n FROM c)
      SELECT conv_id, turn, sha256(CASE WHEN n = 1 THEN replace(t, role, 'someone') ELSE t END) AS text_hash, CASE WHEN n = 1 THEN len(string_split(string_split(t, role)[1], chr(10))) END AS line, CASE WHEN n <> 1 THEN n > 1 END AS several FROM n""",
    "line_inserts": """WITH d AS (SELECT doc_id, doc_id % 4 AS a, translate(coalesce(text, ''), chr(9), ' ') AS t, string_split(translate(coalesce(text, ''), chr(9), ' '), chr(10)) AS l FROM documents)
      SELECT doc_id, a BETWEEN 1 AND len(l) + 1 AS done, sha256(CASE WHEN a BETWEEN 1 AND len(l) + 1 THEN array_to_string(list_concat(l[1:a - 1], ['put', 'here'], l[a:]), chr(10)) ELSE t END) AS text_hash FROM d""",
    "edit_replay": """WITH s AS (SELECT user_id, list_reduce(list(CASE WHEN event_type = 'error' THEN CAST([] AS BIGINT[]) ELSE [event_id] END ORDER BY event_id),
      lambda acc, x: CASE WHEN len(x) = 0 THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, CAST([] AS BIGINT[])) AS stack FROM events GROUP BY user_id)
      SELECT e.user_id, e.event_id, e.props FROM s JOIN events e ON e.user_id = s.user_id AND e.event_id = s.stack[-1]""",
    "multilingual_rows": """SELECT 'many' AS data_source, 'Fix ' || CASE WHEN length(coalesce(source, '')) % 2 = 0 THEN 'Go' ELSE 'the project''s' END || ' code.' AS prompt,
      'swebench/sweb.eval.x86_64.' || doc_id AS image, '{"instance_id":"' || doc_id || '"}' AS metadata FROM documents""",
    "sample_unstack": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS sample, turn, role FROM conversations",
    "token_counts": "SELECT doc_id, CAST(greatest(1, coalesce(length(text), 0) // 4) AS BIGINT) AS tokens FROM documents",
}

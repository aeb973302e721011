"""Registered queries of chain stitching where it branches, in batch and as a stream, with their DuckDB SQL.

Each conversation is a session that follows one of the scripts below, with its first two texts as question (A) and answer
(B). A script is a list of events; what it must give is written down beside it and put together in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import tokens
from trajlake.operators import chains
from trajlake.session import scratch, stored
from trajlake.streaming import sessions

_U, _V = '{"role":"user","content":@A}', '{"role":"user","content":"second"}'
_B, _AGAIN = '{"role":"assistant","content":@B}', '{"role":"user","content":"again"}'
_CALLED = '{"role":"assistant","content":@B,"tool_calls":[{"id":"2","function":{"name":"f","arguments":{"x":1}}}]}'
_CALLS = '[{"id":"1","function":{"arguments":"{\\"x\\": 1}","name":"f"}}]'
_P = "user:@A\nassistant:"


def _ask(request: int, *messages: str) -> dict:
    return {"kind": "prepare", "request_id": request, "messages": "[" + ",".join(messages) + "]", "tools": ""}


def _answer(request: int, output: str, **more) -> dict:
    return {"kind": "commit", "request_id": request, "output": output} | more


_END = {"kind": "finalize"}

#: (name, events, trajectories as (prompt, response, model tokens, turns), what else they have, problems). In the
#: results @A and @B are the texts; lengths of B are written as "B".
SCRIPTS = [
    ("a call whose id and arguments are written otherwise", [_ask(0, _U), _answer(0, "@B", calls=_CALLS), _ask(1, _U, _CALLED, '{"role":"tool","content":"r","tool_call_id":"2"}'), _answer(1, "done"), _END],
     [(_P, "@Btool:r\nassistant:done", "B + 4", 4)], {}, []),
    ("a replaced answer", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U, _B, _V), _answer(1, "bad"), _ask(2, _U, _B, _V, _AGAIN), _answer(2, "good"), _END],
     [(_P, "@Buser:second\nuser:again\nassistant:good", "B + 4", 6)], {"rollbacks": 1, "dropped_tokens": 3}, []),
    ("another system prompt", [_ask(0, _U), _answer(0, "@B"), _ask(1, '{"role":"system","content":"S"}', _U), _answer(1, "other"), _ask(2, _U, _B, _V), _answer(2, "more"), _END],
     [("system:S\nuser:@A\nassistant:", "other", "5", 3), (_P, "@Buser:second\nassistant:more", "B + 4", 5)], {}, []),
    ("a failure and its retry", [_ask(0, _U), _answer(0, "lost", error="backend"), _ask(0, _U), _answer(0, "@B"), _END], [(_P, "@B", "B", 3)], {}, []),
    ("events behind the end", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U, _B, _V), _END, _answer(1, "late"), _END], [(_P, "@B", "B", 3)], {}, ["commit after FINALIZED", "finalize after FINALIZED"]),
    ("an aborted session", [_ask(0, _U), _answer(0, "@B"), {"kind": "abort"}, {"kind": "abort"}, _END], [], {}, ["finalize after ABORTED"]),
    ("two requests for one chain at a time", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U, _B, _V), _ask(2, _U, _B, _V), _answer(2, "Y"), _answer(1, "X"), _END],
     [("user:@A\nassistant:@B\nuser:second\nassistant:", "Y", "1", 5), (_P, "@Buser:second\nassistant:X", "B + 1", 5)], {}, []),
    ("rewards and versions", [_ask(0, _U), _answer(0, "@B", min_version=3, max_version=5), {"kind": "reward", "reward": "r1"}, {"kind": "reward", "reward": "r2"}, {"kind": "reward"}, _END],
     [(_P, "@B", "B", 3)], {"reward": "r2", "min_version": 3, "max_version": 5}, []),
    ("two chains that could be replaced", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U), _answer(1, "@B"), _ask(2, _U, _B, _V), _answer(2, "X"), _ask(3, _U, _B, _V), _answer(3, "Y"), _ask(4, _U, _B, _V, _AGAIN), _answer(4, "fixed"), _END],
     [(_P, "@Buser:second\nassistant:X", "B + 1", 5), (_P, "@Buser:second\nassistant:Y", "B + 1", 5), ("user:@A\nassistant:@B\nuser:second\nuser:again\nassistant:", "fixed", "5", 6)], {}, []),
    ("the first answer is never replaced", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U, _AGAIN), _answer(1, "new"), _END], [(_P, "@B", "B", 3), ("user:@A\nuser:again\nassistant:", "new", "3", 4)], {}, []),
    ("other tools", [_ask(0, _U), _answer(0, "@B"), _ask(1, _U, _B, _V) | {"tools": "t"}, _answer(1, "X"), _END], [(_P, "@B", "B", 3), ("user:@A\nassistant:@B\nuser:second\nassistant:", "X", "1", 5)], {}, []),
]
#: Rows of conversations whose events lie in one file of a stream's log.
ROWS = 5_000
#: A session whose chain is closed for its length; A is one character, and the chain holds 23 tokens.
CAPACITY = 23
FULL = [_ask(0, _U), _answer(0, "MAIN1"), _ask(1, '{"role":"user","content":"q"}'), _answer(1, "SUB"), _ask(2, _U, '{"role":"assistant","content":"MAIN1"}', '{"role":"user","content":"far too long"}'), _answer(2, "never"), _END]


def _log(spark: SparkSession, sf: str, scripts: list[list[dict]], short: bool = False) -> DataFrame:
    rows = [(k, seq, *[e.get(c) for c in ("kind", "request_id", "messages", "tools", "output", "min_version", "max_version", "error", "reward", "calls")]) for k, s in enumerate(scripts) for seq, e in enumerate(s)]
    script = spark.createDataFrame(rows, "k int, seq long, kind string, request_id long, messages string, tools string, output string, min_version int, max_version int, error string, reward string, calls string")
    texts = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    a, b = F.coalesce("a", F.lit("")), F.concat(F.coalesce("b", F.lit("")), F.lit("."))
    a = F.rpad(F.left(a, F.lit(1)), 1, "x") if short else a
    texts = texts.select("conv_id", a.alias("a"), b.alias("b"), (F.col("conv_id") % len(scripts)).cast("int").alias("k"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    log = texts.join(F.broadcast(script), "k")
    filled = F.replace(F.replace("messages", F.lit("@A"), quoted(F.col("a"))), F.lit("@B"), quoted(F.col("b")))
    return log.select(F.col("conv_id").cast("string").alias("session_id"), "seq", "kind", "request_id", filled.alias("messages"), "tools", F.replace("output", F.lit("@B"), F.col("b")).alias("output"), "min_version", "max_version", "error", "reward", "calls")


def _result(trajectories: DataFrame) -> DataFrame:
    ids = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.array_join(c, ","), 256))
    whole = [F.col(c).cast("long").alias(c) for c in ("trajectory_index", "num_turns", "min_version", "max_version", "rollbacks", "dropped_tokens")]
    return trajectories.select(F.col("session_id").cast("long").alias("conv_id"), *whole, ids("prompt_ids").alias("prompt_hash"), ids("response_ids").alias("response_hash"), tokens.total("response_mask").cast("long").alias("model_tokens"), "reward", "reason", "problem")


def chain_branches(spark, sf):
    return _result(chains.stitch(_log(spark, sf, [s for _, s, *_ in SCRIPTS])))


def chain_branches_stream(spark, sf):
    """The same log as a stream, each session's first half a trigger before the second; state is each session's chains."""
    folder = scratch(spark)
    log = stored(_log(spark, sf, [s for _, s, *_ in SCRIPTS]))
    n = spark.read.parquet(f"{sf}/conversations.parquet").count() // ROWS + 1
    log.where("seq < 3").repartition(n, "session_id").write.parquet(f"{folder}/log")
    files = len(spark.read.schema(log.schema).parquet(f"{folder}/log").inputFiles())
    log.where("seq >= 3").repartition(n, "session_id").write.mode("append").parquet(f"{folder}/log")
    stream = sessions.stitch_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log"))
    return _result(sessions.run_available(stream, folder, clock="processing"))


def chain_rollback_counters(spark, sf):
    counts = chains.rollback_counters(chains.stitch(_log(spark, sf, [s for _, s, *_ in SCRIPTS])))
    return counts.select(F.col("session_id").cast("long").alias("conv_id"), F.col("rollbacks").cast("long").alias("rollbacks"), "dropped_tokens")


def chain_capacity(spark, sf):
    return _result(chains.stitch(_log(spark, sf, [FULL], short=True), capacity=CAPACITY))


def _ids(text: str) -> str:
    return f"sha256(array_to_string(list_transform(string_split({text}, ''), lambda c: unicode(c)), ','))"


_TEXTS = "SELECT conv_id, coalesce(arg_min(text, turn), '') AS a, coalesce(arg_max(text, turn), '') || '.' AS b FROM conversations GROUP BY 1"


def _expected() -> str:
    out = []
    filled = lambda t: "replace(replace('" + t.replace("\n", "' || chr(10) || '") + "', '@A', a), '@B', b)"
    for k, (_, _, trajectories, more, problems) in enumerate(SCRIPTS):
        value = lambda name, kind="BIGINT", more=more: f"CAST({more[name]!r} AS {kind})" if name in more else f"CAST(NULL AS {kind})"
        for i, (prompt, response, trained, turns) in enumerate(trajectories):
            out.append(f"""SELECT conv_id, {i} AS trajectory_index, {turns} AS num_turns, {value("min_version")} AS min_version, {value("max_version")} AS max_version, {more.get("rollbacks", 0)} AS rollbacks, {more.get("dropped_tokens", 0)} AS dropped_tokens,
              {_ids(filled(prompt))} AS prompt_hash, {_ids(filled(response))} AS response_hash, {trained.replace("B", "length(b)")} AS model_tokens, {value("reward", "VARCHAR")} AS reward, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS problem FROM s WHERE conv_id % {len(SCRIPTS)} = {k}""")
        for p in problems:
            out.append(f"SELECT conv_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{p}' FROM s WHERE conv_id % {len(SCRIPTS)} = {k}")
    return f"WITH s AS ({_TEXTS}) " + " UNION ALL ".join(out)


QUERIES = {f.__name__: f for f in (chain_branches, chain_branches_stream, chain_rollback_counters, chain_capacity)}

ORACLE_SQL = {
    "chain_branches": _expected(),
    "chain_branches_stream": _expected(),
    "chain_rollback_counters": f"SELECT conv_id, CAST(CASE WHEN conv_id % {len(SCRIPTS)} = 1 THEN 1 ELSE 0 END AS BIGINT) AS rollbacks, CAST(CASE WHEN conv_id % {len(SCRIPTS)} = 1 THEN 3 ELSE 0 END AS BIGINT) AS dropped_tokens FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % {len(SCRIPTS)} <> 5",
    "chain_capacity": f"""WITH s AS (SELECT conv_id, rpad(left(a, 1), 1, 'x') AS a FROM ({_TEXTS})), r AS (SELECT conv_id, 0 AS i, 'user:q' || chr(10) || 'assistant:' AS p, 'SUB' AS r, CAST(NULL AS VARCHAR) AS reason FROM s
      UNION ALL SELECT conv_id, 1, 'user:' || a || chr(10) || 'assistant:', 'MAIN1', 'max_trajectory_length' FROM s)
      SELECT conv_id, i AS trajectory_index, 3 AS num_turns, NULL AS min_version, NULL AS max_version, 0 AS rollbacks, 0 AS dropped_tokens, {_ids("p")} AS prompt_hash, {_ids("r")} AS response_hash, length(r) AS model_tokens, NULL AS reward, reason, NULL AS problem FROM r""",
}

"""Registered queries of smaller functions and joins, with their DuckDB SQL: text, logs, settings, registries, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import messages, text, tokens, wire
from trajlake.operators import evaluate, hooks, routing, serving, trajectories
from trajlake.plans import queries
from trajlake.plans.shapes import pad, pad_sql, strip_sql


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _of(values: list, number) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (number % len(values) + 1).cast("int"))


def _sql(values: list, number: str) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'" for v in values) + f"][{number} % {len(values)} + 1]"


def fill_missing(spark, sf):
    e = _t(spark, sf, "events")
    fields = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("1"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("data_source"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("data_source"), F.col("event_type")))
    filled = wire.set_default(fields, "data_source", F.lit("unknown"))
    return e.select("event_id", F.map_contains_key(filled, "data_source").alias("has"), F.try_element_at(filled, F.lit("data_source")).alias("data_source"))


def merged_params(spark, sf):
    e = _t(spark, sf, "events")
    defaults = F.create_map(F.lit("temperature"), F.lit("1.0"), F.lit("top_p"), F.lit("0.9"), F.lit("stop"), F.lit(None).cast("string"))
    payload = F.create_map(F.lit("temperature"), F.when(F.col("event_id") % 2 == 0, "0.5"), F.lit("junk"), F.lit("1"), F.lit("max_tokens"), F.col("event_id").cast("string"))
    own = messages.merge_params(defaults, payload, ["temperature", "top_p", "top_k", "max_tokens", "stop"])
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(own), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("params"))


def partition_params(spark, sf):
    e = _t(spark, sf, "events")
    struct = lambda t, p, k: F.struct(F.lit(t).alias("temperature"), F.lit(p).alias("top_p"), F.lit(k).alias("top_k"))
    p = routing.sampling_params(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 4 == 0), struct(0.7, 0.8, 20), struct(0.6, 0.95, 5))
    return e.select("event_id", p["temperature"].alias("temperature"), p["top_p"].alias("top_p"), p["top_k"].cast("long").alias("top_k"))


def config_defaults(spark, sf):
    configs = spark.createDataFrame([("click", 10), ("view", 20)], "event_type string, turns long")
    matched, missed = routing.with_defaults(_t(spark, sf, "events").select("event_id", "event_type"), configs, "event_type")
    return matched.unionByName(missed, allowMissingColumns=True)


def annotations(spark, sf):
    c = _t(spark, sf, "part")
    left, right = F.array("p_name", "p_brand"), F.array(F.col("p_partkey").cast("string"), F.lit("z"))
    return c.select("p_partkey", F.explode(wire.paired(left, right)).alias("x")).select("p_partkey", F.col("x.left").alias("item"), F.col("x.right").alias("note"))


def session_owners(spark, sf):
    owners = _t(spark, sf, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("session"), (F.col("o_orderkey") % 3).alias("owner"))
    return serving.session_owner(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session")).distinct(), owners)


def wall_times(spark, sf):
    return evaluate.wall_time(_t(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("event_id") % 10).alias("elapsed")))


def ansi_strip(spark, sf):
    d = _t(spark, sf, "documents")
    wrapped = F.concat(F.lit("\x1b[1;31m"), F.coalesce("text", F.lit("")), F.lit("\x1b[0m\r\n\x1b[2Kx"))
    return d.select("doc_id", F.sha2(text.strip_ansi(wrapped), 256).alias("all_hash"), F.sha2(text.strip_ansi(wrapped, colours_only=True), 256).alias("colours_hash"))


def log_dispatch(spark, sf):
    """Logs of test runs between markers, or without an end, or with two starts; parsers by order, unknown ones too."""
    n = F.col("instance_id").cast("long")
    parser = F.when(n % 4 == 0, "parse_log_pytest").when(n % 4 == 1, "parse_log_pytest_v2").when(n % 4 == 2, "other")
    log = F.concat(F.lit("noise\nPASSED t::before\n>>>\n"), "log", F.when(n % 5 == 0, "").when(n % 3 == 0, "\n>>>\nPASSED t::second\n<<<").otherwise("\n<<<\nPASSED t::behind"))
    return evaluate.parse_logs(queries.run_logs(spark, sf).select("instance_id", log.alias("log"), parser.alias("log_parser")), ">>>", "<<<")


def marker_slices(spark, sf):
    """Whole texts with markers around them, before them, twice, or without an end."""
    t, n = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    raw = F.when(n == 0, F.concat(F.left(t, F.lit(10)), F.lit("<S>"), t, F.lit("<E>x"))).when(n == 1, t).when(n == 2, F.concat(t, F.lit("<S>"), t)).when(n == 3, F.concat(F.lit("<E><S>"), t, F.lit("<E>"))).otherwise(F.concat(F.lit("<S>"), F.left(t, F.lit(5)), F.lit("<S>"), t, F.lit("<E>")))
    return _t(spark, sf, "documents").select("doc_id", F.sha2(text.between_markers(raw, "<S>", "<E>"), 256).alias("once_hash"), F.sha2(text.between_split(raw, "<S>", "<E>"), 256).alias("split_hash"))


def issue_texts(spark, sf):
    d = _t(spark, sf, "documents")
    own = F.coalesce("text", F.lit(""))
    task = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("do <i>"), pad(F.col("doc_id")), own, pad(F.col("doc_id") + 1), F.lit("</i> more"))).when(F.col("doc_id") % 3 == 1, F.concat(own, F.lit("\nFollow: x"))).otherwise(F.concat(pad(F.col("n_chars")), own, pad(F.col("doc_id"))))
    return d.select("doc_id", F.sha2(text.issue_text(task, "<i>", "</i>", "\nFollow:"), 256).alias("issue_hash"))


def command_blocks(spark, sf):
    e = _t(spark, sf, "events")
    out, err = F.when(F.col("event_id") % 2 == 0, F.concat("props", F.lit(" \n"))), F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return e.select("event_id", text.exit_block(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5), out, err).alias("done"), text.timeout_block(F.col("event_id") % 4 * 1.5, out, err).alias("late"))


def eval_scripts(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", wire.eval_script("#!/bin/bash", F.array(F.lit("cd /x"), F.concat(F.lit("run "), "p_name")), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("end"))).otherwise(F.array().cast("array<string>"))).alias("script"))


#: Ends of settings; some make numbers of another kind of digits that come before them, some make them none.
ENDS = ("", "d", "\n", "f", "e2", "_0", "\u00a0", ".")


def env_settings(spark, sf):
    e = _t(spark, sf, "events")
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (F.col("event_id") % len(ENDS) + 1).cast("int"))
    v = F.when(F.col("event_id") % 3 == 0, F.concat(pad(F.col("user_id")), F.col("user_id").cast("string"), end)).when(F.col("event_id") % 3 == 1, F.concat(pad(F.col("event_id")), F.substring("event_type", 1, 1), end)).otherwise(F.concat(pad(F.col("user_id")), F.when(F.col("value") > 50, "On").otherwise("true"), end))
    e = e.withColumn("v", F.when(F.col("event_id") % 11 > 0, v))
    return e.select("event_id", text.env_number(F.col("v"), 7).alias("number"), text.env_flag(F.col("v")).alias("flag"))


def list_decoding(spark, sf):
    d = _t(spark, sf, "documents")
    listed = F.to_json(F.array("lang", "source"))
    v = F.when(F.col("doc_id") % 4 == 0, F.concat(pad(F.col("doc_id")), pad(F.col("n_chars")))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), listed, F.lit("\n"))).when(F.col("doc_id") % 4 == 2, F.concat(pad(F.col("n_chars")), "source"))
    d = d.withColumn("v", v)
    strict = text.decode_list(F.when(F.col("doc_id") % 4 != 2, F.col("v")))
    return d.select("doc_id", F.array_join(strict, "|").alias("strict"), F.array_join(text.lenient_list(F.col("v")), "|").alias("lenient"))


def first_messages(spark, sf):
    """First messages and faults of conversations as they are; ``blank_fault``: with white space as their first message."""
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    blank = F.transform(F.slice("m", 1, 1), lambda x: F.struct(x["role"].alias("role"), pad(F.col("conv_id")).alias("content")))
    return c.select("conv_id", F.sha2(wire.first_content(F.col("m"), "user"), 256).alias("user_hash"), F.sha2(wire.first_content(F.col("m"), "system"), 256).alias("system_hash"), wire.prompt_fault(F.col("m")).alias("fault"), wire.prompt_fault(F.slice("m", 1, 1)).alias("first_fault"), wire.prompt_fault(blank).alias("blank_fault"))


def media_parts(spark, sf):
    p = _t(spark, sf, "part")
    part = lambda kind, url: F.struct(kind.alias("type"), url.alias("url"))
    parts = F.array(part(F.lit("text"), F.col("p_name")), part(_of(["image", "image_url", "video", "text", "video_url", None], F.col("p_partkey")), F.col("p_brand")))
    m = hooks.media(parts)
    return p.select("p_partkey", wire.has_media(parts).alias("media"), F.array_join(m["images"], ",").alias("images"), F.array_join(m["videos"], ",").alias("videos"))


def scoring_inputs(spark, sf):
    t = trajectories.conversation_trajectories(_t(spark, sf, "conversations"))
    s = serving.scoring_input(t, ["conv_id"])
    return s.select("conv_id", F.size("input_ids").cast("long").alias("n"), tokens.total("attention_mask").cast("long").alias("ones"), F.sha2(tokens.decode(F.col("input_ids")), 256).alias("text_hash"), "num_turns")


def reward_overlay(spark, sf):
    e = _t(spark, sf, "events")
    over = wire.overlay(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("old")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("1"))))
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(over), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("info"))


def response_envelopes(spark, sf):
    e = _t(spark, sf, "events").withColumn("said", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""))
    call = F.struct(F.lit("c").alias("id"), F.lit("f").alias("name"), F.when(F.col("event_id") % 3 == 0, '{"x": 1}').otherwise("oops").alias("arguments"))
    calls = F.when(F.col("event_id") % 3 < 2, F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    ident = F.col("event_id").cast("string")
    one = wire.chat_response(ident, F.lit(5), F.lit("m"), F.col("said"), F.lit("stop"), F.col("event_id") % 10, F.lit(2).cast("long"))
    two = wire.message_response(ident, F.lit("m"), F.col("said"), calls, F.lit("end_turn"), F.col("event_id") % 10, F.lit(2).cast("long"))
    return e.select("event_id", one.alias("chat"), two.alias("message"))


def usage_counts(spark, sf):
    u = wire.usage(tokens.code_points(F.col("event_type")), tokens.code_points(F.col("props")))
    return _t(spark, sf, "events").select("event_id", u["prompt_tokens"].alias("prompt"), u["completion_tokens"].alias("completion"), u["total_tokens"].alias("total"))


def repeated_lengths(spark, sf):
    e = _t(spark, sf, "events")
    own = tokens.repeat_interleave(F.array(F.col("event_id") % 10, F.lit(7).cast("long")), F.array(F.col("event_id") % 4, F.lit(2).cast("long")))
    return e.select("event_id", F.array_join(own, ",").alias("lengths"))


def decoded_texts(spark, sf):
    ids = tokens.code_points(F.coalesce("text", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", F.sha2(tokens.decode(ids), 256).alias("text_hash"))


def generation_suffixes(spark, sf):
    c = _t(spark, sf, "conversations")
    plain = F.concat("role", F.lit(":"), "text", F.lit("\n"))
    suffix = tokens.generation_suffix(tokens.code_points(plain), tokens.code_points(F.concat(plain, F.lit("assistant:"))))
    return c.select("conv_id", "turn", tokens.decode(suffix).alias("suffix"))


def sorted_keys(spark, sf):
    from pyspark.sql import Window

    r = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("session"))
    order = Window.partitionBy("uid").orderBy(F.col("session").cast("string"))
    return serving.sort_keys(r).withColumn("place", F.row_number().over(order).cast("long"))


def common_columns(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("sometimes"), F.lit(None).cast("string").alias("never"))
    return routing.common_columns(c)


def known_names(spark, sf):
    return serving.known_names(_t(spark, sf, "nation").select(F.col("n_name").alias("name")), _t(spark, sf, "region").select(F.col("r_name").alias("name")), _t(spark, sf, "nation").select(F.col("n_name").alias("name")))


def duplicate_keys(spark, sf):
    return serving.duplicate_keys(_t(spark, sf, "orders").select(F.col("o_custkey").alias("name")))


#: A registry of each kind: what is registered, and under which name.
REGISTRY = [("task", "click", "task_rows"), ("task", "view", "multilingual_task_rows"), ("agent", "click", "react"), ("tool", "click", "shell"), ("tool", "purchase", "editor"), ("sandbox", "view", "local"), ("framework", "click", "rollout")]


def registry_lookups(spark, sf):
    registry = spark.createDataFrame(REGISTRY, "kind string, name string, target string")
    names = _t(spark, sf, "events").select("event_id", F.col("event_type").alias("name"))
    out = [serving.resolve(names, registry, kind).withColumn("kind", F.lit(kind)) for kind in ("task", "agent", "tool", "sandbox", "framework")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def scored_sessions(spark, sf):
    t = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("index"), "l_quantity")
    return serving.override_scores(t, lambda d: d.where("l_quantity > 10").groupBy("session").agg(F.max("l_quantity").alias("score")), ["session"])


def parsed_tool_calls(spark, sf):
    """A parser of one's own, which fails on some texts; those stay raw."""
    e = _t(spark, sf, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("do <call>"), "event_type")).when(F.col("event_id") % 3 == 1, F.col("props"))
    c = hooks.tool_calls(answer, _split_call)
    return e.select("event_id", c["content"].alias("content"), F.array_join(c["calls"], ",").alias("calls"))


def _split_call(answer: str) -> tuple[str, list[str]]:
    before, after = answer.split("<call>")
    return before, [after]


def finished_masks(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("tinyint")).alias("mask"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3 == 1).alias("finished"))
    return e.select("vec_id", tokens.total(tokens.mask_unfinished(F.col("mask"), F.col("finished"))).cast("long").alias("trained"))


QUERIES = {
    f.__name__: f
    for f in (
        fill_missing, merged_params, partition_params, config_defaults, annotations, session_owners, wall_times, ansi_strip, log_dispatch, marker_slices, issue_texts, command_blocks, eval_scripts, env_settings, list_decoding,
        first_messages, media_parts, scoring_inputs, reward_overlay, response_envelopes, usage_counts, repeated_lengths, decoded_texts, generation_suffixes, sorted_keys, common_columns, known_names, duplicate_keys, registry_lookups,
        scored_sessions, parsed_tool_calls, finished_masks,
    )
}

_TESTS = """WITH r AS (SELECT l_orderkey AS o, l_linenumber, l_quantity <= 25 AS tab, 't/m' || l_partkey % 5 || '.py::p' || l_partkey AS test,
    CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'XFAIL' ELSE 'PASSED' END ELSE ['SKIPPED', 'PASSED', 'ERROR'][l_linenumber % 3 + 1] END AS status FROM lineitem),
  v AS (SELECT o, l_linenumber, test AS t, status AS s, test, status FROM r WHERE o % 4 = 0 OR o % 4 = 1 AND NOT tab
    UNION ALL SELECT o, l_linenumber, test, status, 'assert', 'FAILED' || test FROM r WHERE o % 4 = 1 AND tab AND status = 'FAILED')
SELECT CAST(o AS VARCHAR) AS instance_id, test, arg_max(status, (l_linenumber, t, s)) AS status, CAST(NULL AS VARCHAR) AS error FROM v WHERE o % 5 > 0 GROUP BY o, test
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, NULL, 'unknown log parser: ' || CASE WHEN l_orderkey % 4 = 2 THEN 'other' ELSE 'null' END FROM lineitem WHERE l_orderkey % 4 > 1 GROUP BY l_orderkey"""
_KINDS = "(VALUES ('task'), ('agent'), ('tool'), ('sandbox'), ('framework')) k(kind)"
_PAIRS = ", ".join(f"('{k}', '{n}', '{t}')" for k, n, t in REGISTRY)
_OUT = "CASE WHEN event_id % 2 = 0 THEN rtrim(props) ELSE '' END"
_ERR = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END"
_CALLS = """CASE event_id % 3 WHEN 0 THEN '{"type":"tool_use","id":"c","name":"f","input":{"x":1}}' WHEN 1 THEN '{"type":"tool_use","id":"c","name":"f","input":{}}' END"""


def oracle_sql(trajectory_sql: str) -> dict[str, str]:
    """``trajectory_sql`` has conv_id, prompt and response (texts) and num_turns of each trajectory."""
    from trajlake.functions.text import TIMEOUT_TEXT

    return {
        "fill_missing": "SELECT event_id, true AS has, CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 2 THEN event_type END AS data_source FROM events",
        "merged_params": "SELECT event_id, 'max_tokens=' || event_id || ',temperature=' || CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '1.0' END || ',top_p=0.9' AS params FROM events",
        "partition_params": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.6 WHEN event_id % 4 = 2 THEN 0.0 ELSE 0.7 END::DOUBLE AS temperature, CASE WHEN event_id % 3 = 0 THEN 0.95 WHEN event_id % 4 = 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS top_p, CAST(CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 4 = 2 THEN -1 ELSE 20 END AS BIGINT) AS top_k FROM events",
        "config_defaults": "SELECT event_id, event_type, CAST(CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 END AS BIGINT) AS turns FROM events",
        "annotations": "SELECT p_partkey, p_name AS item, CAST(p_partkey AS VARCHAR) AS note FROM part UNION ALL SELECT p_partkey, p_brand, 'z' FROM part",
        "session_owners": "SELECT DISTINCT l_orderkey AS session, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS owner, CASE WHEN coalesce(o_orderkey % 5, 0) = 0 THEN 'unknown session: ' || l_orderkey END AS error FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
        "wall_times": "SELECT event_type AS name, CAST(sum(event_id % 10) AS BIGINT) AS elapsed FROM events GROUP BY 1",
        "ansi_strip": "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(13), '') || chr(10) || 'x') AS all_hash, sha256(replace(coalesce(text, ''), chr(13), '') || chr(10) || chr(27) || '[2Kx') AS colours_hash FROM documents",
        "log_dispatch": _TESTS,
        "marker_slices": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN left(t, 10) || '<S>' || t || '<E>x' WHEN 1 THEN t WHEN 2 THEN t || '<S>' || t WHEN 3 THEN '<E><S>' || t || '<E>' ELSE '<S>' || left(t, 5) || '<S>' || t || '<E>' END AS raw FROM d),
          x AS (SELECT doc_id, raw, contains(raw, '<S>') AS s, contains(raw, '<E>') AS e, substr(raw, strpos(raw, '<S>') + 3) AS rest FROM m)
          SELECT doc_id, CASE WHEN s AND contains(rest, '<E>') THEN sha256(split_part(rest, '<E>', 1)) END AS once_hash, CASE WHEN s AND e THEN sha256(split_part(split_part(raw, '<S>', 2), '<E>', 1)) END AS split_hash FROM x""",
        "issue_texts": f"""SELECT doc_id, sha256({strip_sql("coalesce(text, '')")}) AS issue_hash FROM documents""",
        "command_blocks": f"""SELECT event_id, '[exit code: ' || CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 5 AS VARCHAR) ELSE 'unknown' END || ']' || chr(10) || '[stdout]' || chr(10) || CASE WHEN {_OUT} = '' THEN '(empty)' ELSE {_OUT} END
          || CASE WHEN {_ERR} <> '' THEN chr(10) || '[stderr]' || chr(10) || {_ERR} ELSE '' END AS done,
          '{TIMEOUT_TEXT[0]}' || ['0', '1.5', '3', '4.5'][event_id % 4 + 1] || '{TIMEOUT_TEXT[1]}' || CASE WHEN {_OUT} <> '' THEN chr(10) || '[partial stdout]' || chr(10) || {_OUT} ELSE '' END || CASE WHEN {_ERR} <> '' THEN chr(10) || '[partial stderr]' || chr(10) || {_ERR} ELSE '' END AS late FROM events""",
        "eval_scripts": "SELECT p_partkey, '#!/bin/bash' || chr(10) || 'cd /x' || chr(10) || 'run ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'end' ELSE '' END AS script FROM part",
        "env_settings": rf"""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN CASE event_id % 3 WHEN 0 THEN {pad_sql("user_id")} || user_id WHEN 1 THEN {pad_sql("event_id")} || left(event_type, 1) ELSE {pad_sql("user_id")} || CASE WHEN value > 50 THEN 'On' ELSE 'true' END END
            || ['', 'd', chr(10), 'f', 'e2', '_0', chr(160), '.'][event_id % {len(ENDS)} + 1] END AS v FROM events), s AS (SELECT event_id, {strip_sql("v")} AS v FROM e)
          SELECT event_id, CASE WHEN regexp_matches(v, '^\d+(_\d+)?[.]?(e\d+)?$') THEN CAST(replace(v, '_', '') AS DOUBLE) ELSE 7.0::DOUBLE END AS number, coalesce(lower(v) IN ('1', 'true', 'yes', 'on'), false) AS flag FROM s""",
        "list_decoding": f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN array_to_string([lang, source], '|') WHEN 2 THEN {pad_sql("n_chars")} || source END AS l FROM documents)
          SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '' ELSE coalesce(l, '') END AS strict, CASE WHEN {strip_sql("coalesce(l, '')")} = '' THEN '' ELSE l END AS lenient FROM d""",
        "first_messages": """SELECT conv_id, sha256(arg_min(text, turn) FILTER (role = 'user')) AS user_hash, sha256(arg_min(text, turn) FILTER (role = 'system')) AS system_hash,
          CASE WHEN count(*) > 2 THEN 'at most two messages' WHEN coalesce(arg_min(text, turn) FILTER (role = 'user'), '') = '' THEN 'no user message' END AS fault,
          CASE WHEN arg_min(role, turn) <> 'user' OR arg_min(text, turn) = '' THEN 'no user message' END AS first_fault,
          CASE WHEN arg_min(role, turn) <> 'user' OR """ + pad_sql("conv_id") + """ = '' THEN 'no user message' END AS blank_fault FROM conversations GROUP BY 1""",
        "media_parts": "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 4) AS media, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_brand ELSE '' END AS images, CASE WHEN p_partkey % 6 IN (2, 4) THEN p_brand ELSE '' END AS videos FROM part",
        "scoring_inputs": f"SELECT conv_id, CAST(length(prompt || response) AS BIGINT) AS n, CAST(length(prompt || response) AS BIGINT) AS ones, sha256(prompt || response) AS text_hash, num_turns FROM ({trajectory_sql})",
        "reward_overlay": "SELECT event_id, 'a=' || event_type || CASE WHEN event_id % 2 = 0 THEN ',b=new' ELSE ',b=old,c=1' END AS info FROM events",
        "response_envelopes": f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS said, event_id % 10 AS p, {_CALLS} AS call FROM events)
          SELECT event_id, '{{"id":"chatcmpl-' || event_id || '","object":"chat.completion","created":5,"model":"m","choices":[{{"index":0,"message":{{"role":"assistant","content":"' || said || '"}},"finish_reason":"stop"}}],"usage":{{"prompt_tokens":' || p || ',"completion_tokens":2,"total_tokens":' || (p + 2) || '}}}}' AS chat,
          '{{"id":"msg_' || event_id || '","type":"message","role":"assistant","model":"m","content":[' || concat_ws(',', CASE WHEN said <> '' OR call IS NULL THEN '{{"type":"text","text":"' || said || '"}}' END, call) || '],"stop_reason":"end_turn","usage":{{"input_tokens":' || p || ',"output_tokens":2}}}}' AS message FROM e""",
        "usage_counts": "SELECT event_id, length(event_type) AS prompt, length(props) AS completion, length(event_type) + length(props) AS total FROM events",
        "repeated_lengths": "SELECT event_id, repeat((event_id % 10) || ',', CAST(event_id % 4 AS INTEGER)) || '7,7' AS lengths FROM events",
        "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents",
        "generation_suffixes": "SELECT conv_id, turn, 'assistant:' AS suffix FROM conversations",
        "sorted_keys": "SELECT o_custkey AS uid, o_orderkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS place FROM orders",
        "common_columns": "SELECT c_custkey, c_name FROM customer",
        "known_names": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
        "duplicate_keys": "SELECT o_custkey AS name, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
        "registry_lookups": f"SELECT event_id, event_type AS name, k.kind, target, CASE WHEN target IS NULL THEN 'unknown ' || k.kind || ': ' || event_type END AS error FROM events, {_KINDS} LEFT JOIN (VALUES {_PAIRS}) r(kind, name, target) ON r.kind = k.kind AND r.name = event_type",
        "scored_sessions": "SELECT l_orderkey AS session, l_linenumber AS index, l_quantity, CAST(max(CASE WHEN l_quantity > 10 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS score FROM lineitem",
        "parsed_tool_calls": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'do ' WHEN 1 THEN props END AS content, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS calls FROM events",
        "finished_masks": "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 2 THEN 0 ELSE len(list_filter(embedding, lambda x: x > 0)) END AS BIGINT) AS trained FROM embeddings",
    }

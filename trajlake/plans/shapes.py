"""Registered queries of request and response shapes and of the joins around sessions, with their DuckDB SQL.

Proxies: ``events`` are tool calls (event_type is the tool, props its arguments, value a reward); ``conversations`` are
messages; ``lineitem`` rows are attempted calls, those with discount 0 were not executed; ``orders`` are sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions import wire
from trajlake.operators import serving


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def message_whitelists(spark, sf):
    m = F.parse_json(F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"), F.lit("x").alias("other"))))
    out = wire.outbound_message(F.col("role"), F.col("text"), F.lit("calls"), F.lit("id"), F.when(F.col("turn") % 2 == 0, "n"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.sha2(wire.keep_fields(m), 256).alias("kept"), F.sha2(out, 256).alias("sent"))


def image_fields(spark, sf):
    p = _t(spark, sf, "part").withColumn("flat", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, ""))
    image = wire.provider_image(F.concat(F.lit("docker.io/a/"), "p_name"), {"docker.io/a/": "own.example/"}, {"docker.io/a/": ":v2"}, {"docker.io/a/x": "y"})
    return p.select("p_partkey", wire.first_filled(F.col("flat"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("image"), image.alias("provider"))


#: White space of several kinds, and how it is spelled out in SQL patterns.
PADS = ("\n", "\t ", "\u00a0", " \r\n", "", "\u2003\u000b")
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def pad(number: Column) -> Column:
    """White space of a kind that depends on a number."""
    return F.element_at(F.array(*[F.lit(p) for p in PADS]), (number % len(PADS) + 1).cast("int"))


def pad_sql(number: str) -> str:
    return "[" + ", ".join(" || ".join(["''", *[f"chr({ord(c)})" for c in p]]) for p in PADS) + f"][({number}) % {len(PADS)} + 1]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def chat_prompts(spark, sf):
    fields = {"chat_id": F.col("user_id").cast("string"), "message_type": F.col("event_type")}
    body = wire.chat_prompt("New message", fields, F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 0, ""), F.concat(F.lit(" \n"), "props", pad(F.col("event_id")), pad(F.col("user_id"))))
    return _t(spark, sf, "events").select("event_id", body.alias("prompt"))


def language_phrases(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("go", "rs", "py", "js")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, sf, "documents").select("doc_id", wire.language_phrase(ext).alias("language"))


def tool_conversion(spark, sf):
    body = F.concat(F.lit('{"name":"'), "event_type", F.lit('","description":'), F.when(F.col("event_id") % 2 == 0, '"d"').otherwise("5"), F.lit(',"input_schema":{"n":'), F.col("event_id").cast("string"), F.lit('},"cache_control":{}}'))
    return _t(spark, sf, "events").select("event_id", wire.convert_tool(F.parse_json(body)).alias("tool"))


def url_parts(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", wire.authority(F.col("url")).alias("authority"), wire.with_path(F.col("url"), "/v1").alias("rewritten"), wire.authority(F.concat(F.lit("http://h:81/a?b="), F.col("page_id").cast("string"))).alias("own_port"))


def argument_faults(spark, sf):
    args = F.when(F.col("event_id") % 4 == 0, pad(F.col("event_id"))).when(F.col("event_id") % 4 == 1, F.col("props")).when(F.col("event_id") % 4 == 2, '{"z":1,"k":2,"a":null}').otherwise("[1]")
    tools = spark.createDataFrame([("click", ["k"], ["k"]), ("view", ["k", "z"], [])], "tool string, known array<string>, required array<string>")
    calls = _t(spark, sf, "events").select("event_id", F.col("event_type").alias("tool"), args.alias("arguments"))
    return serving.argument_faults(calls, tools).select("event_id", "error")


def list_functions(spark, sf):
    d = _t(spark, sf, "documents")
    own, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    items = wire.comma_list(F.concat(own, pad(F.col("doc_id")), F.lit(",\t,"), pad(F.col("doc_id") + 1), lang, F.lit(",\u00a0b\n")))
    tests = wire.task_text(F.when(F.col("doc_id") % 3 == 0, F.array(own)).otherwise(F.array().cast("array<string>")), F.when(F.col("doc_id") % 3 == 1, items).otherwise(F.array().cast("array<string>")), "none")
    return d.select("doc_id", F.array_join(items, "|").alias("items"), tests.alias("tests"), F.array_join(wire.unknown_parameters(items, F.array(F.lit("b"))), "|").alias("unknown"))


def reward_payloads(spark, sf):
    e = _t(spark, sf, "events").withColumn("r", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 2))
    payload = wire.reward_payload(F.col("r"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.when(F.col("event_id") % 5 == 0, F.lit(True)))
    context = wire.reward_context(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.from_json(F.concat(F.lit('{"reward_score":'), F.coalesce(F.col("r").cast("string"), F.lit("null")), F.lit("}")), "map<string,string>"))
    return e.select("event_id", payload.alias("payload"), context["data_source"].alias("data_source"), context["score"].alias("score"))


def answer_chunks(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(wire.answer_chunks(F.col("text"), F.lit("stop"))).alias("index", "e"))
    return rows.select("conv_id", "turn", F.col("index").cast("long").alias("index"), F.col("e.event").alias("event"), F.col("e.data").alias("data"))


def call_status(spark, sf):
    calls, key = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount").distinct(), ["l_orderkey", "l_linenumber"]
    done = calls.groupBy(*key).agg(F.max("l_discount").alias("d")).where("d > 0").withColumn("status", F.lit("success"))
    return serving.call_status(calls.select(*key).distinct(), done, key)


def first_failure_reasons(spark, sf):
    failed = _t(spark, sf, "events").where("event_type = 'error'")
    return serving.first_reasons(failed, "user_id", F.col("event_id"), F.col("props")).select("user_id", F.array_join("reasons", "|").alias("reasons"))


def least_loaded(spark, sf):
    load = _t(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("pool"), (F.col("o_orderkey") % 7).alias("worker")).agg(F.count(F.lit(1)).alias("active"))
    return serving.least_loaded(load, "pool")


def sample_passthrough(spark, sf):
    samples = _t(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return serving.with_sample_fields(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), samples, ["o_custkey", "o_orderstatus"], "l_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        message_whitelists, image_fields, chat_prompts, language_phrases, tool_conversion, url_parts, argument_faults, list_functions, reward_payloads,
        answer_chunks, call_status, first_failure_reasons, least_loaded, sample_passthrough,
    )
}

ORACLE_SQL = {
    "message_whitelists": """SELECT conv_id, turn, sha256(CAST(to_json(struct_pack(role := role, content := text)) AS VARCHAR)) AS kept,
      sha256('{"role":"' || role || '","content":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN role = 'assistant' THEN ',"tool_calls":"calls"' ELSE '' END
        || CASE WHEN role = 'tool' THEN ',"tool_call_id":"id"' || CASE WHEN turn % 2 = 0 THEN ',"name":"n"' ELSE '' END ELSE '' END || '}') AS sent FROM conversations""",
    "image_fields": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS image, 'own.example/' || p_name || ':v2' AS provider FROM part""",
    "chat_prompts": """SELECT event_id, '[New message]' || chr(10) || '  chat_id:        ' || user_id || chr(10) || '  message_type:   ' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || '  create_time_ms: ' || event_id ELSE '' END || chr(10) || chr(10) || 'Content:' || chr(10)
      || regexp_replace(' ' || chr(10) || props || """ + pad_sql("event_id") + " || " + pad_sql("user_id") + f""", '{SPACE}+$', '') || chr(10) AS prompt FROM events""",
    "language_phrases": "SELECT doc_id, ['Go', 'Rust', 'the project''s', 'JavaScript'][doc_id % 4 + 1] AS language FROM documents",
    "tool_conversion": """SELECT event_id, '{"type":"function","function":{"name":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"description":"d"' ELSE '' END || ',"parameters":{"n":' || event_id || '}}}' AS tool FROM events""",
    "url_parts": r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS s, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS a FROM pages)
      SELECT page_id, a || CASE WHEN regexp_matches(a, ':\d+$') THEN '' WHEN s = 'https' THEN ':443' ELSE ':80' END AS authority, s || '://' || a || '/v1' AS rewritten, 'h:81' AS own_port FROM u""",
    "argument_faults": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'arguments must be a JSON object' WHEN event_type NOT IN ('click', 'view') THEN 'unknown tool: ' || event_type
      WHEN event_id % 4 = 2 THEN CASE event_type WHEN 'click' THEN 'unknown parameters: a, z' ELSE 'unknown parameters: a' END WHEN event_id % 4 = 0 AND event_type = 'click' THEN 'missing parameters: k' END AS error FROM events""",
    "list_functions": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS s, list_filter(list_transform(string_split(coalesce(source, '') || {pad_sql("doc_id")} || ',' || chr(9) || ',' || {pad_sql("doc_id + 1")} || coalesce(lang, '') || ',' || chr(160) || 'b' || chr(10), ','), lambda x: {strip_sql("x")}), lambda x: x <> '') AS l FROM documents)
      SELECT doc_id, array_to_string(l, '|') AS items, CASE doc_id % 3 WHEN 0 THEN '- ' || s WHEN 1 THEN array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) ELSE 'none' END AS tests, array_to_string(list_sort(list_filter(l, lambda x: x <> 'b')), '|') AS unknown FROM d""",
    "reward_payloads": """SELECT event_id, '{"reward":' || coalesce(CAST(r AS VARCHAR), 'null') || CASE WHEN event_id % 2 = 0 THEN ',"acc":' || event_id ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ',"finished":true' ELSE '' END || '}' AS payload,
      CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS data_source, CAST(coalesce(r, 0) AS DOUBLE) AS score FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id % 2 END AS r FROM events)""",
    "answer_chunks": """SELECT conv_id, turn, CAST(0 AS BIGINT) AS index, 'role' AS event, 'assistant' AS data FROM conversations
      UNION ALL SELECT conv_id, turn, i + 1, 'content', substr(text, i * 64 + 1, 64) FROM conversations, LATERAL (SELECT unnest(range((length(text) + 63) // 64)) AS i)
      UNION ALL SELECT conv_id, turn, (length(text) + 63) // 64 + 1, 'finish', 'stop' FROM conversations""",
    "call_status": "SELECT l_orderkey, l_linenumber, CASE WHEN max(l_discount) > 0 THEN 'success' ELSE 'rejected' END AS status FROM lineitem GROUP BY 1, 2",
    "first_failure_reasons": "SELECT user_id, string_agg(props, '|' ORDER BY event_id) AS reasons FROM (SELECT * FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3) GROUP BY 1",
    "least_loaded": "WITH l AS (SELECT o_custkey % 5 AS pool, o_orderkey % 7 AS worker, count(*) AS active FROM orders GROUP BY 1, 2) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY pool ORDER BY active, worker) = 1",
    "sample_passthrough": "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}

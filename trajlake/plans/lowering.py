"""Registered queries of request lowering, canonical messages and tool arguments, with their DuckDB SQL.

Bodies are built around whole texts of ``conversations``, as a template with the text's JSON put in; which template, the
row says. ``events`` are tool calls. Each case lists what it lowers to, or why it doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import messages, schemas, wire
from trajlake.operators import normalize, routing, serving

_IMAGE = '{"type":"image","source":{"type":"base64","media_type":"image/png","data":"AA"}}'
_LINK = '{"type":"image","source":{"type":"url","url":"http://h/i.png"}}'
_PART = '{"image_url":{"url":"data:image/png;base64,AA"},"type":"image_url"}'


def _text(t: str) -> str:
    return f'{{"type":"text","text":{t}}}'


def _user(content: str) -> str:
    return f'{{"role":"user","content":{content}}}'


def _note(text: str) -> str:
    return f"<system-reminder>\\n{text}\\n</system-reminder>"


_USE = '{"role":"assistant","content":[{"type":"thinking","thinking":"?"},{"type":"tool_use","id":"c1","name":"f","input":{"x":1}},{"type":"text","text":"t"}]}'
_USED = '{"role":"assistant","content":"t","tool_calls":"[{\\"function\\":{\\"arguments\\":{\\"x\\":1},\\"name\\":\\"f\\"},\\"id\\":\\"c1\\",\\"type\\":\\"function\\"}]"}'


def _result(content: str) -> str:
    return f'{{"type":"tool_result","tool_use_id":"c1","content":{content}}}'


def _tool(text: str) -> str:
    return f'{{"role":"tool","content":{text},"tool_call_id":"c1"}}'


def _shown(*parts: str) -> str:
    escaped = ",".join(parts).replace("\\", "\\\\").replace('"', '\\"')
    return f'{{"role":"user","parts":"[{escaped}]"}}'


#: (messages, what they lower to) of the one format; @ stands for the row's text as JSON, # for it without the quotes.
BLOCKS = [
    (_user("@"), _user("@")),
    (_user(f'[{_text("@")},{_text(chr(34) + "b" + chr(34))}]'), _user('"#\\nb"')),
    (_user(f"[{_IMAGE},{_LINK}]"), _shown(_PART, '{"image_url":{"url":"http://h/i.png"},"type":"image_url"}')),
    (_user(f'[{_text(chr(34) + "a" + chr(34))},{_IMAGE}]'), _shown('{"text":"a","type":"text"}', _PART)),
    (f'{_user("@")},{_USE},{_user("[" + _result("@") + "]")}', f'{_user("@")},{_USED},{_tool("@")}'),
    (f'{_user("@")},{_USE},{_user("[" + _result("[" + _IMAGE + "," + _text("@") + "]") + "," + _text("@") + "]")}', f'{_user("@")},{_USED},{_tool(chr(34) * 2)},{_shown(_PART)},{_tool("@")},{_user("@")}'),
    (f'{_user("@")},{_USE},{_user("[" + _result("[]") + "]")}', f'{_user("@")},{_USED},{_tool(chr(34) * 2)}'),
    (f'{_user("@")},{_USE},{_user("[" + _result("null") + "]")}', f'{_user("@")},{_USED},{_tool(chr(34) * 2)}'),
    # Reminders: behind the last user message before them, also where that one holds a tool result.
    (f'{_user("@")},{_USE},{_user("[" + _result("@") + "]")},{{"role":"system","content":"n"}}', f'{_user("@")},{_USED},{_tool("@")},{_user(chr(34) + _note("n") + chr(34))}'),
    (f'{_user("@")},{{"role":"system","content":"n"}},{{"role":"system","content":[{{"type":"text","text":""}}]}},{{"role":"system","content":"m"}}', _user(f'"#\\n{_note("n")}\\n{_note("m")}"')),
    (f'{{"role":"system","content":"n"}},{{"role":"assistant","content":@}},{_user("@")}', f'{{"role":"assistant","content":@}},{_user(chr(34) + _note("n") + chr(92) + "n#" + chr(34))}'),
    (f'{{"role":"system","content":"n"}},{_user("[" + _text("@") + "]")},{{"role":"system","content":"m"}}', _user(f'"{_note("n")}\\n#\\n{_note("m")}"')),
    ('{"role":"system","content":"n"},{"role":"assistant","content":@}', f'{{"role":"assistant","content":@}},{_user(chr(34) + _note("n") + chr(34))}'),
    # Faults.
    ('{"role":"assistant","content":[{"type":"redacted_thinking"}]}', None), ('{"role":"tool","content":@}', None), (_user("5"), None), (_user('[{"type":"text","text":5}]'), None),
    (_user('[{"type":"tool_result","content":@}]'), None), ('{"role":"system","content":""}', None), ("", None), (_user('[{"type":"image","source":{"type":"file"}}]'), None),
    ('{"role":"assistant","content":[{"type":"tool_use","id":"","name":"f"}]}', None), ('{"role":"assistant","content":[{"type":"tool_use","id":"c","name":"f","input":[]}]}', None), ("5", None),
]
#: The same of the other format.
PLAIN = [
    ('{"role":"user","content":@,"junk":1}', '{"role":"user","content":@}'),
    ('{"role":"assistant","content":null}', '{"role":"assistant","content":""}'),
    ('{"role":"assistant"}', '{"role":"assistant","content":""}'),
    ('{"role":"user","content":[{"type":"text","text":"p"}],"name":"n"}', '{"role":"user","parts":"[{\\"text\\":\\"p\\",\\"type\\":\\"text\\"}]","name":"n"}'),
    ('{"role":"tool","content":@,"tool_call_id":7}', '{"role":"tool","content":@,"tool_call_id":"7"}'),
    (
        '{"role":"assistant","content":@,"tool_calls":[{"id":"1","index":0,"function":{"name":"f","arguments":"{\\"x\\": 1}"}},{"id":"2","function":{"name":"g","arguments":"not json"}}],"reasoning_content":"r"}',
        '{"role":"assistant","content":@,"tool_calls":"[{\\"function\\":{\\"arguments\\":{\\"x\\":1},\\"name\\":\\"f\\"},\\"id\\":\\"1\\",\\"index\\":0},{\\"function\\":{\\"arguments\\":\\"not json\\",\\"name\\":\\"g\\"},\\"id\\":\\"2\\"}]","reasoning_content":"r"}',
    ),
    ('{"role":"","content":@}', None), ('{"content":@}', None), ('{"role":"user","content":5}', None), ('{"role":"user","name":5}', None), ('{"role":"assistant","tool_calls":{}}', None),
    ('{"role":"assistant","tool_calls":[{}]}', None), ('{"role":"assistant","reasoning_content":1}', None), ("", None), ("[]", None),
]


def _case(cases: list, number) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in cases]), (number % len(cases) + 1).cast("int"))


def _bodies(spark: SparkSession, sf: str, cases: list, wire: str) -> DataFrame:
    own = F.substring(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), 6, 1 << 30)
    quoted = F.substring(own, F.lit(1), F.length(own) - 1)
    body = F.replace(F.replace(_case([c for c, _ in cases], F.col("conv_id") * 3 + F.col("turn")), F.lit("@"), quoted), F.lit("#"), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.lit(wire).alias("wire"), F.concat(F.lit('{"messages":['), body, F.lit("]}")).alias("body"))


def _lowered(df: DataFrame) -> DataFrame:
    return normalize.normalize(df).select("conv_id", "turn", F.sha2(F.to_json("messages"), 256).alias("messages_hash"), F.col("error").isNotNull().alias("refused"))


def anthropic_blocks(spark, sf):
    return _lowered(_bodies(spark, sf, BLOCKS, "anthropic"))


def openai_messages(spark, sf):
    return _lowered(_bodies(spark, sf, PLAIN, "openai"))


def _case_sql(cases: list) -> str:
    values = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for _, c in cases)
    return f"""WITH t AS (SELECT conv_id, turn, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q, [{values}][(conv_id * 3 + turn) % {len(cases)} + 1] AS c FROM conversations)
      SELECT conv_id, turn, sha256('[' || replace(replace(c, '@', q), '#', substr(q, 2, length(q) - 2)) || ']') AS messages_hash, c IS NULL AS refused FROM t"""


#: System entries (JSON) and their text; @ as above.
SYSTEMS = [
    ('"  @q  "', "@q"), ('[{"type":"text","text":"a"},{"type":"text","text":""},{"type":"text","text":"b"}]', "a\nb"), ('"X-Anthropic-Billing-Header: 5\\nkept"', "kept"),
    ('"one\\n x-anthropic-billing-header: 6\\ntwo"', "one\ntwo"), ("null", ""), ('""', ""),
]


def system_texts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    body = F.replace(_case([s for s, _ in SYSTEMS], F.col("event_id")), F.lit("@q"), F.col("event_type"))
    return e.select("event_id", normalize.system_text(F.parse_json(body)).alias("system"))


#: Messages (JSON) and their canonical form: ids of calls don't count, arguments count by value.
CANONICAL = [
    ('{"role":"tool","content":"@","tool_call_id":"9"}', '{"content":"@","role":"tool"}'),
    ('{"role":"assistant","content":"@","tool_calls":[{"id":"1","function":{"name":"f","arguments":"{\\"b\\": 1, \\"a\\": 2}"}}]}', '{"content":"@","role":"assistant","tool_calls":[{"function":{"arguments":{"kind":"json","value":{"a":2,"b":1}},"name":"f"}}]}'),
    ('{"role":"assistant","content":"@","tool_calls":[{"id":"2","function":{"name":"f","arguments":{"a":2,"b":1}}}]}', '{"content":"@","role":"assistant","tool_calls":[{"function":{"arguments":{"kind":"json","value":{"a":2,"b":1}},"name":"f"}}]}'),
    ('{"role":"assistant","content":"@","tool_calls":[{"id":"3","function":{"name":"f","arguments":"oops"}}]}', '{"content":"@","role":"assistant","tool_calls":[{"function":{"arguments":{"kind":"raw","value":"oops"},"name":"f"}}]}'),
    ('{"role":"assistant","content":"@","tool_calls":"odd"}', '{"content":"@","role":"assistant","tool_calls":"odd"}'),
]


def canonical_messages(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    body = F.replace(_case([s for s, _ in CANONICAL], F.col("event_id")), F.lit("@"), F.col("event_type"))
    return e.select("event_id", F.to_json(messages.canonical_message(F.parse_json(body))).alias("canonical"))


#: Arguments of the tool ``t`` (n integer, x number, b boolean, s string, l array), what they become, and what can't be.
TYPED = [
    ('{"n":"5","x":"1.5","b":"yes","s":"q","l":[1]}', '{"b":true,"l":[1],"n":5,"s":"q","x":1.5}', None), ('{"n":5.0,"b":0}', '{"b":false,"n":5}', None), ('{"n":true,"other":null}', '{"n":1,"other":null}', None),
    ('{"n":1.5,"s":5}', None, "wrong types: n, s"), ('{"b":"maybe","l":"x"}', None, "wrong types: b, l"), (" ", "{}", None), (None, "{}", None), ('{"x":7}', '{"x":7}', None),
]


def argument_types(spark, sf):
    types = spark.createDataFrame([("t", {"n": "integer", "x": "number", "b": "boolean", "s": "string", "l": "array"})], "tool string, types map<string,string>")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.lit("t").alias("tool"), _case([a for a, *_ in TYPED], F.col("event_id")).alias("arguments"))
    return serving.coerced_arguments(e, types).select("event_id", "arguments", "type_error")


#: Schemas and their normal form.
SCHEMAS = [
    ('{"title":"T","type":"object","properties":{"a":{"anyOf":[{"type":"integer"},{"type":"null"}],"default":null,"title":"A"}}}', '{"type":"object","properties":{"a":{"type":"integer"}}}'),
    ('{"required":["b"],"type":"object","additionalProperties":false,"description":"d"}', '{"type":"object","description":"d","required":["b"],"additionalProperties":false}'),
    ('{"anyOf":[{"type":"string"},{"type":"integer"}],"default":0}', '{"default":0,"anyOf":[{"type":"string"},{"type":"integer"}]}'), ('{"items":{"title":"x","type":"number"},"type":"array"}', '{"type":"array","items":{"type":"number"}}'),
    ('{"zeta":1,"minimum":2,"type":"string","alpha":{"y":1,"title":"t","x":2}}', '{"type":"string","zeta":1,"minimum":2,"alpha":{"y":1,"x":2}}'), ("5", "5"), ('["a",{"title":"q"}]', '["a",{}]'), ('{"anyOf":[{"enum":["b","a"]},{"type":"null"}],"description":"own"}', '{"description":"own","enum":["b","a"]}'),
]


def schema_forms(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", schemas.normalize_schema(_case([s for s, _ in SCHEMAS], F.col("p_partkey"))).alias("schema"))


#: tool_choice and tools of a request, how many tools stay, and whether it is refused.
CHOICES = [
    ('{"tools":[{"name":"a"},{"name":"b"}]}', 2, False), ('{"tools":[{"name":"a"}],"tool_choice":"none"}', None, False), ('{"tools":[{"name":"a"}],"tool_choice":{"type":"auto"}}', 1, False),
    ('{"tool_choice":{"type":"any"}}', None, True), ('{"tool_choice":"AUTO"}', None, True), ('{"tool_choice":null}', None, True), ('{"tools":{},"tool_choice":"auto"}', None, True), ('{"tools":null}', None, False),
]


def offered_tools(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    found = routing.offered_tools(F.parse_json(_case([c for c, *_ in CHOICES], F.col("event_id"))))
    return e.select("event_id", F.when(found["tools"].isNotNull(), F.size(found["tools"])).cast("long").alias("tools"), found["error"].isNotNull().alias("refused"))


def control_fields(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    body = F.to_json(F.struct(F.col("event_id").alias("max_tokens"), F.array("event_type").alias("stop_sequences"), F.lit("x").alias("model"), F.when(F.col("event_id") % 2 == 0, F.lit(40)).alias("top_k")))
    return e.select("event_id", wire.control_fields(F.parse_json(body)).alias("params"))


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


QUERIES = {
    f.__name__: f
    for f in (anthropic_blocks, openai_messages, system_texts, canonical_messages, argument_types, schema_forms, offered_tools, control_fields)
}

ORACLE_SQL = {
    "anthropic_blocks": _case_sql(BLOCKS),
    "openai_messages": _case_sql(PLAIN),
    "system_texts": f"SELECT event_id, replace({_listed([t for _, t in SYSTEMS])}[event_id % {len(SYSTEMS)} + 1], '@q', event_type) AS system FROM events",
    "canonical_messages": f"SELECT event_id, replace({_listed([t for _, t in CANONICAL])}[event_id % {len(CANONICAL)} + 1], '@', event_type) AS canonical FROM events",
    "argument_types": f"SELECT event_id, {_listed([t for _, t, _ in TYPED])}[event_id % {len(TYPED)} + 1] AS arguments, {_listed([t for *_, t in TYPED])}[event_id % {len(TYPED)} + 1] AS type_error FROM events",
    "schema_forms": f"SELECT p_partkey, {_listed([t for _, t in SCHEMAS])}[p_partkey % {len(SCHEMAS)} + 1] AS schema FROM part",
    "offered_tools": f"SELECT event_id, CAST({_listed([t for _, t, _ in CHOICES])}[event_id % {len(CHOICES)} + 1] AS BIGINT) AS tools, {_listed([t for *_, t in CHOICES])}[event_id % {len(CHOICES)} + 1] AS refused FROM events",
    "control_fields": """SELECT event_id, '{"max_tokens":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"top_k":40' ELSE '' END || ',"stop":["' || event_type || '"]}' AS params FROM events""",
}

"""Functions over request and response shapes: whitelists, tools, rewards, usage, chunks. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.text import number, rstrip, strip

#: Fields of a message that are kept, in this order.
MESSAGE_FIELDS = ("role", "content", "name", "tool_calls", "tool_call_id", "reasoning_content")
#: Content types that count as media.
MEDIA_TYPES = ("image", "image_url", "video", "video_url")
#: Sampling keys that the other wire format passes on, besides its stop sequences.
SAMPLING_KEYS = ("max_tokens", "temperature", "top_p", "top_k")
#: Languages of the multilingual tasks by file extension.
LANGUAGES = {"c": "C", "go": "Go", "java": "Java", "js": "JavaScript", "php": "PHP", "rb": "Ruby", "rs": "Rust"}


def _field(message: Column, name: str) -> Column:
    return F.try_variant_get(message, f"$.{name}", "variant")


def keep_fields(message: Column) -> Column:
    """A message (variant) with the known fields only, as JSON text; absent ones stay absent (PF5)."""
    return F.to_json(F.struct(*[_field(message, name).alias(name) for name in MESSAGE_FIELDS]))


def outbound_message(role: Column, content: Column, tool_calls: Column, tool_call_id: Column, name: Column) -> Column:
    """A message as it is sent: tool calls only of assistants, call id and name only of tools, nulls left out (PF6)."""
    return F.to_json(F.struct(
        role.alias("role"), content.alias("content"), F.when(role == "assistant", tool_calls).alias("tool_calls"),
        F.when(role == "tool", tool_call_id).alias("tool_call_id"), F.when(role == "tool", name).alias("name"),
    ))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string (PF17)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def set_default(fields: Column, name: str, value: Column) -> Column:
    """A map with ``name`` added where the key is missing; a key whose value is null stays (PF4)."""
    return F.when(F.map_contains_key(fields, F.lit(name)), fields).otherwise(F.map_concat(fields, F.create_map(F.lit(name), value)))


def chat_prompt(title: str, fields: dict[str, Column], millis: Column, content: Column) -> Column:
    """A chat event as a prompt (PF19): a title, a line per field, the time as it is given where it is, and the content.

    Names are indented by two and values start in one column; the content loses white space at its end only.
    """
    line = lambda name, value: F.concat(F.lit(f"  {name}:".ljust(18)), value)
    head = F.concat_ws("\n", F.lit(f"[{title}]"), *[line(*f) for f in fields.items()], line("create_time_ms", F.nullif(millis, F.lit(""))))
    return F.concat(head, F.lit("\n\nContent:\n"), rstrip(F.coalesce(content, F.lit(""))), F.lit("\n"))


def language_phrase(extension: Column) -> Column:
    """The language of a file extension, or words that stand in for it (JN6)."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension), F.lit("the project's"))


def provider_image(image: Column, registries: dict[str, str], tags: dict[str, str], literals: dict[str, str]) -> Column:
    """An image in a provider's own registry: known literals, else the known prefix replaced and its tag added (F2).

    An image that fits nothing is an error.
    """
    out = F.raise_error(F.concat(F.lit("no image for "), F.coalesce(image, F.lit("null")))).cast("string")
    for prefix, own in registries.items():
        out = F.when(image.startswith(prefix), F.concat(F.replace(image, F.lit(prefix), F.lit(own)), F.lit(tags.get(prefix, ":latest")))).otherwise(out)
    for literal, own in literals.items():
        out = F.when(image == literal, F.lit(own)).otherwise(out)
    return out


def convert_tool(tool: Column) -> Column:
    """A tool (variant) of one wire format as a function of the other, as JSON text.

    The description is kept if it is text; the schema becomes ``parameters``; other keys go.
    """
    text = F.when(F.schema_of_variant(_field(tool, "description")) == "STRING", F.try_variant_get(tool, "$.description", "string"))
    function = F.struct(F.try_variant_get(tool, "$.name", "string").alias("name"), text.alias("description"), _field(tool, "input_schema").alias("parameters"))
    return F.to_json(F.struct(F.lit("function").alias("type"), function.alias("function")))


def eval_script(header: str, *commands: Column) -> Column:
    """Commands behind a header, one per line; arrays of commands are spliced in before by ``concat`` (F32)."""
    return F.array_join(F.concat(F.array(F.lit(header)), *commands), "\n")


def authority(url: Column) -> Column:
    """``host:port`` of a URL, the scheme's own port where none is named."""
    host, scheme = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PROTOCOL"))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.concat(host, F.lit(":"), F.coalesce(F.nullif(port, F.lit("")), F.when(scheme == "https", "443").otherwise("80")))


def with_path(url: Column, path: str) -> Column:
    """A URL with its path replaced, without query or fragment."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(path))


def task_text(fail_to_pass: Column, pass_to_pass: Column, fallback: str, most: int = 3) -> Column:
    """The failing tests as a list, else the first of the passing ones, else a fallback line."""
    lines = lambda tests: F.array_join(F.transform(tests, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.when(F.size(fail_to_pass) > 0, lines(fail_to_pass)).when(F.size(pass_to_pass) > 0, lines(F.slice(pass_to_pass, 1, most))).otherwise(F.lit(fallback))


def first_content(messages: Column, role: str) -> Column:
    """Content of the first message of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]


def prompt_fault(messages: Column) -> Column:
    """Why a prompt is refused: over two messages, or nothing from the user; else null (F45). White space is something."""
    user = F.coalesce(first_content(messages, "user"), F.lit(""))
    return F.when(F.size(messages) > 2, "at most two messages").when(user == "", "no user message")


def comma_list(text: Column) -> Column:
    """Trimmed non-empty items of a comma list; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")


def paired(left: Column, right: Column) -> Column:
    """Items of two lists by position; lists of unequal length are an error (F46, JN9)."""
    zipped = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.when(F.size(left) == F.size(right), zipped).otherwise(F.raise_error(F.lit("lists differ in length")).cast("array<struct<left:string,right:string>>"))


def has_media(parts: Column) -> Column:
    """Whether a list of parts has media; null and text have none."""
    return F.coalesce(F.exists(parts, lambda p: F.coalesce(p["type"].isin(*MEDIA_TYPES), F.lit(False))), F.lit(False))


def reward_payload(reward: Column, acc: Column, finished: Column) -> Column:
    """JSON text with ``reward`` always, ``acc`` and ``finished`` where they are known."""
    rest = F.to_json(F.struct(acc.alias("acc"), finished.alias("finished")))
    rest = F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(rest, F.lit(2))))
    first = F.to_json(F.struct(reward.alias("reward")), {"ignoreNullFields": "false"})
    return F.concat(F.left(first, F.length(first) - 1), rest)


def reward_context(name: Column, extra: Column) -> Column:
    """(data_source, score): the reward's name or ``unknown``, the reported score or 0."""
    score = F.coalesce(F.try_element_at(extra, F.lit("reward_score")).try_cast("double"), F.lit(0.0))
    return F.struct(F.coalesce(name, F.lit("unknown")).alias("data_source"), score.alias("score"))


def overlay(base: Column, over: Column) -> Column:
    """Two maps as one, the second one's values winning."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def usage(prompt_ids: Column, completion_ids: Column) -> Column:
    """Token counts of a response and their sum."""
    prompt, completion = F.size(prompt_ids).cast("long"), F.size(completion_ids).cast("long")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"))


def control_fields(body: Column) -> Column:
    """Sampling fields (JSON text) of a request (variant): four keys and the stop sequences as ``stop``."""
    kept = [_field(body, key).alias(key) for key in SAMPLING_KEYS]
    return F.to_json(F.struct(*kept, _field(body, "stop_sequences").alias("stop")))


def unknown_parameters(given: Column, known: Column) -> Column:
    """Names that are given but not known, sorted (ST2)."""
    return F.array_sort(F.array_except(given, known))


def answer_chunks(text: Column, finish: Column, size: int = 64) -> Column:
    """A finished answer as the events of a stream: a role, pieces of text, and the finish reason (SS12)."""
    event = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.cast("string").alias("data"))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda at: event("content", F.substr(text, at, F.lit(size))))
    return F.concat(F.array(event("role", F.lit("assistant"))), pieces, F.array(event("finish", finish)))


def chat_response(ident: Column, created: Column, model: Column, content: Column, finish: Column, prompt: Column, completion: Column) -> Column:
    """JSON text of a finished answer in the one format (F52); ids and times are the caller's, so that reruns agree."""
    answer = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), answer.alias("message"), finish.alias("finish_reason"))
    counts = F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"))
    return F.to_json(F.struct(
        F.concat(F.lit("chatcmpl-"), ident).alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"),
        F.array(choice).alias("choices"), counts.alias("usage"),
    ))


def message_response(ident: Column, model: Column, content: Column, calls: Column, stop: Column, prompt: Column, completion: Column) -> Column:
    """JSON text of a finished answer in the other format (F52): blocks of text and of tool calls, at least one.

    ``calls`` is an array of structs with id, name and arguments (JSON text; anything but an object is ``{}``).
    """
    none = F.lit(None).cast("string")
    inputs = lambda a: F.when(F.schema_of_variant(F.try_parse_json(a)).startswith("OBJECT"), F.try_parse_json(a)).otherwise(F.parse_json(F.lit("{}")))
    block = lambda kind, text=none, ident=none, name=none, given=F.lit(None).cast("variant"): F.struct(F.lit(kind).alias("type"), text.alias("text"), ident.alias("id"), name.alias("name"), given.alias("input"))
    said = F.when(F.coalesce(content, F.lit("")) != "", F.array(block("text", content))).otherwise(F.array().cast("array<struct<type:string,text:string,id:string,name:string,input:variant>>"))
    used = F.coalesce(F.transform(calls, lambda c: block("tool_use", ident=c["id"], name=F.coalesce(c["name"], F.lit("tool")), given=inputs(c["arguments"]))), F.slice(said, 1, 0))
    blocks = F.concat(said, used)
    counts = F.struct(prompt.alias("input_tokens"), completion.alias("output_tokens"))
    body = F.struct(
        F.concat(F.lit("msg_"), ident).alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), model.alias("model"),
        F.when(F.size(blocks) > 0, blocks).otherwise(F.array(block("text", F.lit("")))).alias("content"), stop.alias("stop_reason"), counts.alias("usage"),
    )
    return F.to_json(body)


def coerced(value: Column, kind: Column) -> Column:
    """A tool argument (variant) as its declared type, null where it can't be (F39); unknown types take anything."""
    own, text = F.schema_of_variant(value), strip(F.try_variant_get(value, "$", "string"))
    is_number = (own == "BIGINT") | (own == "DOUBLE") | own.startswith("DECIMAL")
    whole = F.when(is_number & (F.try_variant_get(value, "$", "double") % 1 == 0) | (own == "BOOLEAN") | ((own == "STRING") & text.rlike(r"^[+-]?\d+$")), F.coalesce(F.try_variant_get(value, "$", "bigint"), text.try_cast("bigint")))
    real = F.when(is_number | (own == "BOOLEAN") | (own == "STRING"), F.when(own == "STRING", number(text)).otherwise(F.try_variant_get(value, "$", "double")))
    says = F.lower(text)
    truth = F.when((own == "BOOLEAN") | says.isin("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n"), says.isin("true", "1", "yes", "on", "t", "y"))
    return (
        F.when(kind == "integer", whole.cast("variant")).when(kind == "number", F.when(is_number, value).otherwise(real.cast("variant"))).when(kind == "boolean", truth.cast("variant"))
        .when(kind == "string", F.when(own == "STRING", value)).when(kind == "array", F.when(own.startswith("ARRAY"), value)).when(kind == "object", F.when(own.startswith("OBJECT"), value)).otherwise(value)
    )

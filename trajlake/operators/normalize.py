"""Lowering of both wire formats to one message form, and merging of configs: expressions over variants.

A body is JSON text of any shape. Lists of blocks become runs (blocks between two of a dividing kind), and runs become
messages; so one block list gives any number of messages within its row, without a shuffle. What can't be lowered gives
an error text instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.variants import field, is_null, is_object, is_string, items, let, members, no_text, string

MESSAGE = "struct<role:string,content:string,parts:string,name:string,tool_call_id:string,tool_calls:string,reasoning_content:string>"
#: Fixed value: the line that is cut from system text.
BILLING_LINE = r"(?im)^\s*x-anthropic-billing-header:[^\n]*\n?"


def message(role: str | Column, content: Column | None = None, **more: Column) -> Column:
    """A message: ``content`` is plain text, or ``parts`` is the JSON text of anything else; tool calls are JSON text."""
    role = F.lit(role) if isinstance(role, str) else role
    content = content if content is not None else no_text()
    rest = [more.get(n, no_text()).alias(n) for n in ("parts", "name", "tool_call_id", "tool_calls", "reasoning_content")]
    return F.struct(role.alias("role"), content.alias("content"), *rest).cast(MESSAGE)


def _type(block: Column) -> Column:
    return F.coalesce(string(field(block, "type")), F.lit(""))


def _is(block: Column, *types: str) -> Column:
    return _type(block).isin(*types)


def _text(block: Column) -> Column:
    """A block's text: empty where it is missing, null where it is no string."""
    return let(field(block, "text"), lambda t: F.when(t.isNull(), F.lit("")).otherwise(string(t)))


def _texts(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: _is(b, "text")), _text)


def runs(blocks: Column, divides: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(run, divider, number)`` over the runs between dividing blocks, flattened; the last run has a null divider."""
    cuts = F.filter(F.transform(blocks, lambda b, i: F.when(divides(b), i)), lambda i: i.isNotNull())

    def each(cuts: Column) -> Column:
        start = lambda k: F.coalesce(F.get(cuts, k - 1) + 1, F.lit(0))
        run = lambda k: F.slice(blocks, start(k) + 1, F.coalesce(F.get(cuts, k), F.size(blocks)) - start(k))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: let(run(k), lambda own: let(F.get(blocks, F.get(cuts, k)), lambda divider: make(own, divider, k)))))

    return let(cuts, each)


def _none() -> Column:
    return F.array().cast(f"array<{MESSAGE}>")


def image_url(block: Column) -> Column:
    """URL of an image block: data as a data URL, a URL as it is, else null."""
    get = lambda name: string(field(field(block, "source"), name))
    data = F.concat(F.lit("data:"), get("media_type"), F.lit(";base64,"), get("data"))
    return F.when(get("type") == "base64", data).when(get("type") == "url", get("url"))


def _part(block: Column) -> Column:
    image = _is(block, "image")
    return F.struct(
        F.when(image, F.struct(image_url(block).alias("url"))).alias("image_url"), F.when(~image, _text(block)).alias("text"),
        F.when(image, "image_url").otherwise("text").alias("type"),
    )


def system_text(content: Column) -> Column:
    """Text of a system entry (variant), empty ones of its blocks left out, without the billing line, trimmed."""
    blocks = F.array_join(F.filter(_texts(items(content)), lambda t: t != ""), "\n")
    return F.regexp_replace(F.regexp_replace(F.coalesce(string(content), blocks, F.lit("")), BILLING_LINE, ""), r"^\s+|\s+$", "")


def system_fault(content: Column) -> Column:
    bad = F.exists(items(content), lambda b: ~_is(b, "text") | _text(b).isNull())
    known = content.isNull() | is_null(content) | is_string(content) | items(content).isNotNull()
    return F.when(~known, "system must be text or blocks").when(bad, "system blocks must be text")


def tool_result_messages(block: Column) -> Column:
    """Messages of a tool result (F16): text as the tool's, each image as a user's, behind at least one of the tool's."""
    call, content = string(field(block, "tool_use_id")), field(block, "content")
    tool = lambda text: F.array(message("tool", text, tool_call_id=call))

    def segment(run: Column, image: Column, number: Column) -> Column:
        said = (F.size(run) > 0) | (number == 0)  # the first run speaks up even when it is empty
        text = F.when(said, tool(F.array_join(F.transform(run, _text), "\n"))).otherwise(_none())
        shown = F.array(message("user", parts=F.to_json(F.array(_part(image)))))
        return F.concat(text, F.when(image.isNotNull(), shown).otherwise(_none()))

    return let(items(content), lambda blocks: F.when(blocks.isNotNull(), runs(blocks, lambda b: _is(b, "image"), segment)).otherwise(tool(F.coalesce(string(content), F.lit("")))))


def user_messages(blocks: Column) -> Column:
    """Messages of a user's blocks (F15): runs between tool results, as one text where all of it is text."""

    def segment(run: Column, result: Column, _: Column) -> Column:
        plain = message("user", F.array_join(F.transform(run, _text), "\n"))
        mixed = message("user", parts=F.to_json(F.transform(run, _part)))
        own = F.when(F.size(run) == 0, _none()).otherwise(F.array(F.when(F.exists(run, lambda b: _is(b, "image")), mixed).otherwise(plain)))
        return F.concat(own, F.when(result.isNotNull(), tool_result_messages(result)).otherwise(_none()))

    return runs(blocks, lambda b: _is(b, "tool_result"), segment)


def _block_fault(block: Column) -> Column:
    image = lambda b: F.when(_is(b, "image") & image_url(b).isNull(), "image without a source")
    call, content = field(block, "tool_use_id"), field(block, "content")
    inner = F.coalesce(
        F.when(~F.coalesce(string(call) != "", F.lit(False)), "tool result without an id"),
        F.when(~(content.isNull() | is_null(content) | is_string(content) | items(content).isNotNull()), "tool result must be text or blocks"),
        F.when(F.exists(items(content), lambda b: ~_is(b, "text", "image")), "unknown tool result block"),
        F.when(F.exists(items(content), lambda b: _is(b, "text") & _text(b).isNull()), "text must be a string"),
        F.get(F.filter(F.transform(items(content), image), lambda x: x.isNotNull()), F.lit(0)),
    )
    return F.coalesce(
        F.when(~_is(block, "text", "image", "tool_result"), "unknown user block"), F.when(_is(block, "text") & _text(block).isNull(), "text must be a string"),
        image(block), F.when(_is(block, "tool_result"), inner),
    )


def user_fault(content: Column) -> Column:
    first = F.get(F.filter(F.transform(items(content), _block_fault), lambda x: x.isNotNull()), F.lit(0))
    return F.when(content.isNotNull() & ~is_string(content) & items(content).isNull(), "user content must be text or blocks").otherwise(first)


def assistant_message(content: Column) -> Column:
    """An assistant's text and tool calls (F17); thinking is left out."""
    call = lambda b: F.struct(
        F.struct(F.coalesce(field(b, "input"), F.parse_json(F.lit("{}"))).alias("arguments"), string(field(b, "name")).alias("name")).alias("function"),
        string(field(b, "id")).alias("id"), F.lit("function").alias("type"),
    )
    calls = F.transform(F.filter(items(content), lambda b: _is(b, "tool_use")), call)
    text = F.coalesce(string(content), F.array_join(_texts(items(content)), "\n"), F.lit(""))
    return message("assistant", text, tool_calls=F.when(F.size(calls) > 0, F.to_json(calls)))


def assistant_fault(content: Column) -> Column:
    use = lambda b: F.coalesce(
        F.when(~_is(b, "text", "tool_use", "thinking"), "unknown assistant block"),
        F.when(_is(b, "text") & _text(b).isNull(), "text must be a string"),
        F.when(_is(b, "tool_use") & ~F.coalesce(string(field(b, "id")) != "", F.lit(False)), "tool use without an id"),
        F.when(_is(b, "tool_use") & ~is_string(field(b, "name")), "tool use without a name"),
        F.when(_is(b, "tool_use") & field(b, "input").isNotNull() & ~is_object(field(b, "input")), "tool input must be an object"),
    )
    first = F.get(F.filter(F.transform(items(content), use), lambda x: x.isNotNull()), F.lit(0))
    return F.when(content.isNotNull() & ~is_string(content) & items(content).isNull(), "assistant content must be text or blocks").otherwise(first)


def _entries(v: Column) -> Column:
    """The raw messages as (at, role, content, note); ``note`` is a system entry's reminder, null without text."""
    text = lambda m: F.when(string(field(m, "role")) == "system", F.nullif(system_text(field(m, "content")), F.lit("")))
    note = lambda m: F.concat(F.lit("<system-reminder>\n"), text(m), F.lit("\n</system-reminder>"))
    return F.transform(items(field(v, "messages")), lambda m, i: F.struct(i.alias("at"), string(field(m, "role")).alias("role"), field(m, "content").alias("content"), note(m).alias("note")))


def _folded(entries: Column) -> Column:
    """Raw messages without system entries, as (role, content, before, after).

    A reminder goes to the user message before it (``after`` that one's own content), else to the next one (``before``
    its content), else to a user message of its own at the end.
    """
    users = F.transform(F.filter(entries, lambda e: e["role"] == "user"), lambda e: e["at"])
    notes = lambda low, high: F.transform(F.filter(entries, lambda e: e["note"].isNotNull() & (e["at"] > low) & (e["at"] < high)), lambda e: e["note"])
    last = F.lit(1 << 30)
    no_notes = F.array().cast("array<string>")

    def rest(users: Column) -> Column:
        following = lambda at: F.coalesce(F.get(F.filter(users, lambda u: u > at), F.lit(0)), last)
        own = F.transform(F.filter(entries, lambda e: ~F.coalesce(e["role"] == "system", F.lit(False))), lambda e: F.struct(
            e["role"].alias("role"), e["content"].alias("content"),
            F.when(e["at"] == F.get(users, F.lit(0)), notes(F.lit(-1), e["at"])).otherwise(no_notes).alias("before"),
            F.when(e["role"] == "user", notes(e["at"], following(e["at"]))).otherwise(no_notes).alias("after"),
        ))
        lone = notes(F.lit(-1), last)
        end = F.struct(F.lit("user").alias("role"), F.array_join(lone, "\n").cast("variant").alias("content"), no_notes.alias("before"), no_notes.alias("after"))
        return F.concat(own, F.when((F.size(users) == 0) & (F.size(lone) > 0), F.array(end)).otherwise(F.slice(own, 1, 0)))

    return let(users, rest)


def _lowered(entry: Column) -> Column:
    """Messages of a folded entry."""
    content, before, after = entry["content"], F.array_join(entry["before"], "\n"), entry["after"]
    as_block = lambda text: F.to_variant_object(F.struct(text.alias("text"), F.lit("text").alias("type")))
    lead = F.when(F.size(entry["before"]) > 0, F.array(as_block(before))).otherwise(F.array().cast("array<variant>"))
    blocks = F.concat(lead, items(content), F.transform(after, as_block))
    pieces = F.concat(F.array(F.nullif(before, F.lit("")), F.nullif(F.coalesce(string(content), F.lit("")), F.lit(""))), after)
    plain = F.array(message("user", F.array_join(F.array_compact(pieces), "\n")))
    user = F.when(items(content).isNull(), plain).otherwise(let(blocks, user_messages))
    return F.when(entry["role"] == "user", user).otherwise(F.array(assistant_message(content)))


def _fault(entry: Column) -> Column:
    known = F.when(entry["role"] == "user", user_fault(entry["content"])).when(entry["role"] == "assistant", assistant_fault(entry["content"]))
    return F.when(~F.coalesce(entry["role"].isin("user", "assistant"), F.lit(False)), "unknown role").otherwise(known)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def lower_anthropic(body: Column) -> Column:
    """(messages, error) of a request of the one wire format, from its JSON text."""

    def lowered(v: Column) -> Column:
        raw, system = items(field(v, "messages")), field(v, "system")

        def result(folded: Column) -> Column:
            error = F.coalesce(
                F.when(~F.coalesce(is_object(v), F.lit(False)), "body must be an object"),
                F.when(raw.isNull(), "messages must be a non-empty list"),
                F.when(F.exists(raw, lambda m: ~is_object(m)), "messages must be objects"),
                _first(F.transform(F.filter(raw, lambda m: F.coalesce(string(field(m, "role")) == "system", F.lit(False))), lambda m: system_fault(field(m, "content")))),
                F.when(F.size(folded) == 0, "messages must be a non-empty list"),
                _first(F.transform(folded, _fault)),
                system_fault(system),
            )
            lead = F.when(system_text(system) != "", F.array(message("system", system_text(system)))).otherwise(_none())
            done = F.concat(lead, F.flatten(F.transform(folded, _lowered)))
            return F.struct(F.when(error.isNull(), done).alias("messages"), error.alias("error"))

        return let(_entries(v), lambda entries: let(_folded(entries), result))

    return let(F.try_parse_json(body), lowered)


def parsed_calls(calls: Column) -> Column:
    """Tool calls (variant list) as JSON text, arguments that are JSON text parsed, all other fields kept."""
    arguments = lambda a: F.when(is_string(a), F.coalesce(F.try_parse_json(string(a)), a)).otherwise(a)
    function = lambda f: F.to_variant_object(F.transform_values(members(f), lambda k, x: F.when(k == "arguments", arguments(x)).otherwise(x)))
    call = lambda c: F.to_variant_object(F.transform_values(members(c), lambda k, x: F.when(k == "function", function(x)).otherwise(x)))
    return F.to_json(F.transform(items(calls), call))


def openai_message(m: Column) -> Column:
    """A message (variant) with its known fields (PF5, F11): null content is empty, ids become text."""
    content = field(m, "content")
    text = F.when(content.isNull() | is_null(content), F.lit("")).otherwise(string(content))
    ident = field(m, "tool_call_id")
    return message(
        string(field(m, "role")), text, parts=F.when(text.isNull(), F.to_json(content)), name=string(field(m, "name")),
        tool_call_id=F.coalesce(string(ident), F.to_json(ident)), tool_calls=F.when(field(m, "tool_calls").isNotNull(), parsed_calls(field(m, "tool_calls"))),
        reasoning_content=string(field(m, "reasoning_content")),
    )


def openai_fault(m: Column) -> Column:
    content, calls, name, thought = (field(m, n) for n in ("content", "tool_calls", "name", "reasoning_content"))
    return F.coalesce(
        F.when(~is_object(m), "messages must be objects"),
        F.when(~F.coalesce(string(field(m, "role")) != "", F.lit(False)), "a message needs a role"),
        F.when(~(content.isNull() | is_null(content) | is_string(content) | items(content).isNotNull() | is_object(content)), "content must be text, a list or an object"),
        F.when(name.isNotNull() & ~is_string(name), "name must be text"),
        F.when(calls.isNotNull() & items(calls).isNull(), "tool_calls must be a list"),
        F.when(F.exists(items(calls), lambda c: ~is_object(c) | ~F.coalesce(is_object(field(c, "function")), F.lit(False))), "a tool call needs a function"),
        F.when(thought.isNotNull() & ~is_null(thought) & ~is_string(thought), "reasoning_content must be text or null"),
    )


def lower_openai(body: Column) -> Column:
    """(messages, error) of a request of the other wire format, from its JSON text."""

    def lowered(v: Column) -> Column:
        raw = items(field(v, "messages"))
        error = F.coalesce(
            F.when(~F.coalesce(is_object(v), F.lit(False)), "body must be an object"),
            F.when(F.coalesce(F.size(raw), F.lit(0)) < 1, "messages must be a non-empty list"),
            _first(F.transform(raw, openai_fault)),
        )
        return F.struct(F.when(error.isNull(), F.transform(raw, openai_message)).alias("messages"), error.alias("error"))

    return let(F.try_parse_json(body), lowered)


def normalize(requests: DataFrame, wire: str = "wire", body: str = "body") -> DataFrame:
    """``requests`` with ``messages`` and ``error`` in place of their body; requests of each format go their own way."""
    other = F.coalesce(F.col(wire) != "anthropic", F.lit(True))
    kept = [F.col(f"`{c}`") for c in requests.columns if c not in (body, "messages", "error")]
    one = requests.where(~other).select(*kept, lower_anthropic(F.col(body)).alias("_n"))
    two = requests.where(other).select(*kept, lower_openai(F.col(body)).alias("_n"))
    return one.unionByName(two).select(*kept, "_n.messages", "_n.error")

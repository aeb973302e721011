"""Functions over chat messages: canonical form, hashes, costs and code maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.variants import is_object, items, members, string

#: Finish reasons of backends, stop reasons of the other wire format, error types by status.
FINISH_REASONS = {"completed": "stop", "stop": "stop", "matched_stop": "stop", "eos": "stop", "length": "length", "max_tokens": "length", "aborted": "stop", "abort": "stop"}
STOP_REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "function_call": "tool_use", "content_filter": "refusal"}


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def finish_reason(stop: Column) -> Column:
    """Unknown reasons pass, null is ``stop``."""
    return F.when(stop.isNull(), F.lit("stop")).otherwise(_lookup(stop, FINISH_REASONS, stop))


def stop_reason(finish: Column) -> Column:
    """Unknown and null reasons are ``end_turn``."""
    return F.when(finish.isNull(), F.lit("end_turn")).otherwise(_lookup(finish, STOP_REASONS, F.lit("end_turn")))


def error_type(status: Column, wire: str = "openai") -> Column:
    """Error type of an HTTP status."""
    if wire == "anthropic":
        return F.when(status.isin(400, 409), F.lit("invalid_request_error")).otherwise(F.lit("api_error"))
    return F.when(status == 409, F.lit("conflict_error")).when((status >= 400) & (status < 500), F.lit("invalid_request_error")).otherwise(F.lit("internal_server_error"))


def message_digest(role: Column, content: Column) -> Column:
    """SHA-256 of a plain message's canonical JSON: keys in order, nothing but the fields."""
    return F.sha2(F.to_json(F.struct(content.alias("content"), role.alias("role"))), 256)


def canonical_message(message: Column) -> Column:
    """A message (variant) as it is compared (F5): without ids of calls, arguments by value where they are JSON."""

    def tagged(arguments: Column) -> Column:
        kind = F.when((items(arguments).isNotNull()) | is_object(arguments), F.struct(F.lit("json").alias("kind"), arguments.alias("value")))
        text = F.struct(F.lit("json").alias("kind"), F.try_parse_json(string(arguments)).alias("value"))
        raw = F.struct(F.lit("raw").alias("kind"), arguments.alias("value"))
        return F.to_variant_object(F.coalesce(kind, F.when(F.try_parse_json(string(arguments)).isNotNull(), text), raw))

    function = lambda f: F.to_variant_object(F.transform_values(members(f), lambda k, x: F.when(k == "arguments", tagged(x)).otherwise(x)))
    call = lambda c: F.to_variant_object(F.transform_values(F.map_filter(members(c), lambda k, _: k != "id"), lambda k, x: F.when((k == "function") & is_object(x), function(x)).otherwise(x)))
    calls = lambda x: F.when(items(x).isNotNull(), F.to_variant_object(F.transform(items(x), call))).otherwise(x)
    own = F.map_filter(members(message), lambda k, _: k != "tool_call_id")
    return F.to_variant_object(F.transform_values(own, lambda k, x: F.when(k == "tool_calls", calls(x)).otherwise(x)))


def prefix_digests(digests: Column) -> Column:
    """Hash of each prefix of an ordered array of message digests, each over the one before."""
    step = lambda acc, d: F.array_append(acc, F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit("\n"), d), 256))
    return F.aggregate(digests, F.array().cast("array<string>"), step)


def message_cost(*texts: Column, count: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a message: those of each text that is there, and 4 (AG15).

    ``count`` gives a text's tokens, such as the size of its ids under a vocabulary; without it, a quarter of its
    characters, at least 1.
    """
    own = count or (lambda t: F.greatest(F.lit(1), F.floor(F.length(t) / 4)))
    cost = F.lit(4)
    for text in texts:
        cost = cost + F.when(text.isNotNull(), own(text)).otherwise(0)
    return cost.cast("long")


def canonical_arguments(value: Column) -> Column:
    """(kind, value): JSON arguments in sorted form, or the raw text that is none."""
    parsed = F.try_parse_json(value)
    return F.struct(F.when(parsed.isNotNull(), F.lit("json")).otherwise(F.lit("raw")).alias("kind"), F.coalesce(F.to_json(parsed), value).alias("value"))


def object_arguments(value: Column) -> Column:
    """JSON objects in sorted form; anything else is ``{}``."""
    parsed = F.try_parse_json(value)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(F.lit("{}"))


def merge_params(defaults: Column, payload: Column, allowed: list[str]) -> Column:
    """Defaults under the payload's allowed keys (PF7); without nulls (PF9)."""
    own = F.map_filter(payload, lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k)), own)

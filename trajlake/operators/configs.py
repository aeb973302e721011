"""Deep merge of JSON configs of any depth: a config is opened level by level in its own row, and written from its leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.variants import is_null, let, members

LEAVES, OPEN = "array<struct<path:array<string>,leaf:string>>", "array<struct<path:array<string>,layers:array<variant>>>"


def _children(x: Column) -> Column:
    """What lies one level below an object: each member's path and its values by layer, lowest first."""
    below = lambda maps: F.transform(
        F.array_distinct(F.flatten(F.transform(maps, lambda m: F.map_keys(m)))),
        lambda name: F.struct(F.concat(x["path"], F.array(name)).alias("path"), F.filter(F.transform(maps, lambda m: F.try_element_at(m, name)), lambda v: v.isNotNull()).alias("layers")),
    )
    # Layers below one that is no object are out of sight.
    seen = F.aggregate(x["layers"], F.array().cast("array<map<string,variant>>"), lambda acc, v: let(members(v), lambda m: F.when(m.isNotNull(), F.concat(acc, F.array(m))).otherwise(F.array().cast("array<map<string,variant>>"))))
    return let(seen, below)


def merged_leaves(layers: Column, levels: Column) -> Column:
    """(path, leaf) of JSON values (variants) laid on each other, lowest first: what isn't an object, by its path, as JSON.

    Objects merge member by member; of anything else, lists and null too, the upper one is seen. An object without
    members is a leaf where no layer gives it any. ``levels`` is at least the number of nested levels; once nothing is
    left to open, further ones cost nothing.
    """
    start = F.struct(F.array(F.struct(F.array().cast("array<string>").alias("path"), layers.alias("layers"))).cast(OPEN).alias("open"), F.array().cast(LEAVES).alias("done"))

    def opened(acc: Column, _: Column) -> Column:
        each = F.transform(acc["open"], lambda x: F.struct(x["path"].alias("path"), F.element_at(x["layers"], -1).alias("top"), _children(x).alias("children")))
        ended = lambda xs: F.transform(F.filter(xs, lambda x: F.size(x["children"]) == 0), lambda x: F.struct(x["path"].alias("path"), F.to_json(x["top"]).alias("leaf")))
        step = let(each, lambda xs: F.struct(F.flatten(F.transform(xs, lambda x: x["children"])).cast(OPEN).alias("open"), F.concat(acc["done"], ended(xs)).cast(LEAVES).alias("done")))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(step)

    return F.aggregate(F.sequence(F.lit(0), levels), start, opened)["done"]


def assembled(leaves: Column) -> Column:
    """The JSON text of a config's leaves, (path, leaf), keys sorted.

    Sorted by path, a leaf says which objects end before it and which begin: those in which its path and the one before
    differ.
    """
    quoted = lambda s: let(F.to_json(F.array(s)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))

    def written(acc: Column, x: Column) -> Column:
        before, path = acc["path"], x["path"]
        shared = F.aggregate(F.sequence(F.lit(1), F.least(F.size(before), F.size(path))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(before, i - 1) == F.get(path, i - 1)), i).otherwise(n))
        shared = F.when(F.least(F.size(before), F.size(path)) > 0, shared).otherwise(0)

        def told(n: Column) -> Column:
            closed = F.repeat(F.lit("}"), F.greatest(F.size(before) - 1 - n, F.lit(0)))
            opened = F.array_join(F.transform(F.slice(path, n + 1, F.greatest(F.size(path) - 1 - n, F.lit(0))), lambda s: F.concat(quoted(s), F.lit(":{"))), "")
            comma = F.when(F.size(before) > 0, ",").otherwise("")
            name = F.when(F.size(path) > 0, F.concat(quoted(F.element_at(path, -1)), F.lit(":"))).otherwise("")
            return F.concat(closed, comma, opened, name, x["leaf"])

        return F.struct(path.alias("path"), F.concat(acc["parts"], F.array(let(shared, told))).alias("parts"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("parts"))

    def whole(r: Column) -> Column:
        text, depth = F.array_join(r["parts"], ""), F.size(r["path"])
        return F.when(depth == 0, text).otherwise(F.concat(F.lit("{"), text, F.repeat(F.lit("}"), depth)))

    return let(F.aggregate(F.array_sort(leaves), start, written), whole)


def merge_configs(rows: DataFrame, key: str, base: str, over: str, runtime: str | None = None) -> DataFrame:
    """(key, config): JSON objects ``base`` and ``over`` merged (F8), as JSON text with sorted keys.

    Objects merge at any depth; anything else, lists and null too, is replaced. What is not null of the object
    ``runtime`` wins under ``agent.model`` (F9). ``key`` goes along. Null counts as an object without members; numbers
    print as variants do (2.0 as 2). Each row is merged by itself: nothing is shuffled, and the driver runs no job.
    """
    parsed = lambda c: F.coalesce(F.parse_json(F.col(c)), F.parse_json(F.lit("{}")))
    layers, texts = [parsed(base), parsed(over)], [base, over]
    if runtime is not None:
        given = F.map_filter(members(parsed(runtime)), lambda _, v: ~is_null(v))
        bound = let(given, lambda g: F.when(F.size(g) > 0, F.to_variant_object(F.struct(F.struct(g.alias("model")).alias("agent")))))
        layers, texts = [*layers, bound], [*texts, runtime]
    levels = sum((F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^{]+", "")) for c in texts), F.lit(3))
    found = merged_leaves(F.filter(F.array(*layers), lambda v: v.isNotNull()), levels)
    return rows.select(F.col(key), assembled(found).alias("config"))

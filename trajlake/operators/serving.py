"""Joins and aggregates around sessions: tool calls and their status, passthrough fields, failures, load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions import text, wire


def call_status(attempted: DataFrame, executed: DataFrame, key: list[str]) -> DataFrame:
    """Attempted tool calls with the status of their execution; without one they were rejected (JN8)."""
    return attempted.join(executed.select(*key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("rejected")))


def with_sample_fields(trajectories: DataFrame, samples: DataFrame, fields: list[str], uid: str = "uid") -> DataFrame:
    """Trajectories with fields of their sample (JN10): one shuffle on the uid, the sample's other columns pruned."""
    return trajectories.join(samples.select(uid, *fields), uid)


def queue_status(prompts: DataFrame) -> DataFrame:
    """(uid, status) as the queue would hold it: finished where any session succeeded (IO7)."""
    return prompts.select("uid", F.when(F.col("success") > 0, "finished").otherwise("failure").alias("status"))


def first_reasons(failures: DataFrame, key: str, order: Column, reason: Column, most: int = 3) -> DataFrame:
    """The first ``most`` failure reasons of each key, in order (SL3). Only those rows are gathered."""
    ranked = failures.select(key, order.alias("_o"), reason.alias("_r")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_o", "_r"))).where(F.col("_n") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_r"))), lambda x: x["_r"]).alias("reasons"))


def sort_keys(records: DataFrame, uid: str = "uid", session: str = "session") -> DataFrame:
    """Records in the order of their keys, sessions as text (SL2)."""
    return records.orderBy(uid, F.col(session).cast("string"))


def least_loaded(load: DataFrame, pool: str) -> DataFrame:
    """The worker of each pool with the least load, the lowest index on ties (WN11): a partial aggregate, no sort."""
    return load.groupBy(pool).agg(F.min_by("worker", F.struct("active", "worker")).alias("worker"), F.min("active").alias("active"))


def reject_duplicates(configs: DataFrame, key: str = "name") -> DataFrame:
    """``configs`` as they are; a key that occurs twice is an error (ST4)."""
    twice = configs.groupBy(key).count().where("count > 1").select(key).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return configs


def argument_faults(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool calls with ``error``: arguments that are no object, unknown tools, unknown or missing parameters.

    ``calls`` has tool and arguments (JSON text; null and blank are no arguments); ``tools`` has tool, known and
    required (arrays of names). The first fault in that order is reported, with the names sorted.
    """
    blank = text.is_blank(F.col("arguments"))
    parsed = F.try_parse_json(F.when(blank, "{}").otherwise(F.col("arguments")))
    given = F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>"))
    rows = calls.join(tools.withColumn("_known_tool", F.lit(True)), "tool", "left")
    unknown, missing = wire.unknown_parameters(given, F.col("known")), F.array_sort(F.array_except("required", given))
    error = F.coalesce(
        F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "arguments must be a JSON object"),
        F.when(F.col("_known_tool").isNull(), F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("null")))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown parameters: "), F.array_join(unknown, ", "))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing parameters: "), F.array_join(missing, ", "))),
    )
    return rows.withColumn("error", error).drop("_known_tool", "known", "required")


def coerced_arguments(calls: DataFrame, types: DataFrame) -> DataFrame:
    """Tool calls with their arguments as the declared types, or ``type_error`` with the names that can't be.

    ``calls`` has tool and arguments (JSON text of an object; null and blank are none); ``types`` has tool and types, a
    map from names to JSON schema types. Undeclared arguments pass.
    """
    given = F.from_json(F.to_json(F.try_parse_json(F.when(text.is_blank(F.col("arguments")), "{}").otherwise(F.col("arguments")))), "map<string,variant>")
    rows = calls.join(types, "tool", "left").withColumn("_given", given)
    own = F.transform_values("_given", lambda k, v: wire.coerced(v, F.coalesce(F.try_element_at("types", k), F.lit("any"))))
    rows = rows.withColumn("_own", own)
    bad = F.array_sort(F.map_keys(F.map_filter("_own", lambda k, v: v.isNull())))
    error = F.when(F.size(bad) > 0, F.concat(F.lit("wrong types: "), F.array_join(bad, ", ")))
    return rows.withColumn("type_error", error).withColumn("arguments", F.when(error.isNull(), F.to_json(F.to_variant_object("_own")))).drop("types", "_given", "_own")


def session_owner(sessions: DataFrame, owners: DataFrame, key: str = "session") -> DataFrame:
    """Sessions with their ``owner`` (JN12), or ``error`` where none is known: an equi-join that Spark deals by session."""
    found = sessions.join(owners.select(key, "owner"), key, "left")
    return found.withColumn("error", F.when(F.col("owner").isNull(), F.concat(F.lit("unknown session: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))


def resolve(names: DataFrame, registry: DataFrame, kind: str, name: str = "name") -> DataFrame:
    """``names`` with the ``target`` that a registry of (kind, name, target) has for them, or ``error`` (UX2 to UX6).

    A registry is a dimension; a name that it has twice for a kind is an error.
    """
    own = reject_duplicates(registry.where(F.col("kind") == kind).select(F.col("name").alias(name), "target"), name)
    found = names.join(own, name, "left")
    return found.withColumn("error", F.when(F.col("target").isNull(), F.concat(F.lit(f"unknown {kind}: "), F.coalesce(name, F.lit("null")))))


def known_names(*registries: DataFrame) -> DataFrame:
    """All names of several registries, each once (ST3)."""
    out = registries[0].select("name")
    for r in registries[1:]:
        out = out.unionByName(r.select("name"))
    return out.distinct()


def duplicate_keys(configs: DataFrame, key: str = "name") -> DataFrame:
    """Keys that occur more than once, with their number (ST4)."""
    return configs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def scoring_input(trajectories: DataFrame, fields: list[str]) -> DataFrame:
    """What a scorer is given: all ids, a mask of ones, the turn count and passed-through fields."""
    ids = F.concat("prompt_ids", "response_ids")
    return trajectories.select(*fields, ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1).cast("tinyint")).alias("attention_mask"), "num_turns")


def override_scores(trajectories: DataFrame, scorer: Callable[[DataFrame], DataFrame], session: list[str]) -> DataFrame:
    """Trajectories with ``score`` from a scorer of one's own, one row per session; none is an unscored session (UX7)."""
    scores = scorer(trajectories).select(*session, F.col("score").cast("double").alias("score"))
    return trajectories.drop("score").join(scores, session, "left")

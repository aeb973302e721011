"""Task rows and their routing: config defaults, runners, rollouts, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.text import image_name
from trajlake.functions.variants import field, is_null, is_object, is_string, items, kind, let, string
from trajlake.functions.wire import convert_tool, language_phrase
from trajlake.session import cut

#: Rows and bytes of a dimension that is broadcast at most; a larger one is joined as Spark sees fit.
MOST_ROWS, MOST_BYTES = 10_000, 8 << 20


def small(dimension: DataFrame) -> DataFrame:
    """``dimension`` marked for broadcast, once its rows and the bytes of their text form have been counted."""
    rows = dimension.limit(MOST_ROWS + 1).select(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in dimension.columns]))).alias("n"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dimension) if size["rows"] <= MOST_ROWS and size["bytes"] <= MOST_BYTES else dimension


def with_defaults(samples: DataFrame, configs: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) samples by config name (JN1). Without any config all samples pass unchanged."""
    if configs.isEmpty():
        return samples, samples.limit(0)
    configs = small(configs)
    return samples.join(configs, name), samples.join(configs, name, "left_anti")


def route(samples: DataFrame, runners: DataFrame, name: str = "agent_name") -> DataFrame:
    """Samples with their runner; a single registered runner takes all, else a miss gives an error text (JN2)."""
    first = runners.limit(2).collect()
    if len(first) == 1:
        return samples.withColumns({"runner": F.lit(first[0]["runner"]), "error": F.lit(None).cast("string")})
    found = samples.join(small(runners), name, "left")
    return found.withColumn("error", F.when(F.col("runner").isNull(), F.concat(F.lit("unknown agent: "), F.coalesce(name, F.lit("null")))))


def expand_rollouts(tasks: DataFrame, n: int) -> DataFrame:
    """Each task ``n`` times, with its rollout number (JN13)."""
    return tasks.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else tasks.withColumn("rollout", F.lit(0)).limit(0)


def assign_workers(tasks: DataFrame, order: list[Column], workers: int) -> DataFrame:
    """Round robin over an order of all tasks (WN9): ranks within ranges of the order, and the ranges' sizes before them.

    The ranges are checkpointed, so that ranks and sizes are of the same ones whatever is run again.
    """
    parted = cut(tasks.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    ranked = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    starts = parted.groupBy("_p").count().withColumn("_s", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    return ranked.join(F.broadcast(starts), "_p").withColumn("worker", F.pmod(F.col("_s") + F.col("_r") - 1, F.lit(workers))).drop("_p", "_r", "_s")


def split_budget(total: Column, workers: Column) -> Column:
    """An array with each worker's share, as even as it goes, the first ones taking what is left over (WN10)."""
    share = lambda i: F.floor(total / workers) + (i < total % workers).cast("long")
    return F.when(workers > 0, F.transform(F.sequence(F.lit(0).cast("long"), workers.cast("long") - 1), share)).otherwise(F.array().cast("array<long>"))


def sampling_params(validate: Column, do_sample: Column, rollout: Column, val: Column) -> Column:
    """Parameters of a partition: validation's own, greedy ones where sampling is off, else the rollout's (PF8)."""
    greedy = F.struct(F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p"), F.lit(-1).alias("top_k"))
    return F.when(validate, val).when(do_sample.eqNullSafe(F.lit(False)), greedy).otherwise(rollout)


def task_rows(instances: DataFrame, *, source: str, prompt: Column, metadata: list[str]) -> DataFrame:
    """Nested task rows: data_source, prompt messages and tools_kwargs (PF1, PF2)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    task = F.struct(F.lit(source).alias("name"), F.struct(image_name(F.col("instance_id")).alias("image")).alias("sandbox"), F.to_json(F.struct(*metadata)).alias("metadata"))
    return instances.select(F.lit(source).alias("data_source"), F.array(message("system", F.lit("You are a helpful assistant.")), message("user", prompt)).alias("prompt"), F.struct(task.alias("task")).alias("tools_kwargs"))


def multilingual_task_rows(instances: DataFrame, extensions: DataFrame, *, source: str, prompt: Callable[[Column], Column], metadata: list[str]) -> DataFrame:
    """Task rows whose prompt names the language of the repository (PF3, JN6).

    ``extensions`` has repo and extension, one row per repository; a repository that it lacks is an error. ``prompt``
    makes the prompt from the language's phrase.
    """
    found = instances.join(small(extensions.select("repo", F.col("extension").alias("_extension"), F.lit(True).alias("_known"))), "repo", "left")
    phrase = F.when(F.col("_known"), language_phrase(F.col("_extension"))).otherwise(F.raise_error(F.concat(F.lit("unknown repository: "), F.coalesce("repo", F.lit("null")))))
    return task_rows(found, source=source, prompt=prompt(phrase), metadata=metadata)


def unstack(batches: DataFrame, stacked: list[str]) -> DataFrame:
    """One row per sample of a batch, with its ``sample`` number (PF10): stacked columns give their elements, others repeat.

    Stacked columns of unequal length are an error; a batch without samples has no rows.
    """
    sizes = F.array(*[F.size(c) for c in stacked])
    zipped = F.arrays_zip(*stacked)
    checked = F.when(F.array_max(sizes) == F.array_min(sizes), zipped).otherwise(F.raise_error(F.lit("stacked columns differ in length")))
    kept = [F.col(f"`{c}`") for c in batches.columns if c not in stacked]
    rows = batches.select(*kept, F.posexplode(checked).alias("sample", "_row"))
    return rows.select(*kept, "sample", *[F.col(f"_row.`{c}`").alias(c) for c in stacked])


def common_columns(df: DataFrame) -> DataFrame:
    """Only the columns that every row has a value in (ST1): one pass of counts, one row to the driver."""
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] == counts["_all"]])


def reject_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``error_reason``: the first capability that they ask for in vain (PF14, PF15), or null.

    ``body`` is JSON text. A field that is null is there: n, tool_choice and max_tokens may be missing but not null. The
    type tags of the variant tell booleans and fractions from integers.
    """

    def reason(v: Column) -> Column:
        n, choice, most, tools = (field(v, name) for name in ("n", "tool_choice", "max_tokens", "tools"))
        one = ~is_string(n) & F.coalesce(F.try_variant_get(n, "$", "double") == 1, F.lit(False))
        return F.coalesce(
            F.when(v.isNull() | ~is_object(v), "malformed json"),
            F.when(n.isNotNull() & ~one, "n must be 1"),
            F.when(field(v, "response_format").isNotNull() & ~is_null(field(v, "response_format")), "response_format is not supported"),
            F.when(choice.isNotNull() & ~F.coalesce(F.lower(string(choice)).isin("auto", "none"), F.lit(False)), "tool_choice must be auto or none"),
            F.when(F.coalesce(F.size(items(field(v, "messages"))), F.lit(0)) < 1, "messages must be a non-empty list"),
            F.when(tools.isNotNull() & ~is_null(tools) & items(tools).isNull(), "tools must be a list"),
            F.when(most.isNotNull() & ~((kind(most) == "BIGINT") & (F.coalesce(F.try_variant_get(most, "$", "bigint"), F.lit(0)) > 0)), "max_tokens must be a positive integer"),
        )

    return requests.withColumn("error_reason", let(F.try_parse_json("body"), reason))


def offered_tools(body: Column) -> Column:
    """(tools, error) of a request (variant) of the other format (F53): none where tool_choice says so, as text or by type."""
    choice, tools = field(body, "tool_choice"), field(body, "tools")
    says = F.when(choice.isNull(), F.lit("auto")).otherwise(F.coalesce(string(choice), string(field(choice, "type")), F.lit("")))
    error = F.coalesce(F.when(tools.isNotNull() & ~is_null(tools) & items(tools).isNull(), "tools must be a list"), F.when(~says.isin("auto", "none"), "tool_choice must be auto or none"))
    return F.struct(F.when(error.isNull() & (says == "auto"), F.transform(items(tools), convert_tool)).alias("tools"), error.alias("error"))

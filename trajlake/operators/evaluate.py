"""Evaluation of rollouts: outcome buckets, pass rates, timing, episode counters, grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import between_split

#: Parsers of test logs by name, and whether they read lines that end with a status and drop controls.
PARSERS = {"parse_log_pytest": False, "parse_log_pytest_v2": True}
#: Test statuses at the start (or end) of a log line.
STATUSES = ("FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL")


def outcome(df: DataFrame) -> Column:
    """resolved, wrong-ans or timeout/err; without eval_completed the evaluation counts as completed (AG5)."""
    done = F.coalesce("eval_completed", F.lit(True)) if "eval_completed" in df.columns else F.lit(True)
    return F.when(F.coalesce("resolved", F.lit(False)), "resolved").when(done, "wrong-ans").otherwise("timeout/err")


def outcome_buckets(df: DataFrame) -> DataFrame:
    """Counts of the three outcomes, their total, and the pass rate in percent (AG5, AG6, AG7)."""
    own = df.withColumn("_o", outcome(df))
    is_ = lambda o: F.count_if(F.col("_o") == o)
    seconds = F.coalesce(F.avg("eval_execution_time"), F.lit(0.0)) if "eval_execution_time" in df.columns else F.lit(0.0)
    total = F.count(F.lit(1))
    return own.agg(is_("resolved").alias("resolved"), is_("wrong-ans").alias("wrong_ans"), is_("timeout/err").alias("timeout_err"), total.alias("total"), F.when(total > 0, 100.0 * is_("resolved") / total).otherwise(0.0).alias("pass_rate"), seconds.alias("mean_eval_time"))


def bucket_names(df: DataFrame, name: str) -> DataFrame:
    """Distinct (bucket, name) by outcome (AG20): rows, since a bucket may hold any share of all names."""
    return df.select(outcome(df).alias("bucket"), F.col(name).alias("name")).distinct()


def episode_counters(steps: DataFrame) -> DataFrame:
    """Per session: steps, tool calls, timeouts, errors, and the tokens of the last step (AG16)."""
    return steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("kind") == "tool_call").alias("tool_calls"), F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(F.col("status") == "error").alias("errors"), F.max_by("total_tokens", F.struct("seq")).alias("total_tokens"),
    )


def version_span(df: DataFrame, key: str, low: Column, high: Column, step: Column) -> DataFrame:
    """Least and greatest model version over marks with a version; ``step`` where there is none (AG13)."""
    seen = F.when(low.isNotNull(), high)
    return df.groupBy(key).agg(F.coalesce(F.min(low), F.min(step)).alias("min_version"), F.coalesce(F.max(seen), F.min(step)).alias("max_version"))


def parse_pytest_log(logs: DataFrame, *, controls: bool = False) -> DataFrame:
    """(instance_id, test, status) of pytest logs; the last line about a test counts.

    ``controls`` first deletes colour codes and control characters (tabs too) and also reads lines that end with a status.
    """
    lines = logs.select("instance_id", F.posexplode(F.split("log", "\n")).alias("pos", "line"))
    if controls:
        lines = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"\[\d+m", ""), "[\\x01-\\x1f]", ""))
    any_of = "|".join(STATUSES)
    front = F.col("line").rlike(f"^(?:{any_of})")
    words = F.filter(F.split(F.when(front & F.col("line").startswith("FAILED"), F.replace("line", F.lit(" - "), F.lit(" "))).otherwise(F.col("line")), r"\s+"), lambda w: w != "")
    lines = lines.withColumns({"front": front, "words": words}).where(F.size("words") >= 2)
    lines = lines.where(F.col("front") | F.col("line").rlike(f"(?:{any_of})$")) if controls else lines.where("front")
    pick = lambda a, b: F.when(F.col("front"), F.col("words")[a]).otherwise(F.col("words")[b])
    return lines.select("instance_id", pick(1, 0).alias("test"), pick(0, 1).alias("status"), "pos").groupBy("instance_id", "test").agg(F.max_by("status", "pos").alias("status"))


def parse_logs(logs: DataFrame, start: str, end: str) -> DataFrame:
    """(instance_id, test, status) of logs by the parser that each row names (F28, UX10), between its markers.

    ``logs`` has instance_id, log_parser and log. Rows of an unknown parser have one row with ``error``; logs without
    markers have none.
    """
    rows = logs.withColumn("log", between_split(F.col("log"), start, end))
    own = [parse_pytest_log(rows.where((F.col("log_parser") == name) & F.col("log").isNotNull()), controls=controls) for name, controls in PARSERS.items()]
    unknown = logs.where(~F.coalesce(F.col("log_parser").isin(*PARSERS), F.lit(False))).select("instance_id", F.concat(F.lit("unknown log parser: "), F.coalesce("log_parser", F.lit("null"))).alias("error"))
    return reduce(DataFrame.unionByName, own).withColumn("error", F.lit(None).cast("string")).unionByName(unknown, allowMissingColumns=True)


#: Statuses of tests that passed; the one that fails a test of a fail-only repository.
PASSES, FAILS = ("PASSED", "XFAIL"), "FAILED"


def grade(expected: DataFrame, statuses: DataFrame, *, fail_only: list[str] | None = None, neutral: tuple[str, ...] = ()) -> DataFrame:
    """Test reports (JN7, AG10): per instance what was expected, what passed, and whether it is resolved.

    ``statuses`` has a status for each instance_id and test, at most one.
    ``expected`` has instance_id and the lists fail_to_pass and pass_to_pass, and may have repo, exit_code and found
    (whether the log had its markers). A test succeeds if its status is one of ``PASSES``; in a repository of
    ``fail_only`` it does unless it is there and failed. An instance is resolved if its log was found and no expected test
    did otherwise; statuses in ``neutral`` count neither way. ``found_eval_status`` is ``found``, or whether there is any
    status where that isn't given; ``eval_completed`` says whether the exit code was 0, null without one. Both are
    independent of ``resolved``, but that nothing is resolved whose status wasn't found. ``failed_tests`` are at most the
    expected ones, sorted.
    """
    has = lambda c, kind: F.col(c) if c in expected.columns else F.lit(None).cast(kind)
    lenient = F.coalesce(has("repo", "string").isin(*(fail_only or [])), F.lit(False)) if fail_only else F.lit(False)
    own = expected.select("instance_id", has("found", "boolean").alias("found"), has("exit_code", "int").alias("exit_code"), lenient.alias("lenient"), F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("fail_to_pass", "pass_to_pass")])).alias("tests"))
    # Expected tests and statuses meet in one grouping by instance, so statuses, however costly, are asked for once.
    wanted = own.select("instance_id", F.explode("tests").alias("test"), "lenient", F.lit(True).alias("wanted"))
    seen = statuses.select("instance_id", "test", "status", F.lit(True).alias("any"))
    met = wanted.unionByName(seen, allowMissingColumns=True).repartition("instance_id")
    tests = met.groupBy("instance_id", "test").agg(*[F.max(c).alias(c) for c in ("lenient", "wanted", "status", "any")])
    good = F.when(F.col("lenient"), ~F.col("status").eqNullSafe(F.lit(FAILS))).otherwise(F.coalesce(F.col("status").isin(*PASSES), F.lit(False)))
    bad = ~good & (~F.coalesce(F.col("status").isin(*neutral), F.lit(False)) if neutral else F.lit(True))
    counts = tests.groupBy("instance_id").agg(F.count_if("wanted").alias("n"), F.count_if(F.col("wanted") & good).alias("ok"), F.array_sort(F.collect_list(F.when(F.col("wanted") & bad, F.col("test")))).alias("bad"), F.max("any").alias("any"))
    rows = own.join(counts, "instance_id", "left")
    found = F.coalesce("found", "any", F.lit(False))
    failed = F.when(found, F.coalesce("bad", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "instance_id", F.coalesce("n", F.lit(0)).cast("long").alias("expected"), F.when(found, F.coalesce("ok", F.lit(0))).otherwise(0).cast("long").alias("passed"), failed.alias("failed_tests"),
        (found & (F.coalesce(F.size("bad"), F.lit(0)) == 0)).alias("resolved"), found.alias("found_eval_status"), (F.col("exit_code") == 0).alias("eval_completed"),
    )


def wall_time(df: DataFrame) -> DataFrame:
    """Elapsed seconds by name (AG19)."""
    return df.groupBy("name").agg(F.sum("elapsed").alias("elapsed"))

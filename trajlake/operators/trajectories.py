"""Trajectories: conversations to token sequences, selection, records, and score read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions import tokens


def conversation_trajectories(turns: DataFrame) -> DataFrame:
    """One linear trajectory per conversation with an assistant turn: prompt and response ids, mask, turns.

    A segment is an assistant's text, or ``role:text`` and a line break, behind which ``assistant:`` calls for the next
    answer. The prompt ends at the first assistant turn; what follows the last one was never answered and drops out.
    """
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn")
    own = F.col("role") == "assistant"
    rows = turns.withColumns({"first": F.min(F.when(own, F.col("turn"))).over(conv), "last": F.max(F.when(own, F.col("turn"))).over(conv), "next": F.lead("role").over(order)})
    rows = rows.where("first IS NOT NULL AND turn <= last")
    call = F.when(F.col("next").eqNullSafe("assistant"), F.lit("assistant:")).otherwise(F.lit(""))
    rows = rows.withColumn("segment", F.when(own, F.col("text")).otherwise(F.concat("role", F.lit(":"), "text", F.lit("\n"), call)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "segment", (F.col("turn") >= F.col("first")).alias("answer"))))
    rows = rows.groupBy("conv_id").agg(parts.alias("parts"))
    text = lambda keep: F.array_join(F.transform(F.filter("parts", keep), lambda p: p["segment"]), "")
    mask = F.flatten(F.transform(F.filter("parts", lambda p: p["answer"]), lambda p: F.array_repeat(F.when(p["role"] == "assistant", 1).otherwise(0).cast("tinyint"), F.length(p["segment"]))))
    return rows.select(
        "conv_id",
        tokens.code_points(text(lambda p: ~p["answer"])).alias("prompt_ids"),
        tokens.code_points(text(lambda p: p["answer"])).alias("response_ids"),
        mask.alias("response_mask"),
        (F.size(F.filter("parts", lambda p: p["role"].isin("user", "assistant"))) + 1).cast("long").alias("num_turns"),
    )


def training_records(trajectories: DataFrame, reward: Column, *, finished: Column | None = None, mask_unfinished: bool = False) -> DataFrame:
    """Records with input ids, masks, position ids, reward at the last response token and lengths."""
    mask = tokens.mask_unfinished(F.col("response_mask"), finished, mask_unfinished) if finished is not None else F.col("response_mask")
    ids = F.concat("prompt_ids", "response_ids")
    return trajectories.withColumns({
        "input_ids": ids, "attention_mask": tokens.constant_like(ids, 1), "position_ids": tokens.position_ids(ids), "response_mask": mask, "rm_scores": tokens.scatter_last(F.col("response_ids"), reward),
        "prompt_len": F.size("prompt_ids").cast("long"), "response_len": F.size("response_ids").cast("long"), "seq_len": F.size(ids).cast("long"), "status": F.lit("success"),
    })


def record_faults(records: DataFrame) -> DataFrame:
    """Records with the names of the alignment rules that they break."""
    rules = {
        "mask": F.size("response_mask") == F.size("response_ids"),
        "input": F.size("input_ids") == F.size("prompt_ids") + F.size("response_ids"),
        "attention": F.forall("attention_mask", lambda x: x == 1),
        "reward": F.forall(F.slice("rm_scores", 1, F.greatest(F.size("rm_scores") - 1, F.lit(0))), lambda x: x == 0),
        "length": F.col("seq_len") == F.col("prompt_len") + F.col("response_len"),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return records.withColumn("faults", broken)


def final_per_session(df: DataFrame, session: list[str], index: Column, ties: list[Column]) -> DataFrame:
    """The trajectory of largest index of each session (WN1). An arg-max aggregate: rows are combined before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*session).agg(F.max_by(row, F.struct(index, *ties)).alias("r")).select("r.*")


def longest(df: DataFrame, session: list[str], mask_sum: Column, length: Column, ties: list[Column]) -> DataFrame:
    """The trajectory with most model tokens, then the longest, then by ``ties`` (WN2)."""
    return df.groupBy(*session).agg(F.max_by(F.struct(*df.columns), F.struct(mask_sum, length, *ties)).alias("r")).select("r.*")


def broadcast_last_score(df: DataFrame, session: list[str], order: list[Column], score: Column) -> DataFrame:
    """Each row with the score of its session's last trajectory (WN3, JN11)."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("session_score", F.last(score).over(w))


def assign_index(df: DataFrame, session: list[str], order: list[Column]) -> DataFrame:
    """Position within the session, from 0 (WN7, WN8)."""
    return df.withColumn("trajectory_index", (F.row_number().over(Window.partitionBy(*session).orderBy(*order)) - 1).cast("long"))


def summaries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Small readable summaries of trajectories (PF18): lengths, model tokens, reward and reason, without the arrays."""
    size = lambda c: F.size(c).cast("long")
    return df.select(
        *keys, "num_turns", "reward_score", F.col("reason").alias("materialization_reason"), size("prompt_ids").alias("prompt_len"), size("response_ids").alias("response_len"),
        F.coalesce(tokens.total(F.col("response_mask")), F.lit(0.0)).cast("long").alias("model_token_count"),
    )


def parse_key(key: Column) -> Column:
    """(uid, session, index) of ``uid_session_index``; the uid may hold underscores itself."""
    part = lambda i: F.regexp_extract(key, "^(.*)_([^_]*)_([^_]*)$", i)
    return F.struct(part(1).alias("uid"), part(2).alias("session"), part(3).try_cast("bigint").alias("index"))


def prompt_stats(sessions: DataFrame) -> DataFrame:
    """Per uid: successful, failed and unfinished sessions, outputs and status (AG2, AG3, AG4, PF16).

    ``sessions`` has uid, ok, outputs and unfinished (true if any trajectory is known to be unfinished).
    """
    good = F.col("ok") & (F.col("outputs") > 0)
    return sessions.groupBy("uid").agg(
        F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("outputs")).otherwise(0)).alias("outputs"),
        F.count_if(good & F.coalesce("unfinished", F.lit(False))).alias("unfinished"),
    ).withColumn("status", F.when(F.col("success") > 0, "finished").otherwise("failure"))


def batch_stats(prompts: DataFrame, raised: DataFrame | None = None) -> DataFrame:
    """Sums over prompts (AG1). ``raised`` has uid and n of prompts that ended in an error: all their n sessions failed."""
    if raised is not None:
        none = lambda c: F.lit(0).cast("long").alias(c)
        lost = raised.select("uid", none("success"), F.col("n").cast("long").alias("failed"), none("outputs"), none("unfinished"), F.lit("failure").alias("status"))
        prompts = prompts.select("uid", "success", "failed", "outputs", "unfinished", "status").unionByName(lost)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return prompts.agg(total("success"), total("failed"), total("outputs"), total("unfinished"), F.count_if(F.col("status") == "failure").alias("failed_uids"))


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean over sessions, and mean over prompts of their means (AG8)."""
    per_uid = scores.groupBy("uid").agg(F.avg("score").alias("m"), F.sum("score").alias("s"), F.count("score").alias("n"))
    return per_uid.agg((F.sum("s") / F.sum("n")).alias("mean_score"), F.avg("m").alias("mean_of_prompt_means"), F.count(F.lit(1)).alias("prompts"))


def recipe_scores(inputs: DataFrame, scores: DataFrame) -> DataFrame:
    """Each input uid with the mean of its trajectories' scores, 0 without any, and whether it is above 0 (AG9, JN4)."""
    per_uid = scores.groupBy("uid").agg(F.avg("score").alias("mean"))
    score = F.coalesce("mean", F.lit(0.0))
    return inputs.join(per_uid, "uid", "left").select("uid", score.alias("score"), (score > 0).alias("resolved"))


def score_map(scores: DataFrame) -> DataFrame:
    """uid with its scores in session order (AG17, IO12)."""
    return scores.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("session", "score"))), lambda x: x["score"]).alias("scores"))


def result_summary(scores: DataFrame, inputs: DataFrame, statuses: DataFrame, settings: dict[str, str | int], n: int) -> DataFrame:
    """One row ``document``: the head of a run's result (IO12) as JSON: settings, counts and means (eight digits).

    ``scores`` has uid and score of each scored session, ``inputs`` the uid of each prompt, of which ``n`` sessions each
    were asked for, ``statuses`` uid and status. Without scores the means are 0. The scores themselves are rows of their
    own (``score_map``), since they grow with the run.
    """
    own = mean_scores(scores)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    failed = statuses.agg(F.count_if(~F.col("status").eqNullSafe(F.lit("finished"))).alias("failed"))
    rows = own
    for more in (count(inputs, "prompts_in"), count(scores, "sessions"), failed):
        rows = rows.unionByName(more, allowMissingColumns=True)
    head = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    mean = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 8)
    fields = [F.lit(v).alias(k) for k, v in settings.items()] + [F.lit(n).alias("n"), F.col("prompts_in").alias("num_prompts"), F.col("sessions").alias("num_scored_sessions"), (F.col("prompts_in") * n).alias("num_expected_sessions"), F.col("failed").alias("num_failed_prompts"), mean("mean_score").alias("mean_rm_score"), mean("mean_of_prompt_means").alias("mean_rm_score_over_prompts")]
    return head.select(F.to_json(F.struct(*fields)).alias("document"))


def write_result(scores: DataFrame, inputs: DataFrame, statuses: DataFrame, path: str, settings: dict[str, str | int], n: int) -> None:
    """A run's result (IO12): ``summary``, one JSON document, and ``scores``, a JSON line per uid."""
    result_summary(scores, inputs, statuses, settings, n).coalesce(1).write.text(f"{path}/summary")
    score_map(scores).write.json(f"{path}/scores")

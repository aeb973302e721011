"""Registered queries of the trajectory operators, on the driver's tables.

Proxies: ``orders`` are sessions (uid is the customer, failed ones have status F, which also counts as not finished);
``lineitem`` rows are their trajectories (index l_linenumber, model tokens l_quantity, length l_extendedprice, score
l_discount); ``labels`` are outcomes (resolved is quality, evaluation complete is not toxic); ``events`` are steps of
sessions (user_id); ``conversations`` are transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import messages, text, tokens
from trajlake.operators import chains, configs, conversations, encoding, evaluate, normalize, routing, trajectories
from trajlake.session import scratch


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


_TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


def conversation_trajectories(spark, sf):
    t = trajectories.conversation_trajectories(_t(spark, sf, "conversations"))
    ids = lambda c: F.sha2(F.array_join(c, ","), 256)
    return t.select("conv_id", F.size("prompt_ids").cast("long").alias("prompt_len"), F.size("response_ids").cast("long").alias("response_len"), tokens.total("response_mask").cast("long").alias("model_tokens"), "num_turns", ids("prompt_ids").alias("prompt_hash"), ids("response_ids").alias("response_hash"))


def training_record(spark, sf):
    t = trajectories.training_records(trajectories.conversation_trajectories(_t(spark, sf, "conversations")), F.col("conv_id") % 2, finished=F.col("conv_id") % 3 != 0, mask_unfinished=True)
    t = trajectories.record_faults(t)
    return t.select("conv_id", "prompt_len", "response_len", "seq_len", tokens.total("response_mask").cast("long").alias("trained"), tokens.total("rm_scores").alias("reward"), tokens.last_or_zero(F.col("rm_scores")).alias("last_reward"), F.array_max("position_ids").cast("long").alias("last_position"), F.size("faults").cast("long").alias("faults"))


def final_trajectory_per_session(spark, sf):
    return trajectories.final_per_session(_lines(spark, sf), ["l_orderkey"], F.col("l_linenumber"), _TIES)


def longest_trajectory(spark, sf):
    return trajectories.longest(_lines(spark, sf), ["l_orderkey"], F.col("l_quantity"), F.col("l_extendedprice"), ["l_linenumber", "l_partkey", "l_suppkey", "l_discount"])


def broadcast_last_score(spark, sf):
    df = _lines(spark, sf).select("l_orderkey", "l_linenumber", *_TIES)
    return trajectories.broadcast_last_score(df, ["l_orderkey"], [F.col("l_linenumber"), *map(F.col, _TIES)], F.col("l_discount"))


def trajectory_index_assignment(spark, sf):
    return trajectories.assign_index(_lines(spark, sf), ["l_orderkey"], [F.col("l_linenumber"), *map(F.col, _TIES)])


def _sessions(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), "o_orderkey", (F.col("o_orderstatus") != "F").alias("ok"), (F.col("o_orderstatus") == "P").alias("unfinished"))
    outputs = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("outputs"))
    return orders.join(outputs, "o_orderkey", "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))


def prompt_stats(spark, sf):
    return trajectories.prompt_stats(_sessions(spark, sf))


def batch_stats(spark, sf):
    """Customers without orders are prompts that raised, of three sessions each."""
    raised = _t(spark, sf, "customer").join(_t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("uid"), F.lit(3).alias("n"))
    return trajectories.batch_stats(trajectories.prompt_stats(_sessions(spark, sf)), raised)


def _scores(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("session"))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_discount").alias("score")).join(orders, "session")


def mean_score_vs_prompt_mean(spark, sf):
    m = trajectories.mean_scores(_scores(spark, sf))
    return m.select(F.round("mean_score", 8).alias("mean_score"), F.round("mean_of_prompt_means", 8).alias("mean_of_prompt_means"), "prompts")


def recipe_score(spark, sf):
    uids = _t(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return trajectories.recipe_scores(uids, _scores(spark, sf)).withColumn("score", F.round("score", 8))


def score_map(spark, sf):
    final = trajectories.final_per_session(_lines(spark, sf), ["l_orderkey"], F.col("l_linenumber"), _TIES)
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("l_orderkey"))
    return trajectories.score_map(final.join(orders, "l_orderkey").select("uid", F.col("l_orderkey").alias("session"), F.col("l_discount").alias("score")))


def result_document(spark, sf):
    """A run's result as it is written: its head, and a line of scores per customer."""
    folder = scratch(spark)
    scores = _scores(spark, sf).select("uid", "session", "score")
    inputs = _t(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    trajectories.write_result(scores, inputs, trajectories.prompt_stats(_sessions(spark, sf)), folder, {"model_path": "m", "data_path": "d"}, 2)
    return spark.read.text([f"{folder}/summary", f"{folder}/scores"]).select(F.col("value").alias("line"))


def _outcomes(spark, sf):
    return _t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("resolved"), (F.col("toxic") == 0).alias("eval_completed"), F.when(F.col("toxic") == 0, (F.col("doc_id") % 100).cast("double")).alias("eval_execution_time"))


def outcome_buckets(spark, sf):
    return evaluate.outcome_buckets(_outcomes(spark, sf)).withColumns({"pass_rate": F.round("pass_rate", 8), "mean_eval_time": F.round("mean_eval_time", 8)})


def bucket_names(spark, sf):
    return evaluate.bucket_names(_outcomes(spark, sf), "doc_id")


def key_parse(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.concat_ws("_", F.concat(F.lit("uid_"), F.col("l_suppkey").cast("string")), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    k = trajectories.parse_key(F.col("key"))
    return rows.select("key", k["uid"].alias("uid"), k["session"].alias("session"), k["index"].alias("index")).where("index IS NOT NULL")


def rollout_expand_assign(spark, sf):
    tasks = routing.expand_rollouts(_t(spark, sf, "orders").select("o_orderkey"), 4)
    return routing.assign_workers(tasks, [F.col("o_orderkey"), F.col("rollout")], 7).select("o_orderkey", F.col("rollout").cast("long").alias("rollout"), F.col("worker").cast("long").alias("worker"))


def budget_split(spark, sf):
    own = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 129).alias("total"), (F.col("s_suppkey") % 9).alias("workers"))
    return own.select("s_suppkey", "total", "workers", F.posexplode(routing.split_budget(F.col("total"), F.col("workers"))).alias("worker", "budget")).withColumn("worker", F.col("worker").cast("long"))


def episode_counters(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "tool_call").otherwise("other")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "timeout").otherwise("ok")
    return evaluate.episode_counters(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), status.alias("status"), F.col("value").alias("total_tokens")))


def version_span(spark, sf):
    e = _t(spark, sf, "events").withColumn("low", F.when(F.col("user_id") % 5 != 0, F.col("event_id") % 17))
    return evaluate.version_span(e, "user_id", F.col("low"), F.col("low") + F.col("event_id") % 3, F.lit(7).cast("long"))


def message_hashes(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", messages.message_digest(F.col("role"), F.col("text")).alias("digest"))


def prefix_hashes(spark, sf):
    return conversations.prefix_hashes(_t(spark, sf, "conversations"))


def turn_counts(spark, sf):
    return conversations.turn_counts(_t(spark, sf, "conversations"))


def message_tokens(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", messages.message_cost(F.col("text")).alias("cost"))


def compact_history(spark, sf):
    return conversations.compact(_t(spark, sf, "conversations"), most=600, target=300)


def codepoint_tokens(spark, sf):
    ids = tokens.code_points(F.col("text"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.size(ids).cast("long").alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("ids_hash"), tokens.total(ids).cast("long").alias("ids_sum"))


def terminal_reward(spark, sf):
    scores = tokens.scatter_last(F.col("embedding"), F.col("label").cast("double"))
    return _t(spark, sf, "embeddings").select("vec_id", F.array_join(scores.cast("array<int>"), ",").alias("scores"), tokens.total(scores).alias("total"), tokens.last_or_zero(scores).alias("last"))


def aligned_experts(spark, sf):
    """Choices of two layers per token, one token more than the label says, aligned to four tokens."""
    label = F.coalesce("label", F.lit(0))
    own = F.transform(F.sequence(F.lit(0), label), lambda i: F.array(F.array(i + F.col("vec_id").cast("int") % 7, i), F.array(label, i * 2)))
    e = _t(spark, sf, "embeddings").select("vec_id", own.alias("experts"), F.col("embedding").alias("flat"))
    e = tokens.align_experts(tokens.align_experts(e, "experts", F.lit(4)), "flat", F.lit(4))
    return e.select("vec_id", *[F.array_join(F.flatten(F.flatten(c)), ",").alias(c) for c in e.columns if c != "vec_id"])


def align_pad_truncate(spark, sf):
    # In single precision, as the components are: with an integer, Spark would multiply in double precision.
    a = tokens.align(F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("int")), F.lit(56) + F.col("label") * 2, F.lit(0))
    return _t(spark, sf, "embeddings").select("vec_id", F.size(a).cast("long").alias("n"), F.array_join(a, ",").alias("aligned"))


def image_name(spark, sf):
    ident = F.concat(F.col("p_brand"), F.lit("__Repo-"), F.col("p_partkey").cast("string"))
    own = text.image_name(ident)
    return _t(spark, sf, "part").select("p_partkey", own.alias("image"), text.local_image(F.concat(F.lit("reg.example.com/"), own, F.lit(":v2"))).alias("local"))


def safe_filename(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"), text.strip_version(F.concat("url", F.lit("/v1/"))).alias("base"))


def clip_observation(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", F.sha2(text.clip_observation(F.col("text"), 1000), 256).alias("observation_hash"), text.failure_reason(F.col("lang"), F.col("text")).alias("reason"), text.tail(F.concat("text", F.lit("\t \u00a0\n")), 20).alias("tail"), text.short_name(F.concat(F.lit("pkg."), F.col("source"), F.left("text", F.col("doc_id") % 30)), "pkg.").alias("short"))


def task_rows(spark, sf):
    d = _t(spark, sf, "documents").select(F.concat("source", F.lit("__"), "doc_id").alias("instance_id"), "lang", "n_chars", "text")
    rows = routing.task_rows(d, source="verified", prompt=F.col("text"), metadata=["instance_id", "lang", "n_chars"])
    return rows.select("data_source", F.col("tools_kwargs.task.sandbox.image").alias("image"), F.col("tools_kwargs.task.metadata").alias("metadata"), F.sha2(F.col("prompt")[1]["content"], 256).alias("prompt_hash"))


def config_route(spark, sf):
    runners = spark.createDataFrame([("click", "react"), ("view", "cli"), ("purchase", "black_box")], "event_type string, runner string")
    routed = routing.route(_t(spark, sf, "events").select("event_id", "event_type"), runners, "event_type")
    return routed.select("event_id", "event_type", "runner", "error")


def json_arguments(spark, sf):
    canon = messages.canonical_arguments(F.col("props"))
    return _t(spark, sf, "events").select("event_id", canon["kind"].alias("kind"), canon["value"].alias("value"), messages.object_arguments(F.col("event_type")).alias("object"))


def reason_maps(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("eos", "length", "abort", "other", "tool_calls")]), (F.col("event_id") % 5 + 1).cast("int")).alias("stop"), F.element_at(F.array(*[F.lit(x) for x in (400, 409, 404, 500)]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"))
    return e.select("event_id", messages.finish_reason(F.col("stop")).alias("finish"), messages.stop_reason(F.col("stop")).alias("stop_reason"), messages.error_type(F.col("status")).alias("error"), messages.error_type(F.col("status"), "anthropic").alias("error_other"))


def _runs(spark, sf):
    """Each order is a test run, each line of it a test: its status by flag and number, its place in the log by number."""
    status = F.when(F.col("l_returnflag") == "R", "FAILED").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 2 == 0), "XFAIL").when(F.col("l_returnflag") == "A", "PASSED").when(F.col("l_linenumber") % 3 == 0, "SKIPPED").when(F.col("l_linenumber") % 3 == 1, "PASSED").otherwise("ERROR")
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("instance_id"), "l_linenumber", "l_quantity", status.alias("status"), F.concat(F.lit("t/m"), F.col("l_partkey") % 5, F.lit(".py::p"), F.col("l_partkey")).alias("test"))


def run_logs(spark, sf):
    """Log texts of the runs, noise and lines of a bare status between the tests."""
    line = F.concat(F.col("status"), F.when(F.col("l_quantity") > 25, "  ").otherwise("\t"), F.col("test"), F.when(F.col("status") == "FAILED", " - assert 1 == 2").otherwise(""))
    more = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\nnoise "), "test")).otherwise("\nPASSED")
    return _runs(spark, sf).groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "test", "status", F.concat(line, more).alias("line")))), lambda x: x["line"]), "\n").alias("log"))


def pytest_log_parse(spark, sf):
    return evaluate.parse_pytest_log(run_logs(spark, sf))


def grade(spark, sf):
    """Runs against the tests of their own lines and one that no log has; some logs have no markers."""
    runs = _runs(spark, sf)
    tests = runs.groupBy("instance_id").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("test"))).alias("fail_to_pass"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("test"))).alias("pass_to_pass"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("instance_id"), F.col("o_orderpriority").alias("repo"), (F.col("o_orderkey") % 3 - 1).cast("int").alias("exit_code"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus") != "P").alias("found"), (F.col("o_custkey") % 4 == 0).alias("more"))
    expected = orders.join(tests, "instance_id", "left").withColumn("pass_to_pass", F.when(F.col("more"), F.concat(F.coalesce("pass_to_pass", F.array().cast("array<string>")), F.array(F.lit("t/none.py::x")))).otherwise(F.col("pass_to_pass")))
    out = evaluate.grade(expected, pytest_log_parse(spark, sf), fail_only=["1-URGENT", "2-HIGH"])
    return out.withColumn("failed_tests", F.array_join("failed_tests", ","))


def redact_secrets(spark, sf):
    """Whole texts, each with a line of secrets before it: the text itself must come out as it is."""
    line = F.concat(F.lit("api_key='abc' base_url=http://x/v1, endpoint: https://h.example/p Authorization: Bearer tok sk-"), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("\n"))
    d = _t(spark, sf, "documents").select("doc_id", text.redact(F.concat(line, F.coalesce("text", F.lit("")))).alias("out"))
    return d.select("doc_id", F.sha2("out", 256).alias("out_hash"), F.length("out").cast("long").alias("n"))


def _log(spark, sf):
    """An event log of one request per assistant turn of each conversation, then finalize."""
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    asked = c.select("conv_id", "m", F.posexplode("m").alias("i", "own")).where("own.role = 'assistant' AND i > 0")
    none = lambda t: F.lit(None).cast(t)
    row = lambda seq, kind, req, msg, out: [F.col("conv_id").cast("string").alias("session_id"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), req.cast("long").alias("request_id"), msg.alias("messages"), F.lit("").alias("tools"), out.alias("output"), none("int").alias("min_version"), none("int").alias("max_version"), none("string").alias("error"), none("string").alias("reward")]
    prepare = asked.select(*row(2 * F.col("i"), "prepare", F.col("i"), F.to_json(F.slice("m", 1, F.col("i"))), none("string")))
    commit = asked.select(*row(2 * F.col("i") + 1, "commit", F.col("i"), none("string"), F.col("own.content")))
    end = c.select(*row(F.lit(1 << 40), "finalize", none("long"), none("string"), none("string")))
    return prepare.unionByName(commit).unionByName(end)


def chain_stitch(spark, sf):
    t = chains.stitch(_log(spark, sf)).where("trajectory_index IS NOT NULL")
    ids = lambda c: F.sha2(F.array_join(c, ","), 256)
    return t.select(F.col("session_id").cast("long").alias("conv_id"), F.size("prompt_ids").cast("long").alias("prompt_len"), F.size("response_ids").cast("long").alias("response_len"), tokens.total("response_mask").cast("long").alias("model_tokens"), F.col("num_turns").cast("long").alias("num_turns"), ids("prompt_ids").alias("prompt_hash"), ids("response_ids").alias("response_hash"))


def incremental_texts(spark, sf):
    """What each turn settles of its conversation's text for an encoder, and what it leaves open."""
    c = _t(spark, sf, "conversations").withColumn("segment", F.concat("role", F.lit(":"), "text", F.when(F.col("turn") % 2 == 0, "\n").otherwise("")))
    own = encoding.settled(c, "conv_id", "turn", "segment")
    return own.select("conv_id", "turn", F.sha2("settled", 256).alias("settled_hash"), "open")


def incremental_ids(spark, sf):
    """The same by ids, of the code-point codec."""
    c = _t(spark, sf, "conversations").withColumn("segment", F.concat("role", F.lit(":"), "text"))
    own = encoding.settled(c, "conv_id", "turn", "segment").select("conv_id", "turn", tokens.code_points(F.col("settled")).alias("ids"), tokens.code_points(F.col("open")).alias("open_ids"))
    return own.groupBy("conv_id").agg(F.sum(F.size("ids")).alias("settled"), F.max_by(F.size("open_ids"), "turn").cast("long").alias("open"))


def normalize_requests(spark, sf):
    body = F.to_json(F.struct(F.lit("be brief").alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))).alias("content"))).alias("messages")))
    out = normalize.normalize(_t(spark, sf, "conversations").select("conv_id", "turn", F.lit("anthropic").alias("wire"), body.alias("body")))
    m = F.col("messages")
    return out.select("conv_id", "turn", F.size(m).cast("long").alias("n_messages"), m[0]["content"].alias("system"), m[1]["content"].alias("content"), "error")


def config_merge(spark, sf):
    """Configs and overrides whose objects are nested up to 14 levels deep; bindings for two rows of three."""
    text = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
    deep = lambda n, inner: F.concat(F.repeat(F.lit('{"k":'), n.cast("int")), inner, F.repeat(F.lit("}"), n.cast("int")))
    e = _t(spark, sf, "events").repartition("event_id")  # a few files' rows, dealt out to all cores before they grow
    base = F.concat(F.lit('{"agent":{"model":{"url":'), text("event_type"), F.lit(',"t":'), F.col("user_id"), F.lit('},"steps":[1,2]},"deep":'), deep(F.col("event_id") % 14, F.col("event_id").cast("string")), F.lit(',"x":{"y":'), text("props"), F.lit('},"z":{}}'))
    over = F.concat(F.lit('{"deep":'), deep(F.col("event_id") % 9, F.concat(F.lit('{"o":'), F.col("user_id"), F.lit("}"))), F.lit(',"agent":{"steps":['), F.col("event_id"), F.lit(']},"x":'), F.when(F.col("event_id") % 2 == 0, "null").otherwise("{}"), F.lit("}"))
    runtime = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('{"url":"b'), F.col("event_id") % 5, F.lit('","t":null}')))
    return configs.merge_configs(e.select("event_id", base.alias("base"), over.alias("over"), runtime.alias("runtime")), "event_id", "base", "over", "runtime")


def request_gates(spark, sf):
    """Requests whose fields, where they have them, come from the columns; some bodies break off."""
    text = lambda name: F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
    n = F.col("event_id")
    said = F.when(F.col("user_id") % 6 == 0, "[]").otherwise(F.concat(F.lit('[{"role":"user","content":'), text("props"), F.lit("}]")))
    choice = F.when(n % 5 == 0, F.concat(F.lit(',"tool_choice":"'), F.when(F.col("user_id") % 2 == 0, "AUTO").otherwise(F.col("event_type")), F.lit('"'))).otherwise("")
    own = F.when(n % 4 == 0, F.concat(F.lit(',"n":'), n % 3)).otherwise("")
    most = F.when(n % 3 == 0, F.concat(F.lit(',"max_tokens":'), F.floor("value") - 50)).otherwise("")
    body = F.concat(F.lit('{"messages":'), said, own, choice, most, F.when(n % 17 > 0, "}").otherwise(""))
    return routing.reject_requests(_t(spark, sf, "events").select("event_id", body.alias("body"))).select("event_id", "error_reason")


def ext_tumbling_counts(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


def ext_grouping_sets(spark, sf):
    return _t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def ext_group_relative(spark, sf):
    """Rewards against their prompt's mean and deviation: aggregated first, then joined."""
    s = trajectories.score_map(_scores(spark, sf)).select("uid", F.explode("scores").alias("score"))
    g = s.groupBy("uid").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("dev"))
    return g.select("uid", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_trajectories, training_record, final_trajectory_per_session, longest_trajectory, broadcast_last_score, trajectory_index_assignment,
        prompt_stats, batch_stats, result_document, mean_score_vs_prompt_mean, recipe_score, score_map, outcome_buckets, bucket_names, key_parse, rollout_expand_assign,
        budget_split, episode_counters, version_span, message_hashes, prefix_hashes, turn_counts, message_tokens, compact_history, codepoint_tokens,
        terminal_reward, align_pad_truncate, aligned_experts, image_name, safe_filename, clip_observation, task_rows, config_route, json_arguments, reason_maps,
        pytest_log_parse, grade, redact_secrets, chain_stitch, incremental_texts, incremental_ids, normalize_requests, config_merge, request_gates,
        ext_tumbling_counts, ext_grouping_sets, ext_group_relative,
    )
}

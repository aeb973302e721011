"""DuckDB SQL for the trajectory queries."""

from __future__ import annotations

from trajlake.plans import helpers, sinks

_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount"
_SESSIONS = """s AS (SELECT o_custkey AS uid, o_orderstatus <> 'F' AS ok, o_orderstatus = 'P' AS unfinished, coalesce(n, 0) AS outputs
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
p AS (SELECT uid, count(*) FILTER (ok AND outputs > 0) AS success, count(*) FILTER (NOT (ok AND outputs > 0)) AS failed,
  CAST(sum(CASE WHEN ok AND outputs > 0 THEN outputs ELSE 0 END) AS BIGINT) AS outputs, count(*) FILTER (ok AND outputs > 0 AND unfinished) AS unfinished FROM s GROUP BY uid)"""
_SCORES = "x AS (SELECT o_custkey AS uid, o_orderkey AS session, l_discount AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_IDS = lambda t: f"array_to_string(list_transform(string_split({t}, ''), lambda c: unicode(c)), ',')"
_SEGMENTS = """a AS (SELECT *, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS fa, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
b AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE role || ':' || text || chr(10) || CASE WHEN nx = 'assistant' THEN 'assistant:' ELSE '' END END AS seg FROM a WHERE turn <= la),
t AS (SELECT conv_id, coalesce(string_agg(seg, '' ORDER BY turn) FILTER (turn < fa), '') AS prompt, string_agg(seg, '' ORDER BY turn) FILTER (turn >= fa) AS response,
  CAST(coalesce(sum(length(seg)) FILTER (role = 'assistant'), 0) AS BIGINT) AS own, count(*) FILTER (role IN ('user', 'assistant')) + 1 AS num_turns FROM b GROUP BY conv_id)"""
_TRAJECTORIES = f"""WITH {_SEGMENTS} SELECT conv_id, length(prompt) AS prompt_len, length(response) AS response_len, own AS model_tokens, num_turns,
  sha256({_IDS("prompt")}) AS prompt_hash, sha256({_IDS("response")}) AS response_hash FROM t"""
_CLIP = "'\n<response clipped>\n<NOTE>The observation exceeded 1000 characters, so ' || (length(text) - 1000) || ' were elided. Retry with something that yields less output (e.g. head/tail/grep, or redirect to a file); do not use interactive pagers.</NOTE>'"
_LOGS = """r AS (SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, l_linenumber, 't/m' || l_partkey % 5 || '.py::p' || l_partkey AS test,
  CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'XFAIL' ELSE 'PASSED' END ELSE ['SKIPPED', 'PASSED', 'ERROR'][l_linenumber % 3 + 1] END AS status FROM lineitem),
st AS (SELECT instance_id, test, arg_max(status, (l_linenumber, status)) AS status FROM r GROUP BY 1, 2)"""
_SEQ = lambda values: "[" + ", ".join(values) + "]"

ORACLE_SQL = {
    "conversation_trajectories": _TRAJECTORIES,
    "chain_stitch": _TRAJECTORIES,
    "training_record": f"""WITH {_SEGMENTS} SELECT conv_id, length(prompt) AS prompt_len, length(response) AS response_len, length(prompt) + length(response) AS seq_len,
      CASE WHEN conv_id % 3 = 0 THEN 0 ELSE own END AS trained, CAST(conv_id % 2 AS DOUBLE) AS reward, CAST(conv_id % 2 AS DOUBLE) AS last_reward, length(prompt) + length(response) - 1 AS last_position, CAST(0 AS BIGINT) AS faults FROM t""",
    "final_trajectory_per_session": f"SELECT {_COLUMNS} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC) = 1",
    "longest_trajectory": f"SELECT {_COLUMNS} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC) = 1",
    "broadcast_last_score": f"SELECT {_COLUMNS}, last_value(l_discount) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS session_score FROM lineitem",
    "trajectory_index_assignment": f"SELECT {_COLUMNS}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS trajectory_index FROM lineitem",
    "prompt_stats": f"WITH {_SESSIONS} SELECT *, CASE WHEN success > 0 THEN 'finished' ELSE 'failure' END AS status FROM p",
    "batch_stats": f"WITH {_SESSIONS} SELECT CAST(sum(success) AS BIGINT) AS success, CAST(sum(failed) AS BIGINT) + 3 * any_value(r) AS failed, CAST(sum(outputs) AS BIGINT) AS outputs, CAST(sum(unfinished) AS BIGINT) AS unfinished, count(*) FILTER (success = 0) + any_value(r) AS failed_uids FROM p, (SELECT count(*) AS r FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))",
    "result_document": f"""WITH {_SESSIONS}, {_SCORES}, g AS (SELECT uid, avg(score) AS m, list(score ORDER BY session, score) AS l FROM x GROUP BY uid)
      SELECT '{{"uid":' || uid || ',"scores":[' || array_to_string(list_transform(l, lambda v: CAST(v AS VARCHAR)), ',') || ']}}' AS line FROM g
      UNION ALL SELECT '{{"model_path":"m","data_path":"d","n":2,"num_prompts":' || c || ',"num_scored_sessions":' || s || ',"num_expected_sessions":' || 2 * c || ',"num_failed_prompts":' || f || ',"mean_rm_score":' || m || ',"mean_rm_score_over_prompts":' || o || '}}'
      FROM (SELECT count(*) AS c FROM customer), (SELECT count(*) AS s, round(avg(score), 8) AS m FROM x), (SELECT round(avg(m), 8) AS o FROM g), (SELECT count(*) FILTER (success = 0) AS f FROM p)""",
    "mean_score_vs_prompt_mean": f"WITH {_SCORES}, g AS (SELECT uid, avg(score) AS m FROM x GROUP BY uid) SELECT round((SELECT avg(score) FROM x), 8) AS mean_score, round(avg(m), 8) AS mean_of_prompt_means, count(*) AS prompts FROM g",
    "recipe_score": f"WITH {_SCORES}, g AS (SELECT uid, avg(score) AS m FROM x GROUP BY uid) SELECT c_custkey AS uid, round(coalesce(m, 0), 8) AS score, coalesce(m, 0) > 0 AS resolved FROM customer LEFT JOIN g ON uid = c_custkey",
    "score_map": "WITH f AS (SELECT l_orderkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC) = 1) SELECT o_custkey AS uid, list(l_discount ORDER BY o_orderkey, l_discount) AS scores FROM f JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "outcome_buckets": "SELECT count(*) FILTER (quality = 1) AS resolved, count(*) FILTER (quality <> 1 AND toxic = 0) AS wrong_ans, count(*) FILTER (quality <> 1 AND toxic <> 0) AS timeout_err, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 8) AS pass_rate, round(avg(CASE WHEN toxic = 0 THEN CAST(doc_id % 100 AS DOUBLE) END), 8) AS mean_eval_time FROM labels",
    "bucket_names": "SELECT DISTINCT CASE WHEN quality = 1 THEN 'resolved' WHEN toxic = 0 THEN 'wrong-ans' ELSE 'timeout/err' END AS bucket, doc_id AS name FROM labels",
    "key_parse": "SELECT 'uid_' || l_suppkey || '_' || l_orderkey || '_' || l_linenumber AS key, 'uid_' || l_suppkey AS uid, CAST(l_orderkey AS VARCHAR) AS session, CAST(l_linenumber AS BIGINT) AS index FROM lineitem",
    "rollout_expand_assign": "SELECT o_orderkey, r AS rollout, (row_number() OVER (ORDER BY o_orderkey, r) - 1) % 7 AS worker FROM orders, range(4) t(r)",
    "budget_split": "SELECT s_suppkey, total, workers, i AS worker, CAST(total // workers + CASE WHEN i < total % workers THEN 1 ELSE 0 END AS BIGINT) AS budget FROM (SELECT s_suppkey, s_suppkey * 7 % 129 AS total, s_suppkey % 9 AS workers FROM supplier), LATERAL (SELECT unnest(range(workers)) AS i)",
    "episode_counters": "SELECT user_id AS session_id, count(*) AS steps, count(*) FILTER (event_type = 'click') AS tool_calls, count(*) FILTER (event_type = 'view') AS timeouts, count(*) FILTER (event_type = 'error') AS errors, arg_max(value, event_id) AS total_tokens FROM events GROUP BY 1",
    "version_span": "WITH v AS (SELECT user_id, event_id, CASE WHEN user_id % 5 <> 0 THEN event_id % 17 END AS low FROM events) SELECT user_id, coalesce(min(low), 7) AS min_version, coalesce(max(low + event_id % 3), 7) AS max_version FROM v GROUP BY 1",
    "message_hashes": "SELECT conv_id, turn, sha256(CAST(to_json(struct_pack(content := text, role := role)) AS VARCHAR)) AS digest FROM conversations",
    "prefix_hashes": """WITH RECURSIVE d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sha256(CAST(to_json(struct_pack(content := text, role := role)) AS VARCHAR)) AS h FROM conversations),
      c AS (SELECT conv_id, turn, i, sha256(chr(10) || h) AS p FROM d WHERE i = 1 UNION ALL SELECT d.conv_id, d.turn, d.i, sha256(c.p || chr(10) || d.h) FROM c JOIN d ON c.conv_id = d.conv_id AND d.i = c.i + 1) SELECT conv_id, turn, p AS prefix_hash FROM c""",
    "turn_counts": "SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) + 1 AS num_turns FROM conversations GROUP BY 1",
    "message_tokens": "SELECT conv_id, turn, CAST(4 + greatest(1, length(text) // 4) AS BIGINT) AS cost FROM conversations",
    "compact_history": """WITH c AS (SELECT conv_id, turn, role, CAST(4 + greatest(1, length(text) // 4) AS BIGINT) AS cost, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS ch FROM conversations),
      k AS (SELECT conv_id, ch, sum(cost) AS cc FROM c WHERE role <> 'system' AND ch > 0 GROUP BY 1, 2),
      r AS (SELECT conv_id, ch, sum(cc) OVER (PARTITION BY conv_id ORDER BY ch DESC) AS used, max(ch) OVER (PARTITION BY conv_id) AS newest FROM k),
      s AS (SELECT conv_id, sum(cost) AS al, coalesce(sum(cost) FILTER (role = 'system'), 0) AS sy, max(ch) AS m FROM c GROUP BY 1),
      o AS (SELECT c.*, (al <= 600 OR m = 0) AS whole FROM c JOIN s USING (conv_id) LEFT JOIN r ON r.conv_id = c.conv_id AND r.ch = c.ch
        WHERE al <= 600 OR m = 0 OR role = 'system' OR (c.ch > 0 AND (c.ch = newest OR used <= greatest(0, 300 - sy))))
      SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN NOT whole AND role = 'system' THEN 0 ELSE 1 END, turn) - 1 AS position, cost FROM o""",
    "codepoint_tokens": f"SELECT conv_id, turn, length(text) AS n, sha256({_IDS('text')}) AS ids_hash, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS ids_sum FROM conversations",
    "terminal_reward": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x, i: CASE WHEN i = len(embedding) THEN label ELSE 0 END), ',') AS scores, CAST(label AS DOUBLE) AS total, CAST(label AS DOUBLE) AS last FROM embeddings",
    "align_pad_truncate": "SELECT vec_id, CAST(56 + label * 2 AS BIGINT) AS n, array_to_string(list_resize(list_transform(embedding, lambda x: CAST(floor(x * 100::FLOAT) AS INTEGER)), 56 + label * 2, 0), ',') AS aligned FROM embeddings",
    "image_name": "SELECT p_partkey, 'swebench/sweb.eval.x86_64.' || replace(lower(p_brand || '__Repo-' || p_partkey), '__', '_1776_') AS image, 'sweb.eval.x86_64.' || replace(replace(lower(p_brand || '__Repo-' || p_partkey), '__', '_1776_'), '_1776_', '__') || ':latest' AS local FROM part",
    "safe_filename": "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'default') AS name, regexp_replace(url, '/+$', '') AS base FROM pages",
    "clip_observation": f"""SELECT doc_id, sha256('Observation:' || chr(10) || CASE WHEN length(text) > 1000 THEN left(text, 1000) || {_CLIP} ELSE text END) AS observation_hash, left(lang || ':' || coalesce(nullif(text, ''), lang), 512) AS reason,
      right(regexp_replace(text, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'), 20) AS tail, CASE WHEN length(source || left(text, doc_id % 30)) > 22 THEN '…' || right(source || left(text, doc_id % 30), 21) ELSE source || left(text, doc_id % 30) END AS short FROM documents""",
    "task_rows": """SELECT 'verified' AS data_source, 'swebench/sweb.eval.x86_64.' || replace(lower(source || '__' || doc_id), '__', '_1776_') AS image, CAST(to_json(struct_pack(instance_id := source || '__' || doc_id, lang := lang, n_chars := n_chars)) AS VARCHAR) AS metadata, sha256(text) AS prompt_hash FROM documents""",
    "config_route": "SELECT event_id, event_type, r AS runner, CASE WHEN r IS NULL THEN 'unknown agent: ' || event_type END AS error FROM events LEFT JOIN (VALUES ('click', 'react'), ('view', 'cli'), ('purchase', 'black_box')) v(k, r) ON k = event_type",
    "json_arguments": "SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'raw' END AS kind, CASE WHEN json_valid(props) THEN CAST(json(props) AS VARCHAR) ELSE props END AS value, '{}' AS object FROM events",
    "reason_maps": f"""WITH e AS (SELECT event_id, {_SEQ(["'eos'", "'length'", "'abort'", "'other'", "'tool_calls'"])}[event_id % 5 + 1] AS stop, {_SEQ(["400", "409", "404", "500"])}[event_id % 4 + 1] AS status FROM events)
      SELECT event_id, CASE WHEN stop IN ('eos', 'abort') THEN 'stop' ELSE stop END AS finish, CASE stop WHEN 'length' THEN 'max_tokens' WHEN 'tool_calls' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
      CASE WHEN status = 409 THEN 'conflict_error' WHEN status < 500 THEN 'invalid_request_error' ELSE 'internal_server_error' END AS error, CASE WHEN status IN (400, 409) THEN 'invalid_request_error' ELSE 'api_error' END AS error_other FROM e""",
    "pytest_log_parse": f"WITH {_LOGS} SELECT * FROM st",
    "grade": f"""WITH {_LOGS}, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS lenient, o_orderkey % 3 = 1 AS done, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus <> 'P' END AS marked, o_custkey % 4 = 0 AS more FROM orders),
f AS (SELECT *, coalesce(marked, EXISTS (SELECT 1 FROM st WHERE st.instance_id = o.instance_id)) AS found FROM o),
x AS (SELECT DISTINCT instance_id, test FROM r UNION SELECT instance_id, 't/none.py::x' FROM o WHERE more),
g AS (SELECT f.instance_id, x.test, CASE WHEN lenient THEN coalesce(status, '') <> 'FAILED' ELSE coalesce(status IN ('PASSED', 'XFAIL'), false) END AS good FROM f JOIN x USING (instance_id) LEFT JOIN st ON st.instance_id = x.instance_id AND st.test = x.test),
c AS (SELECT instance_id, count(*) AS n, count(*) FILTER (good) AS ok, string_agg(test, ',' ORDER BY test) FILTER (NOT good) AS bad FROM g GROUP BY 1)
      SELECT instance_id, coalesce(n, 0) AS expected, CASE WHEN found THEN coalesce(ok, 0) ELSE 0 END AS passed, CASE WHEN found THEN coalesce(bad, '') ELSE '' END AS failed_tests, found AND bad IS NULL AS resolved, found AS found_eval_status, done AS eval_completed FROM f LEFT JOIN c USING (instance_id)""",

    "redact_secrets": "WITH r AS (SELECT doc_id, 'api_key=''<redacted>'' base_url=<redacted>, endpoint: <redacted> Authorization: Bearer <redacted> <redacted>' || chr(10) || coalesce(text, '') AS out FROM documents) SELECT doc_id, sha256(out) AS out_hash, CAST(length(out) AS BIGINT) AS n FROM r",
    "incremental_texts": """WITH c AS (SELECT conv_id, turn, role || ':' || text || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END AS s FROM conversations), b AS (SELECT *, regexp_extract(s, '(?s)^(.*\\S) \\S', 1) AS h FROM c),
w AS (SELECT *, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY turn) AS whole, length(s) - length(h) AS l FROM b),
e AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run, length(whole) - CASE WHEN h <> '' THEN l ELSE 0 END AS cut FROM w),
x AS (SELECT *, coalesce(max(CASE WHEN h <> '' THEN cut END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS upto FROM e), y AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS since FROM x)
SELECT conv_id, turn, sha256(substr(whole, since + 1, upto - since)) AS settled_hash, substr(whole, upto + 1) AS open FROM y""",
    "incremental_ids": """WITH c AS (SELECT conv_id, string_agg(role || ':' || text, '' ORDER BY turn) AS w, arg_max(role || ':' || text, turn) AS last FROM conversations GROUP BY 1), l AS (SELECT *, regexp_extract(last, '(?s)^(.*\\S) \\S', 1) AS h FROM c)
      SELECT conv_id, length(w) - (length(last) - length(h)) AS settled, length(last) - length(h) AS open FROM l""",
    "normalize_requests": "SELECT conv_id, turn, CAST(2 AS BIGINT) AS n_messages, 'be brief' AS system, text || chr(10) || role AS content, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "aligned_experts": """SELECT vec_id, array_to_string(list_transform(range(4), lambda i: CASE WHEN i <= coalesce(label, 0) THEN concat_ws(',', i + vec_id % 7, i, coalesce(label, 0), i * 2) ELSE '0,0,0,0' END), ',') AS experts FROM embeddings""",
    "config_merge": """SELECT event_id, '{"agent":{"model":{"t":' || user_id || ',"url":"' || CASE WHEN event_id % 3 > 0 THEN 'b' || event_id % 5 ELSE event_type END || '"},"steps":[' || event_id || ']},"deep":' || repeat('{"k":', event_id % 9)
      || CASE WHEN event_id % 14 > event_id % 9 THEN repeat('{"k":', event_id % 14 - event_id % 9) || event_id || repeat('}', event_id % 14 - event_id % 9 - 1) || ',"o":' || user_id || '}' ELSE '{"o":' || user_id || '}' END || repeat('}', event_id % 9)
      || ',"x":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '{"y":' || CAST(to_json(props) AS VARCHAR) || '}' END || ',"z":{}}' AS config FROM events""",
    "request_gates": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'malformed json' WHEN event_id % 4 = 0 AND event_id % 3 <> 1 THEN 'n must be 1' WHEN event_id % 5 = 0 AND user_id % 2 <> 0 THEN 'tool_choice must be auto or none'
      WHEN user_id % 6 = 0 THEN 'messages must be a non-empty list' WHEN event_id % 3 = 0 AND floor(value) <= 50 THEN 'max_tokens must be a positive integer' END AS error_reason FROM events""",
    "ext_tumbling_counts": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ext_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "ext_group_relative": f"WITH {_SCORES} SELECT uid, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS dev FROM x GROUP BY uid",
}
SINKS = sinks.oracle_sql(_TRAJECTORIES)
HELPERS = helpers.oracle_sql(f"WITH {_SEGMENTS} SELECT conv_id, prompt, response, num_turns FROM t")

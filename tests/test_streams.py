"""Keyed state of streams: what stays, what timers end, order over triggers, and results after a lost trigger."""

import json
import random
import shutil
import time

import pytest
from types import SimpleNamespace
from pyspark.sql import functions as F

from test_operators import events_of, random_log
from trajlake.operators import chains
from trajlake.streaming import sessions

NAMES = ["session_id", "trajectory_index", "prompt_ids", "response_ids", "response_mask", "num_turns", "reward", "reason", "problem", "rollbacks", "dropped_tokens"]


def written(rows, path, parts):
    for i, part in enumerate(parts):
        rows.where(part).coalesce(1).write.mode("append").json(f"{path}/d={i}")
        time.sleep(0.05)


def started(stream, tmp_path, name):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()


def until(query, done, seconds=90):
    """Wait; such a query always has another batch to run, since time may end something."""
    end = time.time() + seconds
    while time.time() < end and query.exception() is None:
        if query.lastProgress and done():
            return
        time.sleep(0.3)
    raise AssertionError(f"not in time: {query.exception()}")


def state_rows(query):
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return seen[-1] if seen else 0


def test_state_shrinks_at_the_end_of_a_session_and_late_events_are_told(spark, tmp_path):
    log = [e for e in random_log(3, 6)]
    late = [{"session_id": log[0]["session_id"], "seq": 500, "kind": "commit", "request_id": 0, "output": "x"}]
    events = events_of(spark, log + late)
    stream = spark.readStream.schema(chains.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = started(sessions.stitch_stream(stream).select(*NAMES), tmp_path, "shrinks")
    last = max(e["seq"] for e in log)
    try:
        written(events, tmp_path / "in", [f"seq < {last}"])
        until(query, lambda: state_rows(query) > 3)
        grown = state_rows(query)
        written(events, tmp_path / "in", ["false", f"seq = {last}"])
        until(query, lambda: spark.table("shrinks").where("problem IS NULL").count() > 0)
        written(events, tmp_path / "in", ["false", "false", f"seq > {last}"])
        until(query, lambda: spark.table("shrinks").where("problem = 'commit after FINALIZED'").count() == 1)
        until(query, lambda: state_rows(query) == 1)
    finally:
        query.stop()
    assert grown > 3
    want = chains.stitch(events.where(f"seq <= {last}")).select(*NAMES)
    assert sorted(map(str, spark.table("shrinks").where("problem IS NULL").collect())) == sorted(map(str, want.collect()))


def test_idle_sessions_end_and_ended_ones_are_forgotten(spark, tmp_path):
    ask = {"session_id": "s", "seq": 1, "kind": "prepare", "request_id": 0, "messages": '[{"role":"user","content":"q"}]'}
    rows = [ask, {"session_id": "s", "seq": 2, "kind": "commit", "request_id": 0, "output": "a"}]
    events_of(spark, rows).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(chains.EVENT_SCHEMA).json(str(tmp_path / "in"))
    query = started(sessions.stitch_stream(stream, idle_ms=1500, late_ms=3000).select(*NAMES), tmp_path, "idles")
    try:
        until(query, lambda: spark.table("idles").count() == 1)
        until(query, lambda: state_rows(query) == 0)
    finally:
        query.stop()
    row = spark.table("idles").first()
    assert (row["reason"], row["problem"], "".join(map(chr, row["response_ids"]))) == ("idle", None, "a")


def test_events_behind_an_earlier_trigger_are_told(spark, tmp_path):
    ask = lambda seq, i, *m: {"session_id": "s", "seq": seq, "kind": "prepare", "request_id": i, "messages": json.dumps([{"role": r, "content": c} for r, c in m])}
    rows = [ask(3, 0, ("user", "q")), {"session_id": "s", "seq": 4, "kind": "commit", "request_id": 0, "output": "a"}, ask(1, 1, ("user", "early")), {"session_id": "s", "seq": 6, "kind": "finalize"}]
    written(events_of(spark, rows), tmp_path / "in", ["seq IN (3, 4)", "seq IN (1, 6)"])
    stream = spark.readStream.schema(chains.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    got = sessions.run_available(sessions.stitch_stream(stream), str(tmp_path / "s"), clock="processing").collect()
    assert sorted((r["problem"] or "", r["trajectory_index"]) for r in got) == [("", 0), ("prepare out of order", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_turns_in_any_order_of_triggers(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"c{rng.randrange(3)}", f"m{i:03}", str((1 + rng.randrange(40)) * 1000), str(i)) for i in range(60)]
    rng.shuffle(rows)
    schema = "chat_id string, message_id string, create_time string, content string"
    for i in range(4):
        spark.createDataFrame(rows[i * 15 : i * 15 + 15] + [(None, None, "99999999", None)] * (i == 3), schema).coalesce(1).write.json(str(tmp_path / f"in/d={i}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    got = sessions.run_available(sessions.chat_turns(stream, "1 hour"), str(tmp_path / "s")).collect()
    want = []
    for chat in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == chat), key=lambda r: (int(r[2]), r[1]))
        want += [(chat, i, r[1]) for i, r in enumerate(own)]
    assert sorted((r["chat_id"], r["ordinal"], r["message_id"]) for r in got) == sorted(want)


def test_counts_after_a_lost_trigger_and_a_compaction(spark, tmp_path):
    rng = random.Random(7)
    values = [rng.choice("abc") for _ in range(90)]
    for i in range(3):
        spark.createDataFrame([(v,) for v in values[i * 30 : i * 30 + 30]], "outcome string").coalesce(1).write.json(str(tmp_path / f"in/d={i}"))
        time.sleep(0.05)
    counts = lambda: sessions.running_outcomes(spark.readStream.schema("outcome string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*")))
    folder, schema = str(tmp_path / "s"), "outcome string, n bigint"
    found = lambda: {r["outcome"]: r["n"] for r in sessions.current(spark, folder, schema, "outcome").collect()}
    want = {v: values.count(v) for v in "abc"}
    sessions.upsert(counts(), folder).awaitTermination()
    assert found() == want
    # The last trigger is lost: its commit is gone, and half of what it wrote.
    (tmp_path / "s/state/commits/2").unlink()
    (tmp_path / "s/state/commits/.2.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "s/changes/batch=2")
    sessions.upsert(counts(), folder).awaitTermination()
    assert found() == want
    sessions.compact(spark, folder, schema, "outcome", 1)
    shutil.rmtree(tmp_path / "s/changes/batch=0")
    assert found() == want
    (tmp_path / "s/base/upto=5").mkdir()  # a compaction that didn't end
    assert found() == want
    spark.createDataFrame([("z",)], "outcome string").coalesce(1).write.json(str(tmp_path / "in/d=9"))
    assert {r["outcome"]: r["n"] for r in sessions.run_counts(counts(), folder, "outcome").collect()} == want | {"z": 1}


def test_linear_sessions_need_no_python(spark):
    """Logs that only go on, with failed requests, several chains and rewards: joins alone give what the fold gives."""
    rng = random.Random(11)
    rows = []
    for s in range(25):
        told, seq = [[("user", f"a{k}")] for k in range(rng.randrange(1, 4))], 0
        for i in range(8):
            base = rng.choice(told)
            seq += 2
            rows.append({"session_id": f"s{s}", "seq": seq, "kind": "prepare", "request_id": i, "messages": json.dumps([{"role": r, "content": c} for r, c in base]), "tools": "t" if base[0][1] == "a1" else None})
            fails = rng.random() < 0.2
            rows.append({"session_id": f"s{s}", "seq": seq + 1, "kind": "commit", "request_id": i, "output": f"o{i}", "error": "x" if fails else None, "min_version": i, "max_version": i + 1})
            if not fails:
                told[told.index(base)] = [*base, ("assistant", f"o{i}"), ("user", rng.choice("xyz"))]
            if rng.random() < 0.3:
                seq += 2
                rows.append({"session_id": f"s{s}", "seq": seq, "kind": "reward", "reward": str(i)})
        rows.append({"session_id": f"s{s}", "seq": seq + 5, "kind": "finalize"})
    events = events_of(spark, rows)
    got = chains.stitch(events).select(*NAMES, "min_version", "max_version")
    assert "InArrow" not in got._jdf.queryExecution().toString()
    thin = chains.stored(chains.digested(events).drop("texts", "output", "logprobs", "calls", "error"))
    requests, branching, _ = chains._linear(thin, None)
    assert branching.isEmpty()
    folded = chains.fold(thin, requests, rollback=True, capacity=None)
    shape = lambda df: sorted(map(str, df.select("session_id", "trajectory_index", "num_turns", "min_version", "max_version", "reward").collect()))
    assert shape(got) == shape(folded)
    masks = {(r["session_id"], r["trajectory_index"]): sum(r["response_mask"]) for r in got.collect()}
    assert masks == {(r["session_id"], r["trajectory_index"]): sum(2 for p in r["pieces"] if p["part"] == chains.ANSWER) for r in folded.collect()}


class _Told:
    """A value or list state that counts what it is asked."""

    def __init__(self) -> None:
        self.held, self.asked = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.asked += 1
            if name == "appendList":
                self.held = [*(self.held or []), *args[0]]
            elif name in ("update", "put", "clear"):
                self.held = args[0] if args else None
            return self.held is not None if name == "exists" else iter(self.held or []) if name == "get" and isinstance(self.held, list) else self.held

        return call


def test_chat_turns_ask_state_per_trigger():
    """Not per event: a thousand events of a chat are few calls and one timer (F2)."""
    timers, states = [], [_Told() for _ in range(3)]
    free = iter(states)
    handle = SimpleNamespace(getValueState=lambda *_: next(free), getListState=lambda *_: next(free), getMapState=lambda *_: next(free), registerTimer=timers.append, deleteTimer=timers.remove)
    turns = sessions._Turns(True)
    turns.init(handle)
    rows = [{"at_ms": i, "message_id": f"m{i}", "create_time": str(i), "content": None} for i in range(999, -1, -1)]
    assert not list(turns.handleInputRows(("c",), rows, None)) and timers == [0]
    due = list(turns.handleExpiredTimer(("c",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 700), None))
    assert [(r["ordinal"], r["message_id"]) for r in due] == [(i, f"m{i}") for i in range(701)]
    assert timers == [0, 701] and sum(s.asked for s in states) < 20

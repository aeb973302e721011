"""Structured Streaming: stitching of live event logs, chat events, and running evaluation counters.

Keyed state is kept by ``transformWithState`` in RocksDB: a value or a map entry is read and written by itself, and timers
and times to live end what nobody will ask for again.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import astuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajlake.operators.chains import FOLD_ARROW, FOLD_SCHEMA, Chain, Piece, Request, Session, assembled, digested, encoded_size, fit_by_hash

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fields of the state of a session, in the order of the classes that they fill.
CHAIN = "number int, tools string, pieces int, prompt long, response long, told long, last long, at int, start string, tip string, spoken int, updated int, reserved boolean, reason string"
PIECE = "part int, seq long, first int, last int, size long, call boolean, text string, low int, high int"
REQUEST = "chain int, replace boolean, tools string, spoken int, hash string, part int, seq long, first int, last int, size long, text string"
SESSION = "phase string, created int, order int, reward string, dropped long, rollbacks int, last long"


class StateMap(MutableMapping):
    """A map state as a mapping: keys are one value or a tuple, values of one class."""

    def __init__(self, state, kind: type, single: bool = True) -> None:
        self.state, self.kind, self.single = state, kind, single

    def _key(self, key):
        return (key,) if self.single else key

    def __getitem__(self, key):
        if not self.state.containsKey(self._key(key)):
            raise KeyError(key)
        return self.kind(*self.state.getValue(self._key(key)))

    def __setitem__(self, key, value) -> None:
        self.state.updateValue(self._key(key), astuple(value))

    def __delitem__(self, key) -> None:
        self.state.removeKey(self._key(key))

    def __iter__(self):
        return iter([k[0] if self.single else tuple(k) for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def values(self):
        return [self.kind(*v) for v in self.state.values()]

    def clear(self) -> None:
        self.state.clear()


def _row(values: tuple) -> Row:
    return Row(**dict(zip(FOLD_ARROW.names, values, strict=True)))


class _Stitching(StatefulProcessor):
    """A session's chains, their pieces and open requests as map states; what is left of a finished one is its phase."""

    def __init__(self, rollback: bool, capacity: int | None, idle_ms: int | None, late_ms: int) -> None:
        self.rollback, self.capacity, self.idle_ms, self.late_ms = rollback, capacity, idle_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.ended = handle.getValueState("ended", "phase string, last long", self.late_ms)
        self.chains = StateMap(handle.getMapState("chains", "number int", CHAIN), Chain)
        self.pieces = StateMap(handle.getMapState("pieces", "chain int, nth int", PIECE), Piece, single=False)
        self.pending = StateMap(handle.getMapState("pending", "request_id long", REQUEST), Request)

    def _session(self) -> tuple[Session, int | None]:
        own = Session(self.rollback, self.capacity, fit_by_hash, chains=self.chains, pieces=self.pieces, pending=self.pending)
        if self.ended.exists():
            own.phase, last = self.ended.get()
            return own, last
        if not self.session.exists():
            return own, None
        own.phase, own.created, own.order, own.reward, own.dropped, own.rollbacks, last = self.session.get()
        return own, last

    def _alarm(self) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        session, last = self._session()
        was_active = session.phase == "ACTIVE"
        for r in sorted(rows, key=lambda r: r["seq"]):
            e = r.asDict()
            if was_active and last is not None and e["seq"] <= last:
                session.problems.append(f"{e['kind']} out of order")
                yield from map(_row, session.told(key[0], {"kind": None}))
                continue
            last = e["seq"] if last is None else max(last, e["seq"])
            for x in session.told(key[0], e | {"prefix": list(e["prefix"]), "lengths": list(e["lengths"])}):
                yield _row(x)
        if session.phase == "ACTIVE":
            self.session.update((session.phase, session.created, session.order, session.reward, session.dropped, session.rollbacks, last))
            if self.idle_ms:
                self._alarm()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        elif was_active:
            self.session.clear()
            self.ended.update((session.phase, last))
            self._alarm()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session, last = self._session()
        if session.phase == "ACTIVE" and last is not None:
            for x in session.told(key[0], {"kind": "finalize"}):
                yield _row((*x[:7], "idle", *x[8:]))
            self.session.clear()
            self.ended.update((session.phase, last))

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """``rows`` through a keyed processor; keyed state with maps and timers needs RocksDB as the session's state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithState(processor, schema, "append", time_mode)


def stitch_stream(events: DataFrame, *, rollback: bool = True, capacity: int | None = None, idle_ms: int | None = None, late_ms: int = 3_600_000) -> DataFrame:
    """The batch fold over a stream of events that arrive in order per session, those of one trigger in any order.

    State is a map entry per chain, per piece of a chain and per open request, so an event reads the chains' counters
    and rewrites the entries that it is about. An event behind a later one of its session that an earlier trigger had
    gives a row with problem ``... out of order`` and is left out. A finalized or aborted session leaves its phase, by
    which late events are told, for ``late_ms``. ``idle_ms`` finalizes sessions without events for so long, with reason
    ``idle``; without it they stay open. Times are those of processing.
    """
    log = digested(events).withColumns({"n": F.size("prefix"), "size": encoded_size()}).drop("logprobs", "calls", "error")
    folded = _keyed(log, "session_id", _Stitching(rollback, capacity, idle_ms, late_ms), FOLD_SCHEMA, "processingTime")
    kept = [c for c in folded.columns if c not in ("session_id", "trajectory_index", "pieces")]
    return folded.select("session_id", "trajectory_index", *[c.alias(n) for n, c in assembled(F.col("pieces")).items()], *kept)


def run_available(stream: DataFrame, folder: str, *, clock: str = "none") -> DataFrame:
    """All that a stream gives for the input that is there now, as a table in ``folder``, which executors share.

    ``clock`` says by which time the stream's operators act: those that go by processing time could always act once
    more, so only batches with input are run for them. Each trigger opens and commits every part of the state, so there
    are no more parts than the cores can take in two rounds.
    """
    spark = stream.sparkSession
    own = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))}
    if clock == "processing":
        own["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def upsert(stream: DataFrame, folder: str):
    """A started query that logs the changed rows of an aggregation (update mode), a folder per trigger, by its number.

    A trigger that is run again after a failure overwrites its own folder, so nothing counts twice; a trigger writes what
    changed in it, not the whole table. See ``current`` and ``compact``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()


def _bases(spark: SparkSession, folder: str) -> list[int]:
    """Up to which triggers the log has been compacted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/base")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    done = [f.getPath() for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def current(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """The last row of each key in a log of changes: the last compaction and what came behind it."""
    names = [c.split()[0] for c in schema.split(", ")]
    changes = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/changes")
    bases = _bases(spark, folder)
    if bases:
        base = spark.read.schema(schema).parquet(f"{folder}/base/upto={bases[-1]}").withColumn("batch", F.lit(bases[-1]).cast("long"))
        changes = changes.where(F.col("batch") > bases[-1]).unionByName(base)
    return changes.groupBy(key).agg(F.max_by(F.struct(*[n for n in names if n != key]), "batch").alias("r")).select(key, "r.*")


def compact(spark: SparkSession, folder: str, schema: str, key: str, upto: int) -> None:
    """Write the rows as they are after trigger ``upto``, which must have ended; readers start from there.

    A compaction that was not finished isn't read, and may be written again.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    changes = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/changes").where(F.col("batch") <= upto)
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[n for n in names if n != key]), "batch").alias("r")).select(key, "r.*")
    last.write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")


def run_counts(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """The counts of an aggregation over the input that is there now, by way of its log of changes."""
    upsert(stream, folder).awaitTermination()
    schema = ", ".join(f"{name} {kind}" for name, kind in stream.dtypes)
    return current(stream.sparkSession, folder, schema, key)


def chat_events(lines: DataFrame, bot: str, *, heartbeats: bool = False) -> DataFrame:
    """Inbound chat events of a stream (or table) of JSON lines: malformed lines, own messages and other types go.

    With ``heartbeats``, lines whose only use is their ``heartbeat`` (milliseconds) come as rows without a chat: they tell
    ``chat_turns`` that no event before that time is on its way.
    """
    v = F.try_parse_json("value")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    names = ("chat_id", "message_id", "sender_id", "chat_type", "message_type", "content", "create_time")
    beat = get("heartbeat").isNotNull() if heartbeats else F.lit(False)
    needed = [F.coalesce(get(k), F.lit("")) != "" for k in ("chat_id", "message_id", "sender_id")]
    wanted = needed[0] & needed[1] & needed[2] & (get("sender_id") != bot) & get("message_type").isin("text", "post")
    out = lines.where(F.schema_of_variant(v).startswith("OBJECT") & F.coalesce(beat | wanted, F.lit(False)))
    if not heartbeats:
        return out.select(*[get(k).alias(k) for k in names])
    return out.select(*[F.when(~beat, get(k)).alias(k) for k in names[:-1]], F.when(beat, get("heartbeat")).otherwise(get("create_time")).alias("create_time"))


class _Turns(StatefulProcessor):
    """A chat's next ordinal, and its events that wait for the watermark, as a list with one timer, for the earliest.

    A trigger's events are appended at once, and those that are due are taken at once: state is asked per chat and
    trigger, not per event.
    """

    def __init__(self, wait: bool) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "next long")
        self.waiting = handle.getListState("waiting", "at long, message_id string, create_time string, content string")
        self.first = handle.getValueState("first", "at long")

    def _turns(self, chat: str, events: list[tuple[str, str, str]]) -> Iterator[Row]:
        start = self.next.get()[0] if self.next.exists() else 0
        for n, (message_id, create_time, content) in enumerate(events):
            yield Row(chat_id=chat, ordinal=start + n, message_id=message_id, create_time=create_time, content=content)
        if events:
            self.next.update((start + len(events),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        rows = sorted(rows, key=lambda r: (r["at_ms"] is not None, r["at_ms"] or 0, r["create_time"] or "", r["message_id"] or ""))
        at_once = [r for r in rows if not self.wait or r["at_ms"] is None]
        yield from self._turns(key[0], [(r["message_id"], r["create_time"], r["content"]) for r in at_once])
        later = [(r["at_ms"], r["message_id"], r["create_time"], r["content"]) for r in rows[len(at_once) :]]
        if later:
            self.waiting.appendList(later)
            self._wake(later[0][0])

    def _wake(self, at: int) -> None:
        """See to a timer for ``at``, or for an earlier time that is set already."""
        first = self.first.get()[0] if self.first.exists() else None
        if first is not None and first <= at:
            return
        if first is not None:
            self.handle.deleteTimer(first)
        self.first.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1] or "", x[2] or "", x[3] or ""))
        due = [x for x in waiting if x[0] <= passed]
        left = waiting[len(due) :]
        self.first.clear()
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        yield from self._turns(key[0], [x[1:] for x in due])

    def close(self) -> None:
        pass


def chat_turns(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Chat events with their ``ordinal`` in their chat (SS10): turns of a chat in order, different chats in parallel.

    Order is by create_time (milliseconds) and message_id. With ``lateness`` events wait in keyed state until the
    watermark has passed them, so the order holds whichever triggers they come in, if none is later than that; later ones
    are dropped by the watermark, and the last ones wait for a later event of any chat or a heartbeat. Without it, each
    trigger's events are ordered and told at once. Events whose time is no number don't wait; those of the epoch's first instant count as late. A chat's state is its next
    ordinal and what waits.
    """
    ms = F.expr("try_cast(create_time AS bigint)")
    own = events.select("chat_id", "message_id", "create_time", "content", ms.alias("at_ms"))
    if lateness is not None:
        own = own.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", lateness)
    return _keyed(own, "chat_id", _Turns(lateness is not None), "chat_id string, ordinal long, message_id string, create_time string, content string", "none" if lateness is None else "eventTime")


def running_outcomes(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome, for update mode (SS11)."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """Events per window and type, behind a watermark. Spark's own operators; the survey lists no counterpart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))

"""Stitching a session's requests into chains: joins for sessions that only go on, one fold for those that branch.

Events of a session, in order of ``seq`` (unique in a session): ``prepare`` (a request arrives), ``commit`` (its
generation ends, with an ``error`` if it failed), ``reward``, ``finalize`` and ``abort``. The codec is one token per code
point. Messages are hashed, encoded and measured by Spark, in canonical form, and requests meet the histories that they
continue in a join over prefix hashes (``matching``). Where each request continues at most one chain that nothing else
continues, joins give the trajectories. Other sessions (replaced answers, ties, overlapping requests, late events) go
through the fold, which sees lengths and matches only and says which messages and answers a trajectory is made of; their
texts are joined back afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions import tokens
from trajlake.functions.messages import canonical_message, prefix_digests
from trajlake.functions.variants import field as member, items, string
from trajlake.operators import matching
from trajlake.session import cut, stored

EVENT_SCHEMA = "session_id string, seq long, kind string, request_id long, messages string, tools string, output string, min_version int, max_version int, error string, reward string"
PIECE = "struct<part:int,seq:long,first:int,last:int,call:boolean,text:string>"
FOLD_SCHEMA = f"session_id string, trajectory_index int, pieces array<{PIECE}>, num_turns int, min_version int, max_version int, reward string, reason string, problem string, rollbacks int, dropped_tokens long"
CALL = "assistant:"
#: Parts of a trajectory: its prompt, context that was appended to it, and answers.
PROMPT, CONTEXT, ANSWER = 0, 1, 2


def digested(events: DataFrame) -> DataFrame:
    """Events with what stitching needs of their texts: prefix hashes, encoded texts and their lengths, roles, the answer's hash.

    Hashes are of canonical messages (``canonical_message``): call ids don't count, and arguments count by value. A
    commit may carry ``calls`` (JSON list of tool calls) and ``logprobs`` (one per token of its output).
    """
    for name, kind in (("calls", "string"), ("logprobs", "array<double>")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    digest = lambda m: F.sha2(F.to_json(canonical_message(m)), 256)
    content = lambda m: F.coalesce(string(member(m, "content")), F.to_json(member(m, "content")), F.lit(""))
    encoded = lambda m: F.concat(string(member(m, "role")), F.lit(":"), content(m), F.lit("\n"))
    spoken = lambda m: string(member(m, "role")).isin("user", "assistant")
    answer = F.parse_json(F.to_json(F.struct(F.col("output").alias("content"), F.lit("assistant").alias("role"), F.parse_json("calls").alias("tool_calls"))))
    rows = events.withColumn("_m", F.coalesce(items(F.try_parse_json("messages")), F.array().cast("array<variant>")))
    return rows.select(
        *[c for c in events.columns if c != "messages"],
        prefix_digests(F.transform("_m", digest)).alias("prefix"), F.transform("_m", encoded).alias("texts"),
        F.transform(F.transform("_m", encoded), lambda t: F.length(t)).alias("lengths"), F.size(F.filter("_m", spoken)).alias("spoken"),
        F.when(F.col("kind") == "commit", digest(answer)).alias("answer_digest"), F.length("output").alias("output_length"),
        (F.col("error").isNotNull() | F.coalesce(F.col("logprobs").isNotNull() & (F.size("logprobs") != F.length("output")), F.lit(False))).alias("failed"),
    )


#: The fold's rows for Arrow.
_PIECES = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("call", pa.bool_()), ("text", pa.string())]))
FOLD_ARROW = pa.schema([("session_id", pa.string()), ("trajectory_index", pa.int32()), ("pieces", _PIECES), ("num_turns", pa.int32()), ("min_version", pa.int32()), ("max_version", pa.int32()), ("reward", pa.string()), ("reason", pa.string()), ("problem", pa.string()), ("rollbacks", pa.int32()), ("dropped_tokens", pa.int64())])


@dataclass
class Piece:
    """A run of messages of a request (``first`` to ``last``), or an answer, with the versions that it was made by."""

    part: int
    seq: int
    first: int
    last: int
    size: int
    call: bool
    text: str | None
    low: int | None = None
    high: int | None = None

    def row(self) -> dict:
        return {"part": self.part, "seq": self.seq, "first": self.first, "last": self.last, "call": self.call, "text": self.text}


@dataclass
class Chain:
    """A chain's counters; its pieces are kept beside it, by its number and theirs."""

    number: int
    tools: str
    pieces: int = 0
    prompt: int = 0  # tokens of the prompt, and of all behind it
    response: int = 0
    told: int = 0  # the latter before the last answer
    last: int = 0  # seq of the last answered request
    at: int = 0  # messages before the last answer
    start: str = ""  # their hash, and that of the whole history, where requests come with hashes
    tip: str = ""
    spoken: int = 0
    updated: int = 0
    reserved: bool = False
    reason: str | None = None


@dataclass
class Request:
    """A request that is under way; ``hash`` is that of its messages, where requests come with hashes."""

    chain: int | None
    replace: bool
    tools: str
    spoken: int
    hash: str
    part: int
    seq: int
    first: int
    last: int
    size: int
    text: str | None


#: Of a request and a chain: encoded lengths of the request's messages up to before and up to behind the chain's last
#: answer, the latter none where it doesn't agree; nothing where the messages before it don't.
Fit = Callable[[dict, Chain], "tuple[int, int | None] | None"]


def fit_by_match(e: dict, chain: Chain) -> tuple[int, int | None] | None:
    """From the matches that a join has found."""
    return e["fits"].get(chain.last)


def fit_by_hash(e: dict, chain: Chain) -> tuple[int, int | None] | None:
    """From the prefix hashes that a request carries."""
    prefix, at = e["prefix"], chain.at
    if at >= len(prefix) or (prefix[at - 1] if at else "") != chain.start:
        return None
    return sum(e["lengths"][:at]), sum(e["lengths"][: at + 1]) if prefix[at] == chain.tip else None


@dataclass
class Session:
    """State of a session; ``apply`` takes events and returns chains once it is finalized. Texts are kept if events have them.

    The mappings are read and written by whole values, so they may be kept elsewhere: an event touches the chain and
    the request that it is about and no more than three pieces.
    """

    rollback: bool = True
    capacity: int | None = None
    fit: Fit = fit_by_match
    phase: str = "ACTIVE"
    chains: MutableMapping[int, Chain] = field(default_factory=dict)
    pieces: MutableMapping[tuple[int, int], Piece] = field(default_factory=dict)
    pending: MutableMapping[int, Request] = field(default_factory=dict)
    created: int = 0
    order: int = 0
    reward: str | None = None
    dropped: int = 0
    rollbacks: int = 0
    problems: list[str] = field(default_factory=list)

    def select(self, e: dict) -> tuple[Chain | None, bool, int]:
        """(chain to continue, whether its last answer is replaced, encoded length of what the request shares with it).

        A chain fits exactly if its history is a prefix of the request, at the history's length; else, at the messages
        before its last answer, if those are one. The longest fit wins, exact before replacing, then the latest. Chains
        that tie for the deepest replacement are left out, and if no exact fit is as deep, nothing fits.
        """
        fits, replacing = [], {}
        for c in self.chains.values():
            if c.reserved or c.reason or c.tools != (e["tools"] or "") or (found := self.fit(e, c)) is None:
                continue
            before, whole = found
            if whole is not None:
                fits.append((c.at + 1, 1, c.updated, c.number, whole, c))
            elif self.rollback and c.told:
                replacing.setdefault(c.at, []).append((c.at, 0, c.updated, c.number, before, c))
        if replacing:
            deepest = max(replacing)
            if len(replacing[deepest]) == 1:
                fits += replacing[deepest]
            elif not any(f[0] >= deepest for f in fits):
                return None, False, 0
        if not fits:
            return None, False, 0
        _, exact, _, _, shared, chain = max(fits, key=lambda f: f[:4])
        return chain, not exact, shared

    def roll_back(self, chain: Chain) -> int:
        """Take back the last answer and the call for it; returns the answer's tokens."""
        answer = self.pieces.pop((chain.number, chain.pieces - 1))
        before = self.pieces[chain.number, chain.pieces - 2]
        before.call = False
        self.pieces[chain.number, chain.pieces - 2] = before
        chain.pieces -= 1
        chain.response = chain.told - len(CALL)
        return answer.size

    def prepare(self, e: dict) -> None:
        chain, replace, shared = self.select(e)
        first = 0 if chain is None else chain.at + (not replace)
        text = None if e.get("texts") is None else "".join(e["texts"][first:])
        hash_ = e["prefix"][-1] if e.get("prefix") else ""
        request = Request(chain and chain.number, replace, e["tools"] or "", e["spoken"], hash_, PROMPT if chain is None else CONTEXT, e["seq"], first, e["n"], e["size"] - shared, text)
        if chain is None:
            if self.capacity is None or request.size + len(CALL) < self.capacity:
                self.pending[e["request_id"]] = request
            return
        kept = chain.told - len(CALL) if replace else chain.response
        if self.capacity is not None and chain.prompt + kept + request.size + len(CALL) >= self.capacity:
            if replace:
                self.roll_back(chain)
            self.order += 1
            chain.reason, chain.updated = "max_trajectory_length", self.order
        else:
            chain.reserved = True
            self.pending[e["request_id"]] = request
        self.chains[chain.number] = chain

    def add(self, chain: Chain, piece: Piece) -> None:
        self.pieces[chain.number, chain.pieces] = piece
        chain.pieces += 1
        size = piece.size + len(CALL) * piece.call
        if piece.part == PROMPT:
            chain.prompt += size
        else:
            chain.response += size

    def commit(self, e: dict) -> None:
        request = self.pending.pop(e["request_id"], None)
        if request is None:
            return
        chain = None if request.chain is None else self.chains[request.chain]
        if e["failed"]:
            if chain:
                chain.reserved = False
                self.chains[chain.number] = chain
            return
        self.order += 1
        if chain is None:
            self.created += 1
            chain = Chain(self.created, request.tools)
        elif request.replace:
            self.rollbacks += 1
            self.dropped += self.roll_back(chain)
        self.add(chain, Piece(request.part, request.seq, request.first, request.last, request.size, True, request.text))
        chain.told = chain.response
        self.add(chain, Piece(ANSWER, e["seq"], 0, 0, e["output_length"] or 0, False, e.get("output"), e["min_version"], e["max_version"]))
        chain.last, chain.at, chain.start, chain.reserved = request.seq, request.last, request.hash, False
        chain.tip = hashlib.sha256(f"{request.hash}\n{e['answer_digest']}".encode()).hexdigest()
        chain.spoken, chain.updated = request.spoken + 1, self.order
        self.chains[chain.number] = chain

    def apply(self, e: dict) -> list[tuple[Chain, list[Piece]]]:
        kind = e["kind"]
        if self.phase != "ACTIVE":
            if not (kind == "abort" and self.phase == "ABORTED"):
                self.problems.append(f"{kind} after {self.phase}")
            return []
        if kind == "prepare":
            self.prepare(e)
        elif kind == "commit":
            self.commit(e)
        elif kind == "reward":
            self.reward = e["reward"] if e["reward"] is not None else self.reward
        elif kind in ("abort", "finalize"):
            self.phase = {"abort": "ABORTED", "finalize": "FINALIZED"}[kind]
            done = sorted(self.chains.values(), key=lambda c: c.updated) if kind == "finalize" else []
            done = [(c, [self.pieces[c.number, i] for i in range(c.pieces)]) for c in done]
            for kept in (self.chains, self.pieces, self.pending):
                kept.clear()
            return done
        return []

    def told(self, session_id: str, e: dict) -> Iterator[tuple]:
        """Rows (``FOLD_SCHEMA``) that an event gives: trajectories that it completes, or a problem if it came too late."""
        for i, (c, pieces) in enumerate(self.apply(e)):
            low, high = [p.low for p in pieces if p.low is not None], [p.high for p in pieces if p.low is not None]
            yield session_id, i, [p.row() for p in pieces], c.spoken + 1, min(low, default=None), max(high, default=None), self.reward, c.reason, None, self.rollbacks, self.dropped
        for p in self.problems:
            yield session_id, *[None] * 7, p, None, None
        self.problems = []


def _folded(batches: Iterator[pa.RecordBatch], rollback: bool, capacity: int | None) -> Iterator[pa.RecordBatch]:
    """The fold over events sorted by session and seq, many sessions a batch; one session's state at a time."""
    session_id, session = None, None
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            if session is None or e["session_id"] != session_id:
                session_id, session = e["session_id"], Session(rollback=rollback, capacity=capacity)
            e["fits"] = {f["r"]: (f["start"], f["whole"]) for f in e["fits"] or []}
            out += session.told(session_id, e)
        yield pa.RecordBatch.from_pylist([dict(zip(FOLD_ARROW.names, r, strict=True)) for r in out], FOLD_ARROW)


def fold(log: DataFrame, requests: DataFrame, *, rollback: bool, capacity: int | None) -> DataFrame:
    """The fold over a digested log (``FOLD_SCHEMA``); requests come with their lengths and matches, not with messages."""
    rungs = matching.ladder(requests.where("asked"))
    behind = Window.partitionBy("session_id", "request_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A request's answer is the next commit of its id; ids may come again.
    answer = F.last(F.when(F.col("kind") == "commit", F.struct(F.col("seq").alias("done"), "answer_digest")), ignorenulls=True).over(behind)
    asked = log.where("kind IN ('prepare', 'commit')").select("session_id", "seq", "kind", F.coalesce("tools", F.lit("")).alias("tools"), "prefix", answer.alias("a"))
    answered = asked.where("kind = 'prepare' AND a IS NOT NULL").select("session_id", "seq", "tools", "prefix", "a.*")
    fits = matching.matches(rungs, matching.histories(answered))
    thin = log.select("session_id", "seq", "kind", "request_id", "tools", F.size("prefix").alias("n"), encoded_size().alias("size"), "spoken", "output_length", "answer_digest", "failed", "min_version", "max_version", "reward")
    events = thin.join(fits, ["session_id", "seq"], "left").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return events.mapInArrow(lambda it: _folded(it, rollback, capacity), FOLD_SCHEMA)


def assembled(pieces: Column) -> dict[str, Column]:
    """prompt_ids, response_ids and response_mask of pieces (part, call, text) in order."""
    text = lambda p: F.concat(p["text"], F.when(p["call"], CALL).otherwise(""))
    joined = lambda keep: F.array_join(F.transform(F.filter(pieces, keep), text), "")
    mask = F.flatten(F.transform(F.filter(pieces, lambda p: p["part"] != PROMPT), lambda p: F.array_repeat((p["part"] == ANSWER).cast("tinyint"), F.length(text(p)))))
    return {"prompt_ids": tokens.code_points(joined(lambda p: p["part"] == PROMPT)), "response_ids": tokens.code_points(joined(lambda p: p["part"] != PROMPT)), "response_mask": mask}


ROW = ("num_turns", "min_version", "max_version", "reward", "reason", "problem", "rollbacks", "dropped_tokens")


def encoded_size() -> Column:
    """Encoded length of all of a request's messages."""
    return F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)


def _linear(log: DataFrame, capacity: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, branching, pieces): the log's requests; sessions for the fold; the pieces of all other trajectories.

    A session needs the fold if requests overlap or ids don't pair up, events follow its end, a request continues a
    history that another one continues too or that several chains have, agrees with a chain up to before an answer that
    may be replaced, or reaches the capacity. Failed requests leave nothing.
    """
    requests = stored(matching.exchanges(log))
    ends = log.groupBy("session_id").agg(F.count_if(F.col("kind").isin("finalize", "abort")).alias("ends"), F.max_by("kind", "seq").alias("last"), F.max_by("reward", F.when(F.col("reward").isNotNull(), F.col("seq"))).alias("reward"))
    ends = cut(ends.where("ends > 0"))
    answered = requests.where("asked AND NOT broken AND done IS NOT NULL AND NOT failed")
    rungs, known = matching.ladder(requests.where("asked")), matching.histories(answered)
    found = cut(matching.predecessors(rungs, known))
    replied = known.join(found.select("session_id", F.col("seq").alias("r")), ["session_id", "r"], "left_semi")
    forks = answered.select("session_id", "seq").join(found, ["session_id", "seq"]).groupBy("session_id", "pred").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    branching = ends.where("ends > 1 OR last NOT IN ('finalize', 'abort')").select("session_id")
    for more in (requests.where("broken"), found.where("ambiguous"), forks, matching.replaceable(rungs, replied)):
        branching = branching.unionByName(more.select("session_id").distinct())
    if capacity is not None:
        # A chain's tokens are no more than those of the request that goes on from it.
        branching = branching.unionByName(requests.where("asked").where(encoded_size() + len(CALL) >= capacity).select("session_id").distinct())
    branching = cut(branching.distinct().join(ends.select("session_id"), "session_id", "left_semi"))
    links = answered.join(branching, "session_id", "left_anti").join(ends.where("last = 'finalize'").select("session_id", "reward"), "session_id")
    links = links.join(found.select("session_id", "seq", "pred"), ["session_id", "seq"], "left")
    links = cut(links.select("session_id", "seq", "done", "pred", "reward", F.size("prefix").alias("n"), "spoken", "min_version", "max_version"))
    chained = links.join(matching.follow(links.select("session_id", "seq", "pred")), ["session_id", "seq"])
    low, high = (F.when(F.col("min_version").isNotNull(), F.col(c)) for c in ("min_version", "max_version"))
    whole = chained.groupBy("session_id", "root").agg(F.max("done").alias("updated"), F.max_by("spoken", "seq").alias("spoken"), F.min(low).alias("min_version"), F.max(high).alias("max_version"), F.first("reward").alias("reward"))
    index = (F.row_number().over(Window.partitionBy("session_id").orderBy("updated")) - 1).alias("trajectory_index")
    none = F.lit(None).cast("string")
    row = F.struct((F.col("spoken") + 2).alias("num_turns"), "min_version", "max_version", "reward", none.alias("reason"), none.alias("problem"), F.lit(0).alias("rollbacks"), F.lit(0).cast("long").alias("dropped_tokens"))
    whole = whole.select("session_id", "root", index, row.alias("row"))
    before = chained.select("session_id", F.col("seq").alias("pred"), (F.col("n") + 1).alias("first"))
    parts = chained.join(before, ["session_id", "pred"], "left").join(whole, ["session_id", "root"])
    asked = F.struct(F.when(F.col("pred").isNull(), PROMPT).otherwise(CONTEXT).alias("part"), "seq", F.coalesce("first", F.lit(0)).alias("first"), F.col("n").alias("last"), F.lit(True).alias("call"))
    answer = F.struct(F.lit(ANSWER).alias("part"), F.col("done").alias("seq"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(False).alias("call"))
    pieces = parts.select("session_id", "trajectory_index", "row", F.explode(F.array(asked, answer)).alias("p"))
    return requests, branching, pieces.select("session_id", "trajectory_index", "row", F.col("p.seq").alias("pos"), "p.*")


def stitch(events: DataFrame, *, rollback: bool = True, capacity: int | None = None) -> DataFrame:
    """Trajectories of all sessions of an event log (``EVENT_SCHEMA``), and a row with ``problem`` for each late event.

    Sessions that only go on are stitched by joins (``matching``); the others' lengths and matches go through the fold,
    if there are any: Python never sees a text or a list of messages. Texts are joined to the pieces that a trajectory
    keeps, a line per piece, so no text is repeated however often later requests repeat it. ``response_logprobs`` has
    the commits' logprobs, 0 for context, and is null where a commit has none.
    """
    log = digested(events)
    thin = stored(log.drop("texts", "output", "logprobs", "calls", "error"))
    requests, branching, pieces = _linear(thin, capacity)
    key, late = ["session_id", "trajectory_index"], None
    if not branching.isEmpty():
        own = thin.join(branching, "session_id", "left_semi")
        folded = cut(fold(own, requests.join(branching, "session_id", "left_semi"), rollback=rollback, capacity=capacity))
        late = folded.where("problem IS NOT NULL").drop("pieces")
        more = folded.where("problem IS NULL").select(*key, F.struct(*ROW).alias("row"), F.posexplode("pieces").alias("pos", "p"))
        pieces = pieces.unionByName(more.select(*key, "row", F.col("pos").cast("long").alias("pos"), "p.*").drop("text"))
    text = F.when(F.col("part") == ANSWER, F.col("output")).otherwise(F.array_join(F.slice("texts", F.col("first") + 1, F.col("last") - F.col("first")), ""))
    found = pieces.join(log.select("session_id", "seq", "texts", "output", "logprobs"), ["session_id", "seq"])
    found = found.select(*key, "row", F.struct("pos", "part", "call", text.alias("text"), "logprobs").alias("p"))
    whole = found.groupBy(*key).agg(F.first("row").alias("row"), F.array_sort(F.collect_list("p")).alias("pieces"))
    zeros = lambda p: F.array_repeat(F.lit(0.0), F.length(p["text"]) + F.when(p["call"], len(CALL)).otherwise(0))
    logprobs = F.flatten(F.transform(F.filter("pieces", lambda p: p["part"] != PROMPT), lambda p: F.when(p["part"] == ANSWER, p["logprobs"]).otherwise(zeros(p))))
    parts = assembled(F.col("pieces"))
    done = whole.select(*key, *[c.alias(n) for n, c in parts.items()], logprobs.alias("response_logprobs"), "row.*")
    return done if late is None else done.unionByName(late, allowMissingColumns=True)


def rollback_counters(trajectories: DataFrame) -> DataFrame:
    """Replaced answers of each session, and the trainable tokens that went with them (AG18)."""
    done = trajectories.where("trajectory_index IS NOT NULL")
    return done.groupBy("session_id").agg(F.max("rollbacks").alias("rollbacks"), F.max("dropped_tokens").alias("dropped_tokens"))

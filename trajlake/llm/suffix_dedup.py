"""Removal of long repeated byte strings, within and across documents, by suffix arrays of the places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import shared_folder, stored
from trajlake.llm.shingles import mix
from trajlake.llm.suffix_array import common_prefixes, suffix_array

#: Bytes of a string that may not occur twice, and of the core by which its occurrences meet.
WINDOW, CORE = 200, 64
#: Places of a core in a window, counted from the window's start.
PLACES = WINDOW - CORE + 1
#: Different contexts of a core from which on its places are split, and parts that they are split into.
MANY, PARTS = 512, 4
#: Texts at a time, bytes that are hashed at a time, and bytes of a suffix array, if a core's contexts have not more.
ROWS, CHUNK, ARRAY = 256, 1 << 16, 1 << 20

#: A probe: the core's place in the text, the part of the core's places in a window that it belongs to (``lo`` to ``hi``),
#: those that it stands for (``low`` to ``high``), and the hashes of what its windows share and of what they reach.
PROBE = "struct<at:int,lo:int,hi:int,low:int,high:int,key:long,c1:long,c2:long>"
_PROBE = pa.list_(pa.struct([(n, pa.int32()) for n in ("at", "lo", "hi", "low", "high")] + [(n, pa.int64()) for n in ("key", "c1", "c2")]))
SPAN = "struct<start:int,stop:int>"
_BYTES = np.random.default_rng(13).integers(1, 2**63, size=256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (least or largest) over each run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def core_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``CORE`` bytes from each place on, by doubling."""
    x, done, factor = _BYTES[data], 1, _FACTOR
    while done < CORE:
        x = x[:-done] * np.uint64(factor) + x[done:]
        done, factor = done * 2, factor * factor % 2**64
    return mix(x)


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each run of ``width`` hashes, the first of equal ones, by doubling."""
    place, least, done = np.arange(len(hashes), dtype=np.int32), hashes, 1
    while done < width:
        step = min(done, width - done)
        left, right = least[:-step], least[step:]
        place = np.where(left <= right, place[:-step], place[step:])
        least = np.minimum(left, right)
        done += step
    return place


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, last, hashes): the core of least hash of each window, and the first and last window that it is that of.

    Texts end at ``ends``, windows don't cross them. Which core of a window is its anchor depends on its bytes alone, so
    equal windows have theirs at the same place.
    """
    if len(data) < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    hashes = core_hashes(data)
    place = _least(hashes, PLACES)
    inside = np.ones(len(place), dtype=bool)
    for end in ends[:-1]:
        inside[max(end - WINDOW + 1, 0) : end] = False
    new = np.append(True, place[1:] != place[:-1])
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    whole = inside[first]
    first, last = first[whole], last[whole]
    return place[first].astype(np.int64), first, last, hashes[place[first]]


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(indices, starts, parts) of about ``CHUNK`` bytes; a longer text comes in parts that share ``WINDOW`` - 1 bytes."""
    rows, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), CHUNK):
            part = text[at : at + CHUNK + WINDOW - 1]
            if rows and size + len(part) > CHUNK + WINDOW:
                yield rows, starts, parts
                rows, starts, parts, size = [], [], [], 0
            rows.append(i)
            starts.append(at)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, starts, parts


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what tasks make of a text may be many times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: SHA-256, bytes, and its anchors: their places, least and largest place in a window (as one number), hashes."""
    for batch in _some(batches):
        texts = [x.as_py() or b"" for x in batch.column("text")]
        found: list[list[tuple]] = [[] for _ in texts]
        for rows, starts, parts in _blocks(texts):
            ends = np.cumsum([len(p) for p in parts])
            at, first, last, hashes = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends)
            reach = (at - last) * 256 + at - first
            cuts = np.searchsorted(at, ends)
            for n, (row, start) in enumerate(zip(rows, starts, strict=True)):
                own = slice(cuts[n - 1] if n else 0, cuts[n])
                found[row].append((at[own] - (ends[n - 1] if n else 0) + start, reach[own], hashes[own].view(np.int64)))
        lists = [[np.concatenate([f[i] for f in own]) if own else [] for own in found] for i in range(3)]
        columns = [batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
        columns += [pa.array(x, pa.list_(kind)) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "n_bytes", "at", "reach", "keys"])


def _probe(text: bytes, at: int, lo: int, hi: int, low: int, high: int, key: int | None = None) -> dict:
    """What windows with the core at ``at`` at one of the places ``low`` to ``high``, of ``lo`` to ``hi``, look for.

    ``key`` is a hash of the bytes that all windows with the core at ``lo`` to ``hi`` have, ``c1`` and ``c2`` one of all
    bytes that this probe's windows reach.
    """
    if key is None:
        key = xxhash.xxh3_64_intdigest(text[at - lo : at - hi + WINDOW], seed=lo * 256 + hi)
    whole = xxhash.xxh3_128_intdigest(text[at - high : at - low + WINDOW], seed=low * 256 + high)
    signed = lambda x: (x & (2**64 - 1)) - ((x & 2**63) << 1)
    return {"at": at, "lo": lo, "hi": hi, "low": low, "high": high, "key": signed(key), "c1": signed(whole >> 64), "c2": signed(whole)}


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with probes: of anchors that are given, or over parts of the places of probes that are."""
    for batch in _some(batches):
        probes = []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            text, own = text.as_py(), []
            for p in found.as_py():
                if "reach" in p:
                    own.append(_probe(text, p["at"], 0, PLACES - 1, *divmod(p["reach"], 256), p["key"]))
                    continue
                edges = [p["lo"] + (p["hi"] + 1 - p["lo"]) * i // PARTS for i in range(PARTS + 1)]
                for lo, hi in zip(edges, (e - 1 for e in edges[1:]), strict=False):
                    low, high = max(lo, p["low"]), min(hi, p["high"])
                    if low <= high:
                        own.append(_probe(text, p["at"], lo, hi, low, high))
            probes.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "m", "text")), pa.array(probes, _PROBE)], ["rid", "m", "text", "probes"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that probes reach, and the core's place in them."""
    names = ("key", "c1", "c2", "m", "high")
    for batch in _some(batches):
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            text, probes = text.as_py(), found.as_py()
            context = [text[p["at"] - p["high"] : p["at"] - p["low"] + WINDOW] for p in probes]
            columns = [pa.array([p[n] for p in probes], pa.int64()) for n in names] + [pa.array(context, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names[:-1], "lead", "context"])


def repeated_spans(keys: np.ndarray, weights: np.ndarray, leads: np.ndarray, contexts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per context: spans, relative to its core, of the windows that occur more than once.

    The contexts are different ones, each with the number of its occurrences. A suffix array of all of them puts equal
    windows side by side, where neighbours have ``WINDOW`` bytes in common. Contexts of one text overlap, so that a
    window may be in several contexts: those of one core and place are different occurrences, and only those count.
    """
    sizes = np.array([len(c) for c in contexts])
    # Bytes are raised by one, so that 0 ends a context; UTF-8 has no byte 255.
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), dtype=np.uint8) + np.uint8(1)
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    places = np.arange(len(text)) - np.repeat(firsts, sizes + 1)
    order = suffix_array(text, WINDOW, places + WINDOW <= np.repeat(sizes, sizes + 1))
    own, place = owner[order], places[order]
    same = np.cumsum(common_prefixes(text, order, WINDOW) < WINDOW)
    _, core = np.unique(keys, return_inverse=True)
    occurrence = (same * len(keys) + core[own]) * PLACES + (leads[own] - place)
    _, kind = np.unique(occurrence, return_inverse=True)
    again = np.bincount(kind, weights=weights[own])[kind] >= 2
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    own, place = own[again], place[again]
    by = np.lexsort((place, own))
    own, place = own[by], place[by]
    new = np.append(True, (own[1:] != own[:-1]) | (place[1:] - place[:-1] > WINDOW))[: len(own)]
    last = np.append(new[1:], True)[: len(own)]
    for i, a, b in zip(own[new], place[new], place[last], strict=True):
        out[i].append((int(a - leads[i]), int(b - leads[i] + WINDOW)))
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c1, c2, spans) of contexts that come sorted by key: one suffix array for some keys' contexts at a time."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    names = ("key", "c1", "c2", "m", "lead", "context")

    def settled(rows: list[tuple]) -> pa.RecordBatch:
        key, c1, c2, m, lead, context = zip(*rows, strict=True)
        spans = repeated_spans(np.array(key), np.array(m), np.array(lead), list(context))
        spans = [[{"start": a, "stop": b} for a, b in own] for own in spans]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, c1, c2)] + [pa.array(spans, kind)], ["key", "c1", "c2", "spans"])

    rows, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if size > ARRAY and row[0] != rows[-1][0]:
                yield settled(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[-1])
    if rows:
        yield settled(rows)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few and as long as can be, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's merged spans and what is left of it."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in _some(batches):
        spans, kept = [], []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            text = text.as_py()
            own = merged([(s["start"], s["stop"]) for s in found.as_py()])
            edges = [0, *(x for s in own for x in s), len(text)]
            spans.append([{"start": a, "stop": b} for a, b in own])
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(spans, kind), pa.array(kept, pa.binary())], ["rid", "spans", "kept"])


def _written(texts: DataFrame) -> DataFrame:
    """``texts`` as a closely packed Parquet table in the shared folder."""
    path = shared_folder(texts.sparkSession)
    texts.write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(texts.schema).parquet(path)


def _spans_of(probes: DataFrame, texts: DataFrame, keys: DataFrame, contexts: DataFrame) -> DataFrame:
    """(rid, start, stop) of what repeats among the probes whose keys have few contexts."""
    few = contexts.join(keys.where(f"contexts <= {MANY}").select("key"), "key")
    ask = F.struct(*[F.col(f"rep.{c}").alias(c) for c in ("at", "low", "high")], "key", "c1", "c2", "m")
    asked = few.groupBy(F.col("rep.rid").alias("rid")).agg(F.collect_list(ask).alias("found")).join(texts.select("rid", "text"), "rid")
    rows = asked.select("text", "found").mapInArrow(_contexts, "key long, c1 long, c2 long, m long, lead long, context binary")
    rows = rows.repartition("key").sortWithinPartitions("key")
    spans = stored(rows.mapInArrow(_repeats, f"key long, c1 long, c2 long, spans array<{SPAN}>").where(F.size("spans") > 0))
    met = probes.join(spans, ["key", "c1", "c2"]).select("rid", "at", F.explode("spans").alias("s"))
    return met.select("rid", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.stop")).alias("stop"))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): per row doc_id, sha, n_bytes; per different text with repeats sha, spans and the kept bytes.

    1. One scan gives each text's anchors: the cores of 64 bytes that have the least hash of a window of 200 bytes, one in
       some 60 bytes. A window's anchor depends on its bytes alone, so equal windows have theirs at the same place.
    2. Copies of a text are one text with a weight. Cores that occur once go; texts with others are fetched once.
    3. The bytes that a core's windows reach are its context; equal contexts are one with a weight. The different
       contexts of a core meet in a task, where a suffix array shows which windows are equal.
    4. A core with more than ``MANY`` contexts is split by the place of the core in the window: windows with the core
       at different places are never the same. Each part has fewer bytes around it, so more contexts are equal, and a
       longer core, so others don't meet; with one place left, equal windows are one context. So no group that a task
       holds grows with the corpus, and nothing is left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    scanned = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = stored(scanned.mapInArrow(_anchored, f"doc_id {kind}, sha binary, n_bytes long, at array<int>, reach array<int>, keys array<long>").withColumn("rid", F.monotonically_increasing_id()))
    once = rows.where(f"n_bytes >= {WINDOW}").groupBy("sha").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("m"))
    texts = stored(rows.select("rid", "at", "reach", "keys").join(once, "rid"))
    # Written, so that the join reads two plain shuffles and Spark may split a frequent core's side.
    shared = stored(texts.select("m", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("m").alias("n")).where("n > 1").select("key"))
    found = texts.select("rid", F.explode(F.arrays_zip("at", "reach", "keys")).alias("a")).select("rid", "a.at", "a.reach", F.col("a.keys").alias("key")).join(shared, "key", "left_semi")
    found = found.groupBy("rid").agg(F.collect_list(F.struct("at", "reach", "key")).alias("found")).join(texts.select("rid", "sha", "m"), "rid")
    bodies = scanned.where(F.octet_length("text") >= WINDOW).select(F.unhex(F.sha2("text", 256)).alias("sha"), "text").groupBy("sha").agg(F.first("text").alias("text"))
    asked, bodies, own, spans = bodies.join(found, "sha"), None, None, None
    while True:
        # Each round's texts are those whose probes it has: all with a shared core at first, then few.
        own = _written(asked.select("rid", "m", "text", "found").mapInArrow(_probed, f"rid long, m long, text binary, probes array<{PROBE}>"))
        bodies = own if bodies is None else bodies
        probes = own.select("rid", "m", F.explode("probes").alias("p")).select("rid", "m", "p.*")
        rep = F.min(F.struct("rid", "at", "low", "high")).alias("rep")
        contexts = stored(probes.groupBy("key", "c1", "c2").agg(F.sum("m").alias("m"), rep))
        keys = stored(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.sum("m").alias("n")).where("n > 1").select("key", "contexts"))
        more = _spans_of(probes, own, keys, contexts)
        spans = more if spans is None else spans.unionByName(more)
        hot = keys.where(f"contexts > {MANY}").select("key")
        if hot.isEmpty():
            break
        split = probes.join(hot, "key", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("at", "lo", "hi", "low", "high")).alias("found"))
        asked = own.select("rid", "m", "text").join(stored(split), "rid")
    covered = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("found")).join(bodies.select("rid", "text"), "rid")
    kept = covered.select("rid", "text", "found").mapInArrow(_removed, f"rid long, spans array<{SPAN}>, kept binary")
    return rows.select("doc_id", "sha", "n_bytes"), kept.join(texts.select("rid", "sha"), "rid").drop("rid")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what is left once repeats are removed.

    Each byte goes that is covered by a string of 200 bytes which also starts anywhere else, in another document or the
    same; strings are judged on the input. See ``find_repeats`` for the texts and spans themselves.

    Defined results: a null text counts as empty; texts under 200 bytes stay whole; copies, repeated rows among them, lose
    all their bytes; texts of any length are searched whole; matches never cross documents; ids may repeat or be null; an
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows, texts = find_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    texts = stored(texts.select("sha", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(texts, "sha", "left").select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))

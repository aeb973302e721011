"""Best-fit decreasing packing of documents' tokens into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import cut

#: Pieces of one length are ranked in so many slices, so that no length has to be sorted by one task.
SLICES = 1024
#: The vocabulary's added token and its id. A text that holds it gets that id there.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(2)  # of a Python worker
def _encoding(ranks_path: str):
    """The public vocabulary as tiktoken has it: the ids are those that tokenizers gives with the JSON file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(texts: Iterable[str | None], ranks_path: str) -> Iterator[np.ndarray]:
    """Token ids (unsigned 32-bit) of whole texts, one at a time; null counts as empty."""
    encode = _encoding(ranks_path).encode_to_numpy
    for text in texts:
        yield encode(text if isinstance(text, str) else "", allowed_special="all").astype("<u4", copy=False)


#: Ids that a batch of pieces holds at most, beyond one document's.
_IDS = 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch], ranks_path: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def pieces(doc_id: pa.Array, rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        row, piece, start, length, crc = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        columns = [doc_id.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).view("<i4"))))
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        rows, held, total = [], [], 0
        for row, own in enumerate(token_ids((x.as_py() for x in batch.column("text")), ranks_path)):
            own = np.append(own, np.uint32(end_id)).astype("<u4", copy=False)
            edges = [0, *range(len(own) % size or size, len(own) + 1, size)]  # the first piece takes what full ones leave
            rows += [(row, k, a, b - a, zlib.crc32(own[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            total += len(own)
            if with_ids:
                held.append(own)
            if total > _IDS:
                yield pieces(batch.column("doc_id"), rows, held)
                rows, held, total = [], [], 0
        yield pieces(batch.column("doc_id"), rows, held)


class CapacityTree:
    """Runs of bins by remaining capacity, under a segment tree that finds the tightest capacity that still fits."""

    def __init__(self, size: int):
        self._n = 1 << size.bit_length()
        self._any = [False] * (2 * self._n)
        self._runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        i = capacity + self._n
        self._any[i] = bool(self._runs[capacity])
        while i > 1:
            i //= 2
            self._any[i] = self._any[2 * i] or self._any[2 * i + 1]

    def push(self, capacity: int, first: int, count: int) -> None:
        if count:
            self._runs[capacity].append((first, count))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self._runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that some bin has."""
        i = need + self._n
        if self._any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self._any[i + 1]:
                i += 1
                while i < self._n:
                    i = 2 * i if self._any[2 * i] else 2 * i + 1
                return i - self._n
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing for ``counts[length]`` pieces, as rules over each length's pieces in order.

    A rule (length, first, first_bin, per_bin, offset) places the pieces from number ``first`` on: ``per_bin`` in each
    bin from ``first_bin``, from ``offset``. Bins of one remaining capacity are interchangeable, so pieces of a length
    go to a whole run of bins at a time: the result is that of placing the pieces one by one, each in the tightest open
    bin, but the work depends on ``size`` alone, not on the number of pieces. A run at least halves its capacity at
    each step, so there are at most ``3 * size * log2(size)`` rules.
    """
    tree, rules, bins = CapacityTree(size), [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        done, total = 0, counts[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, run = size, (bins, -(-(total - done) // (size // length)))
                bins += run[1]
            else:
                run = tree.pop(capacity)
            first, count = run
            each = capacity // length
            rules.append((length, done, first, each, size - capacity))
            full = min(count, (total - done) // each)
            done += full * each
            tree.push(capacity - each * length, first, full)
            if full < count:
                some = total - done  # fewer than fill another bin
                tree.push(capacity - some * length, first + full, 1 if some else 0)
                tree.push(capacity, first + full + (some > 0), count - full - (some > 0))
                done = total
    return np.array(rules, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, size: int = 1024, end_id: int = 2, ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` on request).

    A document is its token ids and ``end_id``; only those of over ``size`` tokens are cut, the first piece taking the
    remainder. Whole texts are encoded once; ids are those that tokenizers gives with byte_bpe_50k.json, its added token
    included. The driver gets the number of pieces of each length (``size`` rows at most), plans best-fit decreasing over all of them, and broadcasts
    the rules (``3 size log2(size)`` at most); tasks look up their pieces by their rank among pieces of the same length.

    Defined results: a null text is an empty document, of one token; a very long text is encoded whole and cut into
    pieces; equal rows are documents of their own, and pieces of one length may swap places; null ids stay null; an
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    import public_tokenizers

    path, spark = public_tokenizers.path(ranks), docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _pieces(it, path, size, end_id, with_ids), schema)
    # The partition spreads equal rows over slices; the checkpoint fixes it.
    pieces = cut(pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(SLICES))))
    slices = cut(pieces.groupBy("length", "_slice").count())
    counts = {r["length"]: r["n"] for r in slices.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, size))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("length", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("_nth", F.row_number().over(inside) - 1).join(starts, ["length", "_slice"]).withColumn("_rank", F.col("_first") + F.col("_nth"))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rules = plan.value  # by length (descending) and first rank
        n, r = length.to_numpy(), rank.to_numpy()
        row = np.searchsorted((size - rules[:, 0]) * (1 << 48) + rules[:, 1], (size - n) * (1 << 48) + r, side="right") - 1
        own = rules[row]
        nth = r - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + nth // own[:, 3], "offset": own[:, 4] + nth % own[:, 3] * n})

    return ranked.withColumn("_at", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "_at.sequence_id", "_at.offset")

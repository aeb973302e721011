"""Compression of vectors to four code bytes: product codebooks by integer k-means, nearest entries by VA-file filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import stored

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and units that 1.0 has.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate in the approximation of an entry, and vectors that are looked up at a time.
BITS, BATCH = 4, 2048
#: Magnitudes from which squares are computed as Python's whole numbers, and at which components and errors end.
WIDE, LARGEST, LONG = 1 << 24, 1 << 53, (1 << 63) - 1


@dataclass(frozen=True)
class Approximation:
    """A codebook as a vector approximation file: each coordinate of each entry as one of at most 16 cells.

    ``low`` and ``high`` (dimension, cell) bound the entries' coordinates in a cell; ``cell`` (dimension, entry).
    """

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray


def approximate(entries: np.ndarray) -> Approximation:
    """Cells of equal counts per coordinate, with the bounds that their members really have; equal values share a cell."""
    n, m = entries.shape
    cells = 1 << BITS
    ordered = np.sort(entries, axis=0)
    splits = ordered[np.arange(1, cells) * n // cells]
    cell = np.stack([np.searchsorted(splits[:, j], entries[:, j], side="right") for j in range(m)])
    low, high = np.zeros((m, cells), dtype=entries.dtype), np.zeros((m, cells), dtype=entries.dtype)
    for j in range(m):
        for c in np.unique(cell[j]):
            own = entries[cell[j] == c, j]
            low[j, c], high[j, c] = own.min(), own.max()
    return Approximation(entries, cell, low, high)


def nearest(book: Approximation, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index.

    Per part and coordinate, a table has the least and the largest squared distance to each cell; sums of looked-up
    values bound the distance to each entry from both sides. Only entries whose lower bound doesn't exceed the least
    upper bound are compared, in whole numbers.
    """
    lower = np.zeros((len(parts), len(book.entries)), dtype=parts.dtype)
    upper = np.zeros_like(lower)
    for j in range(parts.shape[1]):
        x = parts[:, j, None]
        below, above = book.low[j] - x, x - book.high[j]
        out = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        lower += np.take(out * out, book.cell[j], axis=1)
        upper += np.take(far * far, book.cell[j], axis=1)
    rows, entries = np.nonzero(lower <= upper.min(axis=1)[:, None])
    gaps = parts[rows] - book.entries[entries]
    distance = (gaps * gaps).sum(axis=1)
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    least = np.minimum.reduceat(distance, starts)
    hits = np.flatnonzero(distance == least[rows])
    first = hits[np.concatenate(([True], rows[hits][1:] != rows[hits][:-1]))]
    return entries[first], least


def _whole(values: list, width: int) -> np.ndarray:
    """Whole numbers as a matrix: as longs, or as Python's own where squares might exceed a long."""
    x = np.array(values, dtype=np.int64).reshape(-1, width)
    return x.astype(object) if x.size and max(-int(x.min()), int(x.max())) >= WIDE else x


def _matrices(batch: pa.RecordBatch, width: int, wide: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(start, matrix) of a batch's vectors, some at a time."""
    column = batch.column("v")
    for at in range(0, batch.num_rows, BATCH):
        x = _whole(column.slice(at, BATCH).flatten().to_numpy(), width)
        yield at, x.astype(object) if wide else x


def _approximations(books: np.ndarray) -> list[Approximation]:
    return [approximate(b) for b in books]


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of the vectors of a task: as many rows as the codebooks have entries, at most."""
    files, (_, k, m) = _approximations(books), books.shape
    count, total = np.zeros((PARTS, k), dtype=np.int64), np.zeros((PARTS, k, m), dtype=object)
    for batch in batches:
        for _, x in _matrices(batch, PARTS * m, books.dtype == object):
            for p, file in enumerate(files):
                own = x[:, p * m : (p + 1) * m]
                code, _ = nearest(file, own)
                order = np.argsort(code, kind="stable")
                entry, starts, n = np.unique(code[order], return_index=True, return_counts=True)
                count[p, entry] += n
                total[p, entry] += np.add.reduceat(own[order], starts, axis=0).astype(object)
    part, entry = np.nonzero(count)
    sums = [[str(v) for v in total[p, e]] for p, e in zip(part, entry, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(sums, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each vector's codes and error beside its other columns."""
    files, m = _approximations(books), books.shape[2]
    for batch in batches:
        codes, errors = np.zeros((batch.num_rows, PARTS), dtype=np.uint8), []
        for at, x in _matrices(batch, PARTS * m, books.dtype == object):
            error = np.zeros(len(x), dtype=x.dtype)
            for p, file in enumerate(files):
                codes[at : at + len(x), p], distance = nearest(file, x[:, p * m : (p + 1) * m])
                error = error + distance
            errors += [min(int(e), LONG) for e in error]
        kept = [batch.column(c) for c in ("vec_id", "label")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])


def whole_components(vector: Column) -> Column:
    """floor(1024 * x) of each component, ended at 2**53 either way."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def train(vectors: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, position) of whole vectors (vec_id, v): ``ROUNDS`` rounds from the smallest ids' vectors.

    Each round is one scan that sums up inside tasks; what reaches the driver are the codebooks, 256 entries at most.
    """
    m = width // PARTS
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = _whole([r["v"] for r in first], width).reshape(len(first), PARTS, m).swapaxes(0, 1)
    wide = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] >= WIDE
    books = books.astype(object) if wide else books
    for _ in range(ROUNDS):
        sums = vectors.select("v").mapInArrow(lambda it, books=books: _sums(it, books), "part int, entry int, n long, sums array<string>")
        split = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for r in split.collect():
            books[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return books


def books_text(books: np.ndarray) -> str:
    """All components of the codebooks by part, entry and position, joined by commas."""
    return ",".join(str(int(x)) for x in books.reshape(-1))


def encode(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each usable vector of (vec_id, label, embedding), and the codebooks.

    Vectors are whole numbers from here on, in four equal consecutive parts, each with a codebook of its own (see
    ``train``); ``code`` has two hex digits per part, ``error`` is the squared distance between vector and coded vector.
    Only codebooks are sent to tasks: 256 vectors' worth.

    Defined results: null vectors, and those with null or non-finite components, are dropped; so are vectors whose
    length isn't that of the smallest id's vector, or is no positive multiple of four; ids may repeat or be null (null
    ids come last among the starting entries, and equal ids are ordered by vector); fewer than 256 vectors give fewer
    entries; components end at 2**53 either way and errors at the largest long; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    kinds = dict(vectors.dtypes)
    v = whole_components(F.col("embedding"))
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    kept = stored(kept.select("vec_id", "label", v.alias("v")))
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("width")).first()
    width = smallest["width"] if smallest else PARTS
    kept = kept.where(F.size("v") == width)
    books = train(kept.select("vec_id", "v"), width) if smallest else np.zeros((PARTS, 1, 1), dtype=np.int64)
    return kept.mapInArrow(lambda it: _coded(it, books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Codes with ``label_error``, the errors of equal labels summed up, nulls together.

    Errors are summed before they meet the rows, so a frequent label is one line; sums end at the largest long.
    """
    coded = stored(coded)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    key = lambda df: df.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    return key(coded).join(key(sums).drop("label"), ["_none", "_label"]).drop("_none", "_label")

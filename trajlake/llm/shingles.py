"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RNG = np.random.default_rng(6)
#: Random numbers for the 256 bytes, an odd base, and its inverse modulo 2**64.
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are hashed at a time; a longer text is hashed in parts, cut between words.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 2, n)
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[size]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of ``data``: polynomials over their bytes, from running sums."""
    raw = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(raw))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        stop = at + CHUNK
        window = np.frombuffer(data, dtype=np.uint8, count=CHUNK, offset=at)
        spaces = np.flatnonzero(_SPACE[window])
        if len(spaces):
            stop = at + int(spaces[-1]) + 1
        else:  # a word longer than a chunk is hashed whole
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, A-Z lower-cased, in order."""
    batch: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if batch:
            hashes, starts = _words(b"\n".join(batch))
            borders = np.cumsum([len(b) + 1 for b in batch[:-1]])
            yield from np.split(hashes, np.searchsorted(starts, borders))
        batch.clear()

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if batch and size + len(data) >= CHUNK:
            yield from flush()
            size = 0
        if len(data) > CHUNK:
            yield np.concatenate([_words(p)[0] for p in _parts(data)])
        else:
            batch.append(data)
            size += len(data) + 1
    yield from flush()


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; with 1 to k - 1 words, of the whole sequence."""
    factors = [np.uint64(x | 1) for x in np.random.default_rng(k).integers(1, 2**63, size=k)]
    for words in word_hashes(texts):
        n = min(k, len(words))
        if not n:
            yield words
            continue
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = out + words[i : len(words) - n + 1 + i] * factors[i]
        yield np.unique(mix(out))

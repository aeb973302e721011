"""Suffix arrays of byte strings by two-stage sorting, and the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether the suffix of each place is smaller than its successor; the last one is taken as such."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    decided = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return np.append(text[:-1] < text[1:], True)[decided]


def _ends(text: np.ndarray, eight: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The words ``step`` bytes behind the places ``at``; 0 behind the end."""
    at = at + step
    return np.where(at < len(text), eight[np.minimum(at, len(text) - 1)], np.uint64(0))


def sorted_directly(text: np.ndarray, eight: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places ``at`` by the first ``depth`` bytes of their suffixes, eight bytes at a time; only ties are looked at again."""
    if not len(at):
        return at
    order = at[np.argsort(eight[at], kind="stable")]
    where, group = np.arange(len(order)), np.cumsum(np.append(True, eight[order][1:] != eight[order][:-1]))
    for step in range(8, depth, 8):
        tied = np.append(group[1:] == group[:-1], False)
        tied[1:] |= tied[:-1].copy()
        where, group = where[tied], group[tied]
        if not len(where):
            break
        key = _ends(text, eight, order[where], step)
        new = np.lexsort((key, group))
        order[where] = order[where][new]
        key = key[new]
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
    return order


def _reached(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``wanted`` places, and those behind them by way of which a wanted suffix is induced: up to the next one sorted directly."""
    n = len(small)
    behind = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    ends = np.flatnonzero(wanted & ~small & ~np.append(wanted[1:], True))
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, ends + 1, 1)
    np.add.at(steps, behind[ends] + 1, -1)
    return wanted | (np.cumsum(steps[:n]) > 0)


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``text`` (bytes, the last one 0) by the first ``depth`` bytes of their suffixes, at least.

    All places, or those of the mask ``wanted``. First stage: the suffixes that are smaller than their successors are
    sorted directly. Second stage: buckets of first bytes are scanned in order; a suffix that is larger than its
    successor comes in the order in which its successor is met, before the directly sorted ones of its bucket. Of a
    bucket, those whose successors are in smaller buckets come first, then those whose successors are among them, and so
    on: each such step is one array operation.
    """
    small = ascending(text)
    whole = np.ones(len(text), dtype=bool) if wanted is None else _reached(small, wanted)
    induced = whole & ~small
    direct = sorted_directly(text, words(text), np.flatnonzero(small & whole), depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        level, bucket = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64), []
        while len(level):
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[(text[level] == c) & induced[level]]
        bucket.append(direct[starts[c] : starts[c + 1]])
        found = np.concatenate(bucket)
        out.append(found)
        before = found[found > 0] - 1
        before = before[(text[before] > c) & induced[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffix of each place in ``order`` shares with the one before, ``depth`` (a multiple of 8) at most; 0 first."""
    eight = words(text)
    shared = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    for step in range(0, depth, 8):
        gap = _ends(text, eight, order[alive], step) ^ _ends(text, eight, order[alive - 1], step)
        shared[alive] = step + sum((gap >> np.uint64(shift) == 0).astype(np.int64) for shift in range(56, -8, -8))
        alive = alive[gap == 0]
    return shared

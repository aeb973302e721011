"""Cutting batches of texts into chunks of bounded size for numpy, without losing what spans a cut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters and texts of a chunk, and characters of the next part that a part may look at.
CHARS, TEXTS, AHEAD = 1 << 19, 256, 2


def chunks(texts: Iterable[str | None], chars: int = CHARS, most: int = TEXTS) -> Iterator[tuple[list[int], list[str]]]:
    """(indices, parts) with about ``chars`` characters; a longer text comes in several parts.

    A text's first part starts with a space, and its last one ends with ``AHEAD`` spaces; any other one ends with the
    first ``AHEAD`` characters of the next part. So whatever starts in a part, but for its last ``AHEAD`` characters, is
    whole in it, and starts in no other.
    """
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        for at in range(0, max(len(text), 1), chars):
            part = text[at : at + chars + AHEAD]
            part = (" " if at == 0 else "") + (part if at + chars < len(text) else text[at : at + chars]) + " " * (AHEAD - max(0, min(len(text) - at - chars, AHEAD)))
            if rows and (size + len(part) > chars or len(rows) >= most):
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the parts, and the places where the parts start."""
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts

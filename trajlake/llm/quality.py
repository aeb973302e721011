"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.textbatch import CHARS

#: Hashed words, dimensions of word vectors, non-zero entries of a word's index vector, neighbours on each side.
WORDS, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 64, 8, 2
#: Labelled rows that the network is fitted on at most, by hash of the id; hidden units; passes.
SAMPLE, HIDDEN, EPOCHS = 20_000, 32, 40
#: Columns of features(): the pooled vector, the logarithms of its norm and of the text's length in words, the words' entropy.
WIDTH = DIMENSIONS + 3
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Words whose neighbours are counted at once.
_SLICE = 1 << 16


@lru_cache(1)
def _index() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the non-zero entries of each hashed word's sparse random ternary index vector."""
    rng = np.random.default_rng(10)
    at = rng.permuted(np.tile(np.arange(DIMENSIONS), (WORDS, 1)), axis=1)[:, :NONZERO]
    return at, rng.choice(np.array([-1.0, 1.0]), size=at.shape)


def _hashed(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of ``joined`` (runs of anything but ASCII white space, case and signs kept) and their places."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = (codes != 32) & ((codes < 9) | (codes > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, np.diff(np.append(np.flatnonzero(first[at]), len(at))))
    powers = np.multiply.accumulate(np.full(place.max() + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    h = np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * powers[place], np.flatnonzero(first[at]))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - (WORDS - 1).bit_length())).astype(np.int64), starts


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, texts, hashed words, the text of each) for runs of whole texts; a text beyond CHARS comes alone."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHARS:
            size += len(texts[end])
            end += 1
        if end == at + 1:
            text, start, ids = texts[at], 0, []
            while start < len(text):  # hashed in parts that end between words
                space = _SPACE.search(text, start + CHARS)
                stop = space.start() if space else len(text)
                ids.append(_hashed(text[start:stop])[0])
                start = stop
            words = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
            doc = np.zeros(len(words), dtype=np.int64)
        else:
            words, places = _hashed(" ".join(texts[at:end]))
            doc = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts[at : end - 1]]), places, "right") - 1
        yield at, end - at, words, doc
        at = end


def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, v0 ...): for each hashed word of the batches' texts the sum of its neighbours' index vectors."""
    at, signs = _index()
    total = np.zeros(WORDS * DIMENSIONS)
    for batch in batches:
        for _, _, words, doc in _groups(batch["text"].tolist()):
            for start in range(0, len(words), _SLICE):
                for distance in range(1, WINDOW + 1):
                    a, b = slice(start, start + _SLICE), slice(start + distance, start + distance + _SLICE)
                    right, same = words[b], doc[a][: len(doc[b])] == doc[b]
                    left, right = words[a][: len(right)][same], right[same]
                    for own, other in ((left, right), (right, left)):
                        total += np.bincount((own[:, None] * DIMENSIONS + at[other]).ravel(), signs[other].ravel(), len(total))
    total = total.reshape(WORDS, DIMENSIONS).astype(np.int64)
    used = np.flatnonzero(total.any(axis=1))
    for start in range(0, len(used), 2048):
        part = used[start : start + 2048]
        yield pd.DataFrame({"word": part} | {f"v{k}": total[part, k] for k in range(DIMENSIONS)})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS, DIMENSIONS) vectors of hashed words, from the texts of all ``docs``.

    Random indexing: a word's context vector is the sum, over all its occurrences in all documents, of the index
    vectors of the two words on either side. Tasks add up their own texts, Spark adds up the tasks' sums (whole
    numbers, so their order doesn't matter), and the driver gets one row per hashed word, WORDS at most. Directions
    count: the mean of the context vectors' directions is taken off and what is left has unit length; words without
    neighbours have zeros.
    """
    names = [f"v{k}" for k in range(DIMENSIONS)]
    sums = docs.select("text").mapInPandas(contexts, "word long, " + ", ".join(f"{n} long" for n in names))
    rows = sums.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    raw = np.zeros((WORDS, DIMENSIONS))
    if rows.num_rows:
        raw[rows["word"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names])
    used = raw.any(axis=1)
    if used.any():
        raw[used] /= np.linalg.norm(raw[used], axis=1, keepdims=True)
        raw[used] -= raw[used].mean(axis=0)
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return raw.astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) features of whole texts: the mean of their words' vectors, its norm, the length and entropy.

    A text without words has zeros for the vector.
    """
    total, length, entropy = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts)), np.zeros(len(texts))
    for first, n, words, doc in _groups(texts):
        if not len(words):
            continue
        keys, counts = np.unique(doc * WORDS + words, return_counts=True)
        own, at = np.unique(keys // WORDS, return_index=True)
        rows = first + own
        total[rows] = np.add.reduceat(vectors[keys % WORDS] * counts[:, None], at, axis=0)
        length[rows] = np.bincount(doc, minlength=n)[own]
        share = counts / np.bincount(doc, minlength=n)[keys // WORDS]
        entropy[rows] = np.add.reduceat(-share * np.log(share), at)
    mean = total / np.maximum(length, 1)[:, None]
    return np.column_stack([mean, np.log(np.linalg.norm(mean, axis=1) + 1e-6), np.log1p(length), entropy / np.log(length + 2)])


@dataclass
class QualityModel:
    """Logits are a linear layer over tanh units, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 10) -> QualityModel:
    """Adam on log loss over the rows not held; then the temperature that is best for the held rows.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.1, HIDDEN), "b2": np.zeros(())}
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), p["w1"] * 0, p["b1"], p["w2"] * 0, float(np.log(rate / (1 - rate))))
    own = ~held if len(set(y[~held].tolist())) == 2 else np.ones(len(y), dtype=bool)
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    a, b = (x[own] - mean) / scale, y[own]
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(a))
        for at in range(0, len(a), 256):
            i = order[at : at + 256]
            h = np.tanh(a[i] @ p["w1"] + p["b1"])
            e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -50, 50))) - b[i]) / len(i)
            back = np.outer(e, p["w2"]) * (1 - h**2)
            grad = {"w1": a[i].T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * p["w2"], "b2": e.sum()}
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"]))
    rest = held if held.any() else own
    z, t = model.logits(x[rest]), y[rest]
    loss = lambda temperature: np.mean(np.logaddexp(0, z / temperature) - t * z / temperature)
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def train(docs: DataFrame, labels: DataFrame, vectors: Broadcast, sample: int = SAMPLE) -> QualityModel:
    """Fitted on labelled rows outside the held-out fold (crc32 of the id, mod 5, is 0); fold 1 sets the temperature.

    The sample is the ``sample`` labelled ids of lowest hash, broadcast like the word vectors; the driver gets their features
    (sample x WIDTH numbers). An id labelled more than once counts as good when most of its labels are.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": list(features(batch["text"].tolist(), vectors.value))})

    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").mapInPandas(features_of, "doc_id long, quality double, x array<double>")
    rows = rows.withColumn("held", _fold(F.col("doc_id"), 5) == 1).orderBy("doc_id", "x").limit(2 * sample).toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, WIDTH))
    return fit(x, rows["quality"].to_numpy(dtype=float), rows["held"].to_numpy(dtype=bool))


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Word vectors are learned from every whole text in one scan, and every whole text is scored in another. Defined
    results: null texts score like empty ones; texts of any length count whole; repeated rows get equal scores; a score
    of exactly the threshold is predicted as 1; without labels of both kinds all scores are the smoothed share of label
    1 (0.5 without labels); rows of ``labels`` without id or label teach nothing; an empty table gives an empty result;
    columns of ``docs`` that are called score or predicted are replaced.
    """
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs))
    model = sc.broadcast(train(docs, labels, vectors, sample))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(features(text.tolist(), vectors.value)))

    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]).alias("_row")
    scored = docs.select(kept, score("text").alias("_score"))
    return scored.select("_row.*", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))

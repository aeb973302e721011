"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut
from trajlake.llm.textbatch import AHEAD, chunks, code_points

#: Buckets that n-grams are hashed to; n-gram lengths; languages whose log probabilities are one broadcast (17 MB).
BUCKETS, ORDERS, LANGUAGES = 1 << 15, (1, 2, 3), 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter, or a space for what is no letter or mark; and whether it is a letter."""
    out, letter = np.full(0x110000, 32, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i] or unicodedata.category(c)[0] == "M":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out, letter


def _grams(parts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(buckets of each n-gram length, starts of the parts, letters of each part); bucket BUCKETS stands for none."""
    codes, starts = code_points(parts)
    low, letter = _letters()
    letters, codes = letter[codes], low[codes].astype(np.uint64)
    blank = codes == 32
    n = len(codes)
    # What starts in the characters that a part only looks at belongs to the next part, or is blank.
    ahead = np.concatenate((starts[1:], [n]))[:, None] - np.arange(1, AHEAD + 1)
    out = []
    for order in ORDERS:
        h = np.full(n, order, dtype=np.uint64)
        h[: n - order + 1] += sum(codes[k : n - order + 1 + k] * _FACTORS[k] for k in range(order))
        h ^= h >> np.uint64(29)
        h *= _FACTORS[2]
        bucket = (h >> np.uint64(49)).astype(np.int32)
        # N-grams of blanks start with a blank (two, beyond single letters).
        skip = blank.copy()
        if order > 1:
            skip[:-1] &= blank[1:]
        skip[ahead] = True
        bucket[skip] = BUCKETS
        out.append(bucket)
    letters[ahead] = False
    return out, starts, np.add.reduceat(letters.astype(np.int64), starts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition: (lang, bucket, n); bucket -1 counts documents. At most ``LANGUAGES`` are held at a time."""
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, own in counts.items():
            own[BUCKETS] = 0
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": np.where(at == BUCKETS + 1, -1, at), "n": own[at]})
        counts.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            if lang not in counts and len(counts) >= LANGUAGES:
                yield from flush()
            own = counts.setdefault(lang, np.zeros(BUCKETS + 2, dtype=np.int64))
            own[-1] += len(texts)
            for _, parts in chunks(texts):
                for bucket in _grams(parts)[0]:
                    own[: BUCKETS + 1] += np.bincount(bucket, minlength=BUCKETS + 1)
    yield from flush()


@dataclass
class LanguageModel:
    """At most ``LANGUAGES`` languages, sorted, with their log probabilities."""

    langs: list[str]
    log_prob: np.ndarray  # (langs, BUCKETS + 1); 0 for the last bucket
    log_prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, langs) joint log probabilities, and each text's number of letters."""
        out, found = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
        for rows, parts in chunks(texts):
            grams, starts, letters = _grams(parts)
            np.add.at(found, rows, letters)
            for k, own in enumerate(self.log_prob):
                np.add.at(out[:, k], rows, sum(np.add.reduceat(own[g], starts) for g in grams))
        return out, found


def counted(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language over all (text, lang) rows with both; bucket -1 counts texts."""
    rows = rows.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    return cut(rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def models(counts: DataFrame, smoothing: float = 0.5) -> list[LanguageModel]:
    """Naive Bayes models of ``LANGUAGES`` languages each, which together have all of them.

    The driver gets the languages' names and then, model by model, ``LANGUAGES`` x ``BUCKETS`` counts at most.
    """
    texts = {r["lang"]: r["n"] for r in counts.where("bucket = -1").collect()}
    langs, out = sorted(texts), []
    for at in range(0, len(langs), LANGUAGES):
        own = langs[at : at + LANGUAGES]
        sums = counts.where(F.col("lang").isin(own) & (F.col("bucket") >= 0)).toArrow()
        table = np.zeros((len(own), BUCKETS))
        if sums.num_rows:
            where = {lang: i for i, lang in enumerate(own)}
            names = sums["lang"].combine_chunks().dictionary_encode()
            places = np.array([where[x] for x in names.dictionary.to_pylist()])
            table[places[names.indices.to_numpy()], sums["bucket"].to_numpy()] = sums["n"].to_numpy()
        log_prob = np.log((table + smoothing) / (table.sum(1, keepdims=True) + smoothing * BUCKETS))
        prior = np.log(np.array([texts[x] for x in own]) / sum(texts.values()))
        out.append(LanguageModel(own, np.hstack([log_prob, np.zeros((len(own), 1))]), prior))
    return out


def _best(docs: DataFrame, model: LanguageModel) -> Column:
    """(lang, top, rest, letters) of a text: the best language of a model, its log probability, and all probabilities as
    multiples of that one's."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, top double, rest double, letters long>")
    def best(text: pd.Series) -> pd.DataFrame:
        scores, letters = sent.value.scores(text.tolist())
        top = scores.max(1)
        return pd.DataFrame({"lang": np.array(sent.value.langs, dtype=object)[scores.argmax(1)], "top": top, "rest": np.exp(scores - top[:, None]).sum(1), "letters": letters})

    return best("text")


def identify_languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and what else it has) with lang_pred and score, its probability.

    Texts are scored whole, by letters and marks only: n-grams cross the cuts of very long texts. Any number of
    languages is learned; beyond ``LANGUAGES`` they are several broadcasts, whose results are put together.

    Defined results: null texts and texts without a letter (marks alone are none) are ``und`` with score 0, and so is
    every text where nothing was learned; of languages that are equally likely the first by code point counts; repeated
    rows get equal results; rows of the training table without text or language teach nothing; an empty table gives an
    empty result; columns of ``docs`` that are called lang_pred or score are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    found = models(counted(training))
    if not found:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    row = F.struct(*kept).alias("_row")
    parts = docs.select(row, F.array(*[_best(docs, m) for m in found]).alias("_parts"))
    top = F.array_max(F.transform("_parts", lambda x: x["top"]))
    lang = F.filter("_parts", lambda x: x["top"] == top)[0]["lang"]
    score = 1 / F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + x["rest"] * F.exp(x["top"] - top))
    letters = F.col("_parts")[0]["letters"] > 0
    return parts.select("_row.*", F.when(letters, lang).otherwise("und").alias("lang_pred"), F.when(letters, score).otherwise(0.0).alias("score"))

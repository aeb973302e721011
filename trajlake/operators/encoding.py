"""Incremental encoding for byte-level BPE: what is appended is encoded without the history before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundary(text: Column) -> Column:
    """Characters of a text whose tokens can't change, whatever follows: up to its last space between two other characters.

    Pre-tokens of such vocabularies begin at a space or where the kind of character changes, and only a leading space
    joins what comes behind it. So a space between two characters that are no white space begins a pre-token, and all
    before it is settled. 0 where there is none.
    """
    return F.length(F.regexp_extract(text, r"(?sU)^(.*\S)(?= \S)", 1))


def settled(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, settled, open) of segments of growing texts, each ``key``'s segments in ``order``.

    ``settled`` is the text that this segment settles, ``open`` what is left to be encoded again with the next one: all
    ``settled`` up to a segment and its ``open`` make the text so far. Only open ends are carried on, so a segment's
    history isn't read again; a null segment is empty.
    """
    own = segments.select(key, order, F.coalesce(F.col(text), F.lit("")).alias("s")).withColumn("b", boundary(F.col("s")))
    by = Window.partitionBy(key).orderBy(order)
    own = own.withColumn("run", F.count_if(F.col("b") > 0).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = F.when(F.col("b") > 0, F.substr("s", F.col("b") + 1)).otherwise(F.col("s"))
    since = Window.partitionBy(key, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("open", F.array_join(F.collect_list(rest).over(since), ""))
    before = F.coalesce(F.lag("open").over(by), F.lit(""))
    done = F.when(F.col("b") > 0, F.concat(before, F.left("s", F.col("b")))).otherwise("")
    return own.select(key, order, done.alias("settled"), "open")


def encoded(text: Column, codec: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Token ids of texts; ``codec`` makes the encoding function once per task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec()
        for texts in batches:
            yield pd.Series(own(texts.fillna("").tolist()), dtype=object)

    return encode(text)


def byte_bpe(path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """The codec of a byte-level BPE vocabulary file; without special tokens. Needs ``tokenizers`` on the executors."""

    def make() -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

    return make


def incremental_ids(segments: DataFrame, key: str, order: str, text: str, codec: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """(key, order, ids, open_ids): the ids that a segment settles, and those of its open end.

    The ids of the text so far are all ``ids`` up to a segment and its ``open_ids``; with the next segment the latter are
    replaced, and nothing before them. Each character is encoded once as settled, and open ends again.
    """
    own = settled(segments, key, order, text)
    return own.select(key, order, encoded(F.col("settled"), codec).alias("ids"), encoded(F.col("open"), codec).alias("open_ids"))

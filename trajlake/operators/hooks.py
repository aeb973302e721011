"""Places for functions of one's own, with defaults that stay in the JVM: token counts, tool calls, media."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGES, VIDEOS = ("image", "image_url"), ("video", "video_url")


def token_count(text: Column, counter: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of a text (UX11): a quarter of its characters, at least 1, or what a counter says.

    ``counter`` makes the counting function; it is called once per task, so that a vocabulary is loaded once. Null
    counts as empty.
    """
    if counter is None:
        return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter()
        for texts in batches:
            yield texts.fillna("").map(own)

    return count(text)


def tool_calls(text: Column, parser: Callable[[str], tuple[str, list[str]]] | None = None) -> Column:
    """(content, calls) of an answer (UX9): what a parser makes of it, calls as JSON text; else the raw text, no calls.

    An answer that the parser fails on stays raw. Null stays null.
    """
    if parser is None:
        return F.struct(text.alias("content"), F.array().cast("array<string>").alias("calls"))

    def parsed(answer: str | None) -> tuple[str | None, list[str]]:
        if answer is None:
            return None, []
        try:
            content, calls = parser(answer)
            return content, list(calls)
        except Exception:  # the contract of this hook: parsers may fail on any text
            return answer, []

    @F.pandas_udf("struct<content string, calls array<string>>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(t) for t in texts], columns=["content", "calls"])

    return parse(text)


def media(parts: Column, extractor: Callable[[pd.Series], pd.DataFrame] | None = None) -> Column:
    """(images, videos) of a message's parts (UX8): their URLs in order, or what an extractor returns per batch.

    ``parts`` is an array of structs with type and url; null has no media.
    """
    if extractor is None:
        urls = lambda kinds: F.coalesce(F.transform(F.filter(parts, lambda p: p["type"].isin(*kinds)), lambda p: p["url"]), F.array().cast("array<string>"))
        return F.struct(urls(IMAGES).alias("images"), urls(VIDEOS).alias("videos"))
    return F.pandas_udf(lambda x: extractor(x), "struct<images array<string>, videos array<string>>")(F.to_json(parts))

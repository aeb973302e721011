"""Functions over token sequences, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_points(text: Column) -> Column:
    """One token per code point (the default codec)."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def constant_like(ids: Column, value: int) -> Column:
    """A mask of one value (A2)."""
    return F.transform(ids, lambda _: F.lit(value).cast("tinyint"))


def position_ids(ids: Column) -> Column:
    """0 to n - 1 (A3)."""
    return F.transform(ids, lambda _, i: i.cast("int"))


def scatter_last(ids: Column, value: Column) -> Column:
    """Zeros with ``value`` at the last place; empty for empty (A5)."""
    return F.transform(ids, lambda _, i: F.when(i == F.size(ids) - 1, value).otherwise(F.lit(0.0)).cast("double"))


def align(values: Column, length: Column, pad: Column) -> Column:
    """Cut or padded to ``length``."""
    kept = F.slice(values, F.lit(1), F.least(F.size(values), length))
    return F.concat(kept, F.array_repeat(pad, F.greatest(length - F.size(values), F.lit(0))))


def align_experts(rows: DataFrame, column: str, length: Column) -> DataFrame:
    """Rows with expert choices (token, layer, choice) cut or padded to ``length`` tokens (A6): zeros of a token's shape.

    A column of any other depth is dropped, as nothing says along which axis it would be aligned.
    """
    kind = dict(rows.dtypes)[column]
    if kind.count("array<") != 3:
        return rows.drop(column)
    inner = kind.removeprefix("array<").removesuffix(">")
    zero = F.coalesce(F.transform(F.get(F.col(column), 0), lambda layer: F.transform(layer, lambda x: F.lit(0).cast(inner.removeprefix("array<array<").removesuffix(">>")))), F.array().cast(inner))
    return rows.withColumn(column, align(F.col(column), length, zero))


def mask_unfinished(mask: Column, finished: Column, enabled: bool = True) -> Column:
    """Zero where the episode is known to be unfinished; unknown stays trainable (A10)."""
    return F.when(F.lit(enabled) & finished.eqNullSafe(F.lit(False)), constant_like(mask, 0)).otherwise(mask)


def repeat_interleave(values: Column, times: Column) -> Column:
    """Each value as often as its count."""
    return F.flatten(F.transform(F.arrays_zip(values.alias("v"), times.alias("n")), lambda x: F.array_repeat(x["v"], x["n"].cast("int"))))


def total(values: Column) -> Column:
    """Sum of an array (AG11, AG12)."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def last_or_zero(values: Column) -> Column:
    """The last element, 0 for empty (AG11)."""
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0)).cast("double")


def decode(ids: Column) -> Column:
    """Text of code points (A12): the inverse of ``code_points``."""
    return F.when(F.size(ids) == 0, F.lit("")).otherwise(F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 8, "0")), "")), "UTF-32"))


def generation_suffix(plain: Column, asking: Column) -> Column:
    """Tokens that ask for an answer (A9): what ``asking`` appends to ``plain``; other changes are an error."""
    kept = F.slice(asking, F.lit(1), F.size(plain)) == plain
    rest = F.slice(asking, F.size(plain) + 1, F.size(asking))
    return F.when(kept, rest).otherwise(F.raise_error(F.lit("the template changes tokens before the generation prompt")).cast("array<int>"))

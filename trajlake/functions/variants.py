"""Type tests and bindings over variant columns, for JSON of any shape without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_text() -> Column:
    return F.lit(None).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def field(v: Column, name: str) -> Column:
    """A field of an object as a variant: SQL null where it is missing, a variant null where it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """STRING, VOID, BOOLEAN, BIGINT, ...; containers are named in full; SQL null for a missing value."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_null(v: Column) -> Column:
    """Whether a value is there and null."""
    return F.coalesce(kind(v) == "VOID", F.lit(False))


def string(v: Column) -> Column:
    """The text of a string, null for anything else."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The elements of a list, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    """The fields of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_object(v: Column) -> Column:
    return members(v).isNotNull()

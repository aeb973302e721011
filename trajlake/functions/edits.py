"""Text-editing primitives over columns: numbered views, replacements of unique text, insertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns between tab stops.
TAB = 8


def _expand(line: Column) -> Column:
    parts = F.split(line, "\t")
    pad = lambda acc: F.repeat(F.lit(" "), F.lit(TAB) - F.length(acc) % TAB)
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0], lambda acc, p: F.concat(acc, pad(acc), p))


def lines(text: Column) -> Column:
    """Lines of a text with tabs expanded; an empty text has one empty line."""
    return F.transform(F.split(text, "\n"), _expand)


def expand_tabs(text: Column) -> Column:
    return F.array_join(lines(text), "\n")


def numbered_view(text: Column, first: int = 1, limit: int | None = None, notice: str = "") -> Column:
    """Lines behind their numbers, right-aligned to six places, and a tab; beyond ``limit`` characters a notice stands."""
    if limit is not None:
        text = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(notice))).otherwise(text)
    return F.array_join(F.transform(lines(text), lambda line, i: F.format_string("%6d\t%s", i + first, line)), "\n")


def replace_unique(text: Column, old: Column, new: Column) -> Column:
    """(text, line, error): ``old``, which must occur exactly once, replaced by ``new`` (null is empty), tabs expanded.

    ``line`` is where it starts. On an error the text is the one before, and ``line`` is null.
    """
    own, old, new = expand_tabs(text), expand_tabs(old), F.coalesce(expand_tabs(new), F.lit(""))
    blank = F.coalesce(old, F.lit("")) == ""
    found = F.floor((F.length(own) - F.length(F.replace(own, old, F.lit("")))) / F.greatest(F.length(old), F.lit(1)))
    numbers = F.transform(F.split(own, "\n"), lambda line, i: F.when(F.contains(line, old), i + 1))
    error = (
        F.when(blank, "old text is required").when(found == 0, "old text not found")
        .when(found > 1, F.concat(F.lit("old text is in lines "), F.array_join(F.array_compact(numbers), ", "))).when(old == new, "old and new text are the same")
    )
    before = F.substr(own, F.lit(1), F.position(old, own) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(F.when(error.isNull(), F.replace(own, old, new)).otherwise(text).alias("text"), F.when(error.isNull(), line).alias("line"), error.alias("error"))


def insert_lines(text: Column, at: Column, new: Column) -> Column:
    """(text, error): the lines of ``new`` put before line ``at`` (from 1; one behind the last appends), tabs expanded."""
    own = lines(text)
    put = F.concat(F.slice(own, F.lit(1), F.greatest(at, F.lit(1)) - 1), lines(new), F.slice(own, F.greatest(at, F.lit(1)), F.size(own)))
    error = F.when(at.isNull() | new.isNull(), "a line and a text are required").when((at < 1) | (at > F.size(own) + 1), F.concat(F.lit("line must be in 1 to "), (F.size(own) + 1).cast("string")))
    return F.struct(F.when(error.isNull(), F.array_join(put, "\n")).otherwise(text).alias("text"), error.alias("error"))


def replay_edits(log: DataFrame, path: str = "path", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """The edit that each path ends at, once every ``undo`` has taken back the edit before it; paths without one go.

    The log has rows of kind ``edit`` or ``undo``; an undo of nothing does nothing. Only numbers are gathered by path;
    the log's other columns are joined back.
    """
    steps = log.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).cast("long").alias("s"), (F.col(kind) == "undo").alias("u")))).alias("steps"))
    stack = F.aggregate("steps", F.array().cast("array<long>"), lambda acc, x: F.when(x["u"], F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x["s"])))
    last = steps.select(path, F.try_element_at(stack, F.lit(-1)).alias(seq)).where(F.col(seq).isNotNull())
    return log.join(last, [path, seq], "left_semi")

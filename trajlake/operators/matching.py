"""Matching of requests to the histories that they continue: prefix hashes as keys of joins, order by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.session import cut

KEY = ["session_id", "tools", "length", "hash"]


def tip(prefix: Column, answer_digest: Column) -> Column:
    """Hash of a history with one more message, continuing its prefix hashes."""
    return F.sha2(F.concat(F.coalesce(F.try_element_at(prefix, F.lit(-1)), F.lit("")), F.lit("\n"), answer_digest), 256)


def exchanges(log: DataFrame) -> DataFrame:
    """One row per request of a digested log: its own columns, ``done`` (seq of what followed), and the answer's.

    A request is followed by its answer where the next request or answer of its session is a commit of its id; ``broken``
    marks requests and answers for which that isn't so, but for a last request without an answer. Only hashes and
    lengths are ordered by session.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    kind, other = F.lead("kind").over(order), F.lead("request_id").over(order)
    thin = log.where("kind IN ('prepare', 'commit')").select("session_id", "seq", "kind", "request_id", F.coalesce("tools", F.lit("")).alias("tools"), "prefix", "lengths", "spoken", "answer_digest", "output_length", "failed", "min_version", "max_version")
    answer = F.struct("seq", "answer_digest", "output_length", "failed", "min_version", "max_version")
    rows = thin.withColumns({"_next": kind, "_same": other.eqNullSafe(F.col("request_id")), "_before": F.lag("kind").over(order), "a": F.lead(answer).over(order)})
    asked = F.col("kind") == "prepare"
    answered = asked & F.col("_same") & (F.col("_next") == "commit")
    broken = F.when(asked, ~answered & F.col("_next").isNotNull()).otherwise(~F.col("_before").eqNullSafe(F.lit("prepare")))
    rows = rows.select("session_id", "seq", "tools", "prefix", "lengths", "spoken", asked.alias("asked"), broken.alias("broken"), F.when(answered, F.col("a")).alias("a"))
    return rows.where("asked OR broken").select("session_id", "seq", "tools", "prefix", "lengths", "spoken", "asked", "broken", F.col("a.seq").alias("done"), *[f"a.{c}" for c in ("answer_digest", "output_length", "failed", "min_version", "max_version")])


def ladder(requests: DataFrame) -> DataFrame:
    """A row per prefix of each request, the empty one too: (session_id, tools, seq, length, hash, next, upto).

    ``next`` is the hash of the prefix that is longer by one, ``upto`` the encoded length of the prefix's messages.
    """
    step = lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)
    upto = F.aggregate("lengths", F.array(F.lit(0).cast("long")), step)
    rungs = F.arrays_zip(F.concat(F.array(F.lit("")), "prefix").alias("hash"), F.concat("prefix", F.array(F.lit(None).cast("string"))).alias("next"), upto.alias("upto"))
    return requests.select("session_id", "tools", "seq", F.posexplode(rungs).alias("length", "r")).select("session_id", "tools", "seq", "length", "r.hash", "r.next", "r.upto")


def histories(answered: DataFrame) -> DataFrame:
    """Where later requests may continue: the history up to an answer (``tip``), and up to before it (``start``)."""
    n = F.size("prefix")
    start = F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit(""))
    return answered.select("session_id", "tools", F.col("seq").alias("r"), "done", n.alias("at"), start.alias("start"), tip(F.col("prefix"), F.col("answer_digest")).alias("tip"))


def predecessors(rungs: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, seq, pred, ambiguous): the longest earlier history that is a prefix of a request.

    An equality join of the request's prefix hashes with the histories' tips, of which each key is one row, and the
    longest by ``max_by``; ``ambiguous`` where several histories are equal or one is not yet there.
    """
    tips = known.groupBy("session_id", "tools", (F.col("at") + 1).alias("length"), F.col("tip").alias("hash")).agg(F.max("r").alias("r"), F.max("done").alias("done"), F.count(F.lit(1)).alias("n"))
    met = rungs.join(tips, KEY)
    unclear = (F.col("n") > 1) | (F.col("done") > F.col("seq"))
    return met.groupBy("session_id", "seq").agg(F.max_by("r", "length").alias("pred"), F.bool_or(unclear).alias("ambiguous"))


def replaceable(rungs: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions in which a request agrees with a history up to before its answer, and not with the answer."""
    starts = known.groupBy("session_id", "tools", F.col("at").alias("length"), F.col("start").alias("hash")).agg(F.min("tip").alias("lo"), F.max("tip").alias("hi"))
    met = rungs.where("next IS NOT NULL").join(starts, KEY).where("lo <> next OR hi <> next")
    return met.select("session_id")


def matches(rungs: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, seq, fits): all earlier histories that a request agrees with up to before their answers.

    Each is (r, start, whole): the encoded lengths of the request's messages up to before the answer and, if the answer
    agrees too, up to behind it.
    """
    keys = known.select("session_id", "tools", F.col("at").alias("length"), F.col("start").alias("hash"), "r", "done", "tip")
    behind = rungs.select("session_id", "tools", "seq", F.col("length").alias("behind"), F.col("upto").alias("whole"))
    met = rungs.where("next IS NOT NULL").join(keys, KEY).where("done < seq").withColumn("behind", F.when(F.col("tip") == F.col("next"), F.col("length") + 1))
    met = met.join(behind, ["session_id", "tools", "seq", "behind"], "left")
    return met.groupBy("session_id", "seq").agg(F.collect_list(F.struct("r", F.col("upto").alias("start"), "whole")).alias("fits"))


def follow(links: DataFrame) -> DataFrame:
    """(session_id, seq, root): where the pointers of (session_id, seq, pred) lead in the end, by pointer doubling.

    A row without ``pred`` is a root. Each step doubles how far pointers reach, so a chain of n requests takes log2(n)
    joins; the driver sees whether any pointer moved.
    """
    ends = cut(links.select("session_id", "seq", F.coalesce("pred", "seq").alias("root")))
    while True:
        ahead = ends.select("session_id", F.col("seq").alias("root"), F.col("root").alias("further"))
        ends = cut(ends.join(ahead, ["session_id", "root"]).select("session_id", "seq", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        if ends.where("moved").isEmpty():
            return ends.drop("moved")
        ends = ends.drop("moved")

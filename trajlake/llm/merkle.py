"""A Merkle manifest of a dataset: sorted leaf runs, a node store of level-partitioned Parquet, proofs by coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import shared_folder, stored

#: Consecutive nodes that become one.
FAN = 8
#: Siblings of a node, left and right of it, from its own level up to the root.
PATH = "array<struct<left:string,right:string>>"
#: ``monotonically_increasing_id`` is the number of a partition and, in this many low bits, that of a row in it.
ROW_BITS = 33


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8."""
    return F.sha2(text, 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: of each field its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    values = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def tree_key(name: Column) -> Column:
    """A tree's name as a key that isn't null and sorts like the name: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _at(level: int) -> int:
    """Leaves below a node of this level."""
    return FAN**level


def _leaf_runs(leaves: DataFrame, folder: str) -> DataFrame:
    """Level 0, (tree, n, pos, digest, row): leaves in runs sorted by tree, ``at`` and digest; n counts a tree's leaves.

    Runs are ranges of the whole order, one a task. Places follow from each row's number in its run and the counts
    per run and tree, of which there are as many as runs and trees together: no tree is ordered in one task. Rows
    that are equal in all of these are spread by their place in the input.
    """
    order = ["tree", "at", "digest", "_spread"]
    spread = stored(leaves).withColumn("_spread", F.monotonically_increasing_id())
    runs = spread.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "digest", "row", F.monotonically_increasing_id().alias("nth"))
    runs.write.parquet(f"{folder}/runs")
    runs = leaves.sparkSession.read.schema(runs.schema).parquet(f"{folder}/runs").withColumn("run", F.shiftright("nth", ROW_BITS))
    counts = stored(runs.groupBy("tree", "run").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("rows")))
    total = counts.groupBy("tree").agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("run", "rows", "first"))).alias("runs"))
    before = F.aggregate(F.slice("runs", 1, F.col("i")), F.lit(0).cast("long"), lambda s, r: s + r["rows"])
    starts = total.select("tree", "n", F.posexplode("runs").alias("i", "r"), "runs").select("tree", "n", F.col("r.run").alias("run"), (before - F.col("r.first")).alias("shift"))
    return runs.join(starts, ["tree", "run"]).select("tree", "n", (F.col("nth") + F.col("shift")).alias("pos"), "digest", "row")


def build(leaves: DataFrame, folder: str) -> int:
    """Write the node store of the trees of ``leaves`` (tree, at, digest, row) to ``folder``; gives its highest level.

    Leaves of a tree ascend by ``at``; while it has several nodes, every ``FAN`` consecutive ones become the digest of
    theirs. Each level is a Parquet table ``level=k`` of (tree, n, pos, digest, children), made from the one below by
    one grouping over coordinates: a group has ``FAN`` rows at most. Level 0 has each leaf's ``row`` and no children.
    """
    spark = leaves.sparkSession
    _leaf_runs(leaves, folder).write.parquet(f"{folder}/level=0")
    most = spark.read.parquet(f"{folder}/level=0").agg(F.max("n")).first()[0] or 0
    level = 0
    while _at(level) < most:
        below = spark.read.parquet(f"{folder}/level={level}").where(F.col("n") > _at(level))
        child = F.struct("pos", "digest", *["row"] * (level == 0))
        up = below.groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("pos")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        level += 1
        up.withColumn("digest", digest(F.array_join("children.digest", ""))).write.parquet(f"{folder}/level={level}")
    return level


def _roots(nodes: DataFrame, level: int) -> DataFrame:
    """Of the nodes of a level, those that are their trees' roots."""
    return nodes.where(F.col("n") <= _at(level))


def roots(spark, folder: str, levels: int) -> DataFrame:
    """(tree, digest): the root of each tree of a node store."""
    found = [_roots(spark.read.parquet(f"{folder}/level={k}"), k).select("tree", "digest") for k in range(levels + 1)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def proofs(folder: str, levels: int, above: DataFrame) -> DataFrame:
    """(tree, row, digest, path, ...) of each leaf; ``path`` leads to the top of what ``above`` (tree, path, ...) says of its tree.

    From the highest level down, nodes meet their parents by coordinate (tree, pos div ``FAN``) and take their siblings
    and the way up from there; a parent meets ``FAN`` children at most, and the leaves come out of their parents' rows.
    """
    spark, found = above.sparkSession, None
    more = [c for c in above.columns if c not in ("tree", "path")]
    beside = lambda digests, i: F.struct(F.array_join(F.slice(digests, 1, i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("right"))
    for level in range(levels, 0, -1):
        nodes = spark.read.parquet(f"{folder}/level={level}")
        own = _roots(nodes, level).join(above, "tree").select("tree", "pos", "children", "path", *more)
        if found is not None:
            place = (F.col("pos") % FAN).cast("int")
            parents = found.select("tree", F.col("pos").alias("parent"), F.col("children.digest").alias("digests"), F.col("path").alias("up"), *more)
            inner = nodes.where(F.col("n") > _at(level)).withColumn("parent", F.expr(f"pos div {FAN}")).join(parents, ["tree", "parent"])
            own = own.unionByName(inner.select("tree", "pos", "children", F.concat(F.array(beside(F.col("digests"), place)), "up").alias("path"), *more))
        found = own
    lone = _roots(spark.read.parquet(f"{folder}/level=0"), 0).join(above, "tree").select("tree", "row", "digest", "path", *more)
    if found is None:
        return lone
    leaf = found.select("tree", "path", "children", *more, F.posexplode("children").alias("i", "c"))
    return lone.unionByName(leaf.select("tree", F.col("c.row").alias("row"), F.col("c.digest").alias("digest"), F.concat(F.array(beside(F.col("children.digest"), F.col("i"))), "path").alias("path"), *more))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path in order."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(rows: DataFrame, fields: list[Column], *, tree: Column, order: Column, keep: list[Column], folder: str | None = None) -> DataFrame:
    """Merkle manifest of ``rows``: per row ``keep``, its leaf, subroot, root and path.

    Each value of ``tree`` has a tree of its rows' leaves, ascending by ``order``; the trees' roots, ordered by name
    (null first, then by UTF-8 bytes), are the leaves of one more tree, whose root covers all. Both node stores stay in
    ``folder`` (under the shared checkpoint folder by default). Only the height of the trees reaches the driver.

    Defined results: null fields count as ``-``; rows of equal ``order`` ascend by leaf, null first; repeated rows are
    leaves of their own; texts of any length are hashed whole; an empty table gives an empty result; other columns,
    whatever their names, are ignored. ``keep`` must have types that can be ordered.
    """
    folder = folder or shared_folder(rows.sparkSession)
    leaves = rows.select(tree_key(tree).alias("tree"), order.alias("at"), leaf_digest(fields).alias("digest"), F.struct(*keep).alias("row"))
    levels = build(leaves, f"{folder}/trees")
    tops = roots(rows.sparkSession, f"{folder}/trees", levels).select(F.lit("").alias("tree"), F.col("tree").alias("at"), "digest", F.struct("tree").alias("row"))
    top_levels = build(tops, f"{folder}/top")
    above = roots(rows.sparkSession, f"{folder}/top", top_levels).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = proofs(f"{folder}/top", top_levels, above).select("row.tree", "path", F.col("digest").alias("subroot"), "root")
    found = proofs(f"{folder}/trees", levels, stored(above))
    return found.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def audited(docs: DataFrame, changed: Column, folder: str | None = None) -> DataFrame:
    """The manifest of ``docs`` by lang, and whether each row still folds to the root once its text is ``changed``.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. ``changed`` is the text as it is found
    now. See ``manifest`` for defined results.
    """
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    found_leaf = F.when(~changed.eqNullSafe(F.col("text")), leaf_digest(fields(changed))).alias("found_leaf")
    out = manifest(docs, fields(F.col("text")), tree=F.col("lang"), order=F.col("doc_id"), keep=[F.col("doc_id"), found_leaf], folder=folder)
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("found_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

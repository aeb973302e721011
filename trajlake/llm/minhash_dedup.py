"""MinHash near-deduplication with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.components import connected_components
from trajlake.llm.common import cut, row_key, stored, without
from trajlake.llm.shingles import mix, shingle_sets

#: Pairs at exactly the threshold that should share a table, but for this share, as far as ``MOST`` collections allow;
#: those that the signature filter may leave out.
MISSED, FILTERED, MOST = 1e-3, 1e-4, 12
#: Members of a bucket that are compared with one another at a time, and the shingles that they may have together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21


@dataclass(frozen=True)
class Banding:
    """``collections`` of ``rows`` minhashes each; a table's key is a pair of collections.

    So 11 collections of 3 make 55 tables of 6 minhashes from 33 instead of 330. ``agree`` is how many equal minhashes
    a pair needs to be verified where a bucket's members are compared with one another.
    """

    collections: int
    rows: int
    agree: int

    @property
    def minhashes(self) -> int:
        return self.collections * self.rows


def missed(similarity: float, collections: int, rows: int) -> float:
    """Probability that a pair of this similarity shares no table, which takes two equal collections."""
    p = similarity**rows
    return (1 - p) ** collections + collections * p * (1 - p) ** (collections - 1)


@lru_cache(8)
def banding(threshold: int) -> Banding:
    """The banding for a threshold in percent: the fewest collections that miss ``MISSED`` at most, of 3 minhashes each.

    From a threshold of 80 on, ``MOST`` collections are enough or near it; below, they get fewer minhashes. 85: 11
    collections, of pairs at 0.85 it misses 0.0005; 80: 12, of pairs at 0.80 it misses 0.0023 (14 would miss 0.0007, for
    a third more members of buckets).
    """
    t = min(max(threshold, 1), 99) / 100
    if t >= 0.8:
        rows, collections = 3, next((c for c in range(2, MOST) if missed(t, c, 3) <= MISSED), MOST)
    else:
        fits = [(c, r) for r in (3, 2, 1) for c in range(2, 17 if r > 1 else 200) if missed(t, c, r) <= MISSED]
        collections, rows = fits[0] if fits else (200, 1)
    n = collections * rows
    agree, below = 0, 0.0
    while (below := below + comb(n, agree) * t**agree * (1 - t) ** (n - agree)) <= FILTERED:
        agree += 1
    return Banding(collections, rows, agree)


@lru_cache(8)
def _hashes(minhashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that each minhash mixes shingles with, by xor and by multiplication."""
    rng = np.random.default_rng(66)
    return rng.integers(1, 2**63, size=(minhashes, 1), dtype=np.uint64), rng.integers(1, 2**63, size=(minhashes, 1), dtype=np.uint64) | np.uint64(1)


@lru_cache(8)
def _table_numbers(collections: int) -> np.ndarray:
    """The number of the table of two collections."""
    out = np.zeros((collections, collections), dtype=np.int64)
    for t, (i, j) in enumerate(combinations(range(collections), 2)):
        out[i, j] = t
    return out


def _signed(batches: Iterator[pa.RecordBatch], k: int, band: Banding) -> Iterator[pa.RecordBatch]:
    """Per text: size and fingerprint of its shingle set, one number per collection, and the signature."""
    xor, multiply = _hashes(band.minhashes)
    for batch in batches:
        n, nodes, bands, signatures = [], [], [], []
        for s in shingle_sets((x.as_py() for x in batch.column("text")), k):
            n.append(len(s))
            nodes.append(int((np.sum(s, dtype=np.uint64) ^ mix(np.sum(mix(s ^ xor[0, 0]), dtype=np.uint64).reshape(1))[0]).view(np.int64)))
            if len(s):
                low = np.full(band.minhashes, 2**64 - 1, dtype=np.uint64)
                for at in range(0, len(s), 1 << 14):
                    np.minimum(low, ((s[at : at + (1 << 14)] ^ xor) * multiply).min(1), out=low)
                bands.append(mix((low.reshape(-1, band.rows) * multiply[: band.rows, 0]).sum(1, dtype=np.uint64)).view(np.int64))
                signatures.append((low >> np.uint64(56)).astype(np.uint8).tobytes())
            else:
                bands.append(None)
                signatures.append(None)
        columns = [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_shingles", "node", "bands", "signature"])


def _similar(threshold: int, k: int):
    """100 * intersection >= threshold * union, on the full sets of two texts."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(a), 500):
            left, right = a.iloc[at : at + 500].tolist(), b.iloc[at : at + 500].tolist()
            texts = list(dict.fromkeys(left + right))  # rows come sorted by centre
            sets = dict(zip(texts, shingle_sets(texts, k), strict=True))
            for x, y in zip(left, right, strict=True):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return similar


def _fits(x: Column, y: Column, threshold: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(x, y) >= threshold * F.greatest(x, y)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units (key, i, j) of rows sorted by them; the last one of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        unit = rows[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]).any(1))))
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            yield rows.iloc[start:stop]
        rest = rows.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _candidates(unit: pd.DataFrame, threshold: int, band: Banding) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, mask) of the pairs of a unit that need verification.

    Those are pairs of its two blocks in different components, of sizes that fit, with ``agree`` equal minhashes, for
    which this table is the first that they share: another unit has the others.
    """
    signature = np.frombuffer(b"".join(unit["signature"]), dtype=np.uint8).reshape(len(unit), band.minhashes)
    bands = np.stack(unit["bands"])
    nodes, n, component, block = (unit[c].to_numpy() for c in ("node", "n", "component", "block"))
    i, j, table = unit["i"].iloc[0], unit["j"].iloc[0], unit["table"].iloc[0]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    step = max(1, (1 << 16) // max(len(right), 1))
    for at in range(0, len(left), step):
        x = left[at : at + step, None]
        ok = (component[x] != component[right]) & (100 * np.minimum(n[x], n[right]) >= threshold * np.maximum(n[x], n[right]))
        if i == j:
            ok &= nodes[right] > nodes[x]
        p, q = np.nonzero(ok)
        if len(p):
            same = signature[x[p, 0]] == signature[right[q]]
            near = same.sum(1) >= band.agree
            p, q = p[near], q[near]
            shared = bands[x[p, 0]] == bands[right[q]]
            first = shared.argmax(1)
            shared[np.arange(len(p)), first] = False
            own = _table_numbers(band.collections)[first, shared.argmax(1)] == table
            ok[:] = False
            ok[p[own], q[own]] = True
            if ok.any():
                yield x[:, 0], right, ok


def _wanted(batches: Iterator[pd.DataFrame], threshold: int, band: Banding) -> Iterator[pd.DataFrame]:
    """The rows of units that have a pair to verify."""
    out, size = [], 0
    for unit in _units(batches):
        need = np.zeros(len(unit), dtype=bool)
        for left, right, ok in _candidates(unit, threshold, band):
            need[left[ok.any(1)]] = True
            need[right[ok.any(0)]] = True
        if need.any():
            out.append(unit[need])
            size += len(out[-1])
        if size > 5000:
            yield pd.concat(out)
            out, size = [], 0
    if out:
        yield pd.concat(out)


def _linked(batches: Iterator[pd.DataFrame], threshold: int, k: int, band: Banding) -> Iterator[pd.DataFrame]:
    """Verified links of units whose rows have their texts: as many as connect what is linked, not all pairs."""
    for unit in _units(batches):
        sets = list(shingle_sets(unit["text"].tolist(), k))
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        codes = np.split(codes, ends[:-1])
        n = np.array([len(s) for s in sets])
        nodes = unit["node"].to_numpy()
        group = np.arange(len(unit))
        links = []
        for left, right, ok in _candidates(unit, threshold, band):
            for x, row in zip(left, ok, strict=True):
                y = right[row]
                y = y[group[y] != group[x]]
                if not len(y):
                    continue
                flag = np.zeros(len(values), dtype=bool)
                flag[codes[x]] = True
                for at in range(0, len(y), 64):
                    own = y[at : at + 64]
                    both = np.add.reduceat(flag[np.concatenate([codes[t] for t in own])].astype(np.int64), np.concatenate(([0], np.cumsum(n[own])[:-1])))
                    for t in own[(both > 0) & (100 * both >= threshold * (n[x] + n[own] - both))]:
                        if group[t] != group[x]:
                            links.append((nodes[x], nodes[t]))
                            group[group == group[t]] = group[x]
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _classes(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(doc_id, print, n_shingles, node, component, component_id) of each row; null from node on for rows that can't link.

    ``component`` tells groups of linked texts apart; ``component_id`` is a group's smallest doc_id.
    """
    band = banding(threshold)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    kind = dict(docs.dtypes)["doc_id"]
    signed = cut(docs.mapInArrow(lambda it: _signed(it, k, band), f"doc_id {kind}, print long, n_shingles long, node long, bands array<long>, signature binary"))
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    smallest = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reps = usable.join(smallest, ["doc_id", "node"], "left_semi").dropDuplicates(["node"])
    reps = cut(reps.select("node", "doc_id", "print", F.col("n_shingles").alias("n"), "bands", "signature"))
    keys = F.array(*[F.xxhash64(F.lit(band.collections * i + j), F.col("bands")[i], F.col("bands")[j]) for i, j in combinations(range(band.collections), 2)])
    members = reps.select("node", F.col("n").cast("int").alias("n"), F.posexplode(keys).alias("table", "key")).withColumn("table", F.col("table").cast("short"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = stored(members.join(several, "key", "left_semi"))
    centre = F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node"), F.col("n")))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), centre.alias("c"))
    buckets = stored(buckets.select("key", "size", "shingles", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, text), one text of each."""
        wanted = nodes.distinct().join(reps.select("node", "doc_id", "print"), "node")
        return docs.join(wanted, ["doc_id", "print"]).groupBy("node").agg(F.min("text").alias("text"))

    pairs = cut(members.join(buckets, "key").where((F.col("node") != F.col("centre")) & _fits(F.col("n"), F.col("centre_n"), threshold)).select("centre", "node").distinct())
    text = texts(pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))))
    both = pairs.join(text, "node").join(text.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre")
    links = cut(both.where(_similar(threshold, k)("centre_text", "text")).select(F.col("centre").alias("a"), F.col("node").alias("b")))

    def labelled(df: DataFrame, links: DataFrame) -> DataFrame:
        found = connected_components(links).withColumnRenamed("id", "node")
        return df.join(found, "node", "left").withColumn("component", F.coalesce("component_id", "node")).drop("component_id")

    members = labelled(members, links)
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    mixed = buckets.join(mixed, "key", "left_semi").select("key", "size", "shingles")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.col("size")))
    units = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = units.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(reps.select("node", F.transform("bands", lambda b: F.pmod(b, F.lit(1 << 31)).cast("int")).alias("bands"), "signature"), "node")
    sort = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    units = units.select("key", "i", "j", "table", "node", "n", "component", "block", "bands", "signature")
    units = cut(sort(units).mapInPandas(lambda it: _wanted(it, threshold, band), units.schema))
    more = sort(units.join(texts(units.select("node")), "node")).mapInPandas(lambda it: _linked(it, threshold, k, band), "a long, b long")
    classes = cut(labelled(reps.select("node", "doc_id"), cut(links.unionByName(more))))
    lowest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = classes.join(lowest, "component").select("node", "component", "component_id")
    rows = signed.select("doc_id", "print", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")).alias("node"))
    return rows.join(found, "node", "left")


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; links are Jaccard similarities of at least ``threshold`` percent.

    1. One scan gives each text's shingle set size, fingerprint and minhashes. Texts with equal sets are one node,
       represented by their smallest id, so copies meet in no bucket.
    2. In each bucket (table key) a random member is paired with all others: a line per member, never all pairs.
       Different tables have different such centres. Candidates whose sizes fit are verified on the full sets of whole
       texts, and verified links give components.
    3. Buckets that still hold several components are compared across components, in pairs of blocks: pairs of one
       component need no link any more, and of the others those with ``agree`` equal minhashes are verified within
       the task, once, in the first table that they share. So pairs that share a bucket are settled without a
       cap, and what is shuffled are members and their texts, never pairs. A block has a bounded number of shingles.

    What can be missed are pairs that share no table and pairs that the filter of step 3 leaves out: at exactly the
    threshold a share of ``missed`` + ``FILTERED`` (see ``banding``), fewer above it; a group of several links stays
    whole as long as some of them are found.

    Defined results: null ids, texts without words and null texts link with nothing and stay; repeated rows are copies;
    rows of one doc_id with different texts are told apart, each with its own text's links; texts of any length count
    whole; component_id is the smallest doc_id reachable; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    out = _classes(docs, k, threshold)
    found = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group of linked texts, with all its columns: one of the group's smallest doc_id.

    Rows are told apart by doc_id and text, so a row goes only for its own text. Defined results: rows without doc_id
    or words stay, repeated or not; of repeated rows one stays; an empty table gives an empty result; columns keep their
    names and order.
    """
    rows = _classes(docs, k, threshold).where("node IS NOT NULL").withColumn("_id", row_key(F.col("doc_id")))
    keys = rows.groupBy("component", "component_id", "doc_id", "_id", "print").agg(F.count(F.lit(1)).alias("n"))
    stay = keys.where(F.col("doc_id") == F.col("component_id")).groupBy("component").agg(F.min("print").alias("print"), F.min("_id").alias("_id"))
    stay = stay.select("_id", F.col("print").alias("_print"), F.lit(True).alias("_stays"))
    keys = cut(keys.select("_id", F.col("print").alias("_print"), "n").join(stay, ["_id", "_print"], "left"))
    return without(docs, keys.where("_stays IS NULL").select("_id", "_print"), keys.where("_stays AND n > 1").select("_id", "_print"))

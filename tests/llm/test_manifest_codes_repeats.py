"""Merkle manifest, vector codes and removal of repeats: against plain Python, and on odd tables."""

import collections
import hashlib
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trajlake.llm import merkle, suffix_dedup, vector_codes  # noqa: E402
from trajlake.llm.suffix_array import common_prefixes, suffix_array  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, digest string, rid long, sha string"
PASSAGE = "".join(f"passage word {i} é " for i in range(30))
ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, "A TEXT" + PASSAGE, "en", "a"), (4, PASSAGE + "b text", "fr", "a"), (4, PASSAGE + "b text", "fr", "a"), (None, "no id", "en", None), (None, None, "en", None),
    (5, " \t lead \n", None, ""), (6, "Short", "", "a"), (7, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "a"), (8, "x" * 450, "fr", "é"), (9, "###", "zz", "b"), (10, "日本" * 150, "en", "a"), (11, "c" + PASSAGE[7:] + "d", "lone", "q"),
] + [(20 + i, f"Row {i}", "many", None) for i in range(70)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "x", "y", None, 1, "z") for i, t, lang, s in ODD], DOCS).repartition(5)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(digests):
    """(root, siblings of each leaf level by level) of a tree."""
    ways, nodes, owner = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        for x, place in enumerate(owner):
            run = place // 8 * 8
            ways[x].append((nodes[run:place], nodes[place + 1 : run + 8]))
        nodes, owner = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in owner]
    return nodes[0], ways


def test_merkle_manifest(spark, odd):
    changed = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = sorted(tuple(r) for r in merkle.audited(odd, changed).select("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    trees = collections.defaultdict(list)
    for i, t, lang, source in ODD:
        low = t.lower() if t is not None and i is not None and i % 3 == 0 else t
        trees[lang].append(((i is not None, i or 0), *[leaf_of(i, source, lang, None if t is None else len(t), x) for x in (t, low)]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {n: climbed([leaf for _, leaf, _ in sorted(trees[n])]) for n in names}
    root, above = climbed([found[n][0] for n in names])
    want = []
    for n, up in zip(names, above, strict=True):
        for (_, leaf, low), way in zip(sorted(trees[n]), found[n][1], strict=True):
            fold = low
            for left, right in way + up:
                fold = h(*left, fold, *right)
            want.append((leaf, found[n][0], root, h(*[x for left, right in way + up for x in left + right]), fold, fold == root))
    assert got == sorted(want) and {v for *_, v in got} == {True, False}
    assert merkle.audited(odd.limit(0), F.col("text")).count() == 0


def test_merkle_store_reaches_each_level(spark):
    rows = spark.range(600).select(F.lit("t").alias("tree"), F.col("id").alias("at"), merkle.digest(F.col("id").cast("string")).alias("digest"), F.struct("id").alias("row")).repartition(7)
    folder = merkle.shared_folder(spark)
    assert merkle.build(rows, folder) == 4
    assert [spark.read.parquet(f"{folder}/level={k}").count() for k in range(5)] == [600, 75, 10, 2, 1]
    assert merkle.roots(spark, folder, 4).first()["digest"] == climbed([h(str(i)) for i in range(600)])[0]


VECTORS = "vec_id long, label int, embedding array<double>, code string, part int, v string"


def coded_slowly(rows, width):
    kept = [(i, label, [math.floor(1024 * x) for x in e]) for i, label, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    m = width // 4
    books = [[v[p * m : (p + 1) * m] for _, _, v in kept[:256]] for p in range(4)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * m : (p + 1) * m], c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(4):
        groups = collections.defaultdict(list)
        for _, _, v in kept:
            for p in range(4):
                groups[p, near(p, v)[1]].append(v[p * m : (p + 1) * m])
        for (p, e), own in groups.items():
            books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, label, "".join(f"{near(p, v)[1]:02x}" for p in range(4)), sum(near(p, v)[0] for p in range(4))) for i, label, v in kept]
    return out, ",".join(str(x) for b in books for c in b for x in c)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3) if i % 5 else None, [float(x) for x in np.round(rng.normal(size=8), 1) * scale]) for i in range(330)]
    rows += [(7, 1, rows[7][2]), (8, 2, rows[9][2]), (None, 1, rows[3][2]), (400, 1, None), (401, 1, []), (402, 1, [1.0] * 7 + [None]), (403, 1, [math.nan] + [0.0] * 7), (404, None, [math.inf] + [0.0] * 7), (405, 1, [1.0] * 4), (406, 1, [1.0] * 7)]
    coded, books = vector_codes.encode(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3))
    want, text = coded_slowly(rows, 8)
    assert vector_codes.books_text(books) == text
    got = [tuple(r) for r in vector_codes.with_label_errors(coded).select("vec_id", "label", "code", "error", "label_error").collect()]
    sums = collections.Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert sorted(map(str, got)) == sorted(str((i, label, c, e, sums[label])) for i, label, c, e in want)


def test_vector_codes_of_few_and_none(spark):
    coded, _ = vector_codes.encode(spark.createDataFrame([(1, 1, [0.5, 0.25, 1.0, -1.0], "", 1, "")], VECTORS))
    assert [tuple(r) for r in coded.collect()] == [(1, 1, "00000000", 0)]
    coded, _ = vector_codes.encode(spark.createDataFrame([], VECTORS))
    assert vector_codes.with_label_errors(coded).count() == 0


def test_huge_components_have_a_result(spark):
    coded, _ = vector_codes.encode(spark.createDataFrame([(i, 1, [1e300 * (-1) ** i, 0.0, 1e30, 1.0], "", 1, "") for i in range(3)], VECTORS))
    assert {r["error"] for r in vector_codes.with_label_errors(coded).collect()} == {0}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(1 + x % 3 for x in b)), st.sampled_from([8, 16, 200]), st.randoms())
def test_suffix_array(text, depth, random):
    text = np.frombuffer(text + b"\0", dtype=np.uint8)
    padded = text.tobytes() + bytes(depth)
    order = suffix_array(text, depth)
    assert sorted(order) == list(range(len(text)))
    prefixes = [padded[i : i + depth] for i in order]
    assert prefixes == sorted(prefixes)
    shared = [next((j for j in range(depth) if a[j] != b[j]), depth) for a, b in zip(prefixes, prefixes[1:], strict=False)]
    assert common_prefixes(text, order, depth).tolist() == [0, *shared]
    wanted = np.array([random.random() < 0.4 for _ in text])
    some = suffix_array(text, depth, wanted)
    assert sorted(some) == np.flatnonzero(wanted).tolist() and [padded[i : i + depth] for i in some] == sorted(padded[i : i + depth] for i in some)


def without_repeats(texts):
    n = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def as_rows(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def repeats_slowly(ids, texts):
    return sorted((str(i), *r) for i, r in zip(ids, without_repeats([(t or "").encode() for t in texts]), strict=True))


def test_repeats_of_odd_texts(spark, odd):
    assert as_rows(suffix_dedup.remove_repeats(odd)) == repeats_slowly([r[0] for r in ODD], [r[1] for r in ODD])
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_where_cores_are_split(spark, monkeypatch):
    """A hot passage with other surroundings each time, so that cores are split down to one place."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, size=n))
    passage, other = noise(260), noise(201)
    texts = [noise(int(rng.integers(0, 300))) + passage[int(rng.integers(0, 40)) : 260 - int(rng.integers(0, 40))] + noise(int(rng.integers(0, 300))) for _ in range(60)]
    texts += [noise(3000) + other + noise(3000) + other, noise(199), noise(200), "ab" * 700 + noise(50), noise(50) + "ab" * 200]
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert as_rows(suffix_dedup.remove_repeats(docs)) == repeats_slowly(range(len(texts)), texts)


def windows_of(anchors, n=0, start=0, ends=None):
    return {(int(w) - (int(ends[n - 1]) if n else 0) + start, int(a) - (int(ends[n - 1]) if n else 0) + start) for a, first, last, _ in zip(*anchors, strict=True) for w in range(first, last + 1)}


def test_blocks_of_long_texts_share_windows(monkeypatch):
    """Each window of each text has one anchor, in a block as in the whole text."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, size=n, dtype=np.uint8)) for n in (0, 5, 199, 200, 900, 2500)] + [b"a" * 700]
    whole = [windows_of(suffix_dedup.anchors(np.frombuffer(t, dtype=np.uint8), np.array([len(t)]))) for t in texts]
    assert [sorted(w for w, _ in own) for own in whole] == [list(range(max(len(t) - 199, 0))) for t in texts]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    found = [set() for _ in texts]
    for rows, starts, parts in suffix_dedup._blocks(texts):
        ends = np.cumsum([len(p) for p in parts])
        got = suffix_dedup.anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends)
        for n, (row, start) in enumerate(zip(rows, starts, strict=True)):
            own = [(0 if n == 0 else ends[n - 1]) <= a < ends[n] for a in got[0]]
            found[row] |= windows_of([x[own] for x in got], n, start, ends)
    assert found == whole

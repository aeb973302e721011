"""The corpus operators: against SQL, brute force, round trips, held-out rows and odd tables."""

import collections
import math
import re
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SF, compare  # noqa: E402

from trajlake.llm import chat_format, components, embedding_dedup, exact_dedup, language_id, license_scan, minhash_dedup, mixing, packing, quality, sharding, shingles  # noqa: E402
from trajlake.llm.oracle import ORACLE_SQL  # noqa: E402
from trajlake.llm.queries import QUERIES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, target string, kept string, taken string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(300_000))
ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, "Same text of five words here", "en", "a"), (4, "sAME text of five words here", "fr", "a"), (4, "sAME text of five words here", "fr", "a"),
    (None, "no id at all but text", "en", None), (5, " \t lead and  trail \n", None, ""), (6, "x", "en", "a"), (7, LONG, "en", "a"), (8, "été ß 日本 <|endoftext|> 😀", "fr", "é"), (9, "###", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, len(t) if t is not None else None, "x", "y", None, "z") for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(3, None, 0)], "doc_id long, quality int, toxic int")


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_sharding(spark, odd):
    got = sharding.shard_documents(odd, 5).collect()
    assert len(got) == len(ODD)
    for shard, rows in collections.Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(rows))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 8)} == {(1, 16, None), (8, 16 + len(ODD[9][1].encode()), zlib.crc32(ODD[9][1].encode()))}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = collections.Counter(r["shard"] for r in sharding.shard_documents(many, weights=[1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and abs(n[1] / 20_000 - 0.75) < 0.02
    assert sharding.shard_documents(odd.limit(0), 5).count() == 0


def test_mixing(spark, odd):
    plan = mixing.mix_plan(odd, shards=4).collect()
    assert len(plan) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(odd.repartition(7), shards=4).collect()))
    mixed = mixing.mix(odd, shards=4)
    assert mixed.columns == odd.columns
    rows, got = {r["doc_id"]: r for r in odd.collect()}, collections.Counter()
    for r in mixed.collect():
        assert r == rows[r["doc_id"]]  # whole, with all columns
        got[r["doc_id"]] += 1
    size, taken, times = {}, collections.Counter(), collections.Counter()
    for r in plan:
        size[r["doc_id"]] = r["size"]
        taken[r["doc_id"]] += r["taken"]
        times[r["doc_id"]] += 1
    for i, words in size.items():  # as often as planned, up to the rounding of what is taken in part
        assert got[i] == 0 if not words else times[i] * (taken[i] // (times[i] * words)) <= got[i] <= times[i] * -(-taken[i] // (times[i] * words))
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0
    many = mixing.mix(docs_of(spark)).count()
    mixing_most, mixing.MOST_STREAMS = mixing.MOST_STREAMS, 0  # joined by a shuffle
    try:
        assert mixing.mix(docs_of(spark)).count() == many > 0
    finally:
        mixing.MOST_STREAMS = mixing_most


def test_mix_reaches_targets(spark):
    rows = mixing.mix_plan(docs_of(spark, "/root/testdata/sf0.01")).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert rows and all(abs(r["t"] - r["target"]) <= 0.01 * r["target"] for r in rows)


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline as p

    docs = docs_of(spark, "/root/testdata/sf0.01")
    mixed, whole = p.source_mix(spark, docs, "").select("doc_id", "source", "text").collect(), {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert mixed and all((r["doc_id"], r["text"]) in whole for r in mixed)
    goal = {r["source"]: r["target"] for r in mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    got, most = collections.Counter(), collections.Counter()
    for r in docs.collect():
        most[r["source"]] = max(most[r["source"]], len(WORD.findall(r["text"] or "")))
    for r in mixed:
        got[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(got[s] - t) <= most[s] + 0.01 * t for s, t in goal.items())


def test_quotas_are_sainte_lague(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"s{k}", int(b), int(v)) for s in range(6) for k, (b, v) in enumerate((b, rng.random() * 2 * b * mixing.VOTE) for b in rng.integers(1, 400, size=12))]
    got = {(r["_shard"], r["_src"]): r["_quota"] for r in mixing.quotas(spark.createDataFrame(rows, "_shard long, _src string, _blocks long, _votes long"), 2.0).collect()}
    for shard in range(6):
        own = [r for r in rows if r[0] == shard]
        seats = int(sum(r[3] for r in own) / mixing.VOTE + 0.5)
        best = sorted(((-v / (2 * s - 1), k, s) for _, k, b, v in own for s in range(1, 2 * b + 1)))[:seats]
        want = collections.Counter(k for _, k, _ in best)
        assert all(got[shard, k] == want[k] for _, k, *_ in own)


def test_language_id(spark, odd):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien été", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(odd, train).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[9]["lang_pred"] == "und" and got[9]["score"] == 0
    assert got[8]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify_languages(odd, train.limit(0)).collect()} == {"und"}
    assert language_id.identify_languages(odd.limit(0), train).count() == 0
    names = identify = language_id.identify_languages(odd.withColumnsRenamed({"shard": "lang_pred", "target": "score"}), train)
    assert names.columns.count("lang_pred") == names.columns.count("score") == 1 and identify.count() == len(ODD)
    ties = spark.createDataFrame([("aaa", "y"), ("aaa", "x")], "text string, lang string")
    assert language_id.identify_languages(odd.where("doc_id = 6"), ties).first()["lang_pred"] == "x"
    lang = docs_of(spark).select("doc_id", "lang")
    held = QUERIES["op3_language_id"](spark, SF).where("held_out").join(lang, "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def brute_languages(training, texts):
    """Naive Bayes n-gram by n-gram, with the operator's own hash of an n-gram."""
    letters = lambda t: "".join(c.lower() if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in t)
    factors = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

    def grams(text):
        s = f" {letters(text)}  "
        for order in (1, 2, 3):
            for i in range(len(s) - 2):
                g = s[i : i + order]
                if not g[: min(order, 2)].isspace():
                    h = (order + sum(ord(c) * f for c, f in zip(g, factors))) % 2**64
                    yield ((h ^ (h >> 29)) * factors[2] % 2**64) >> 49

    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in training:
        counts[lang].update(grams(t))
        docs[lang] += 1
    out = []
    for t in texts:
        own = collections.Counter(grams(t))
        score = {lang: math.log(docs[lang] / docs.total()) + sum(n * math.log((c[b] + 0.5) / (c.total() + 0.5 * 32768)) for b, n in own.items()) for lang, c in counts.items()}
        best = max(sorted(score), key=score.get)
        out.append(("und", 0.0) if not any(c.isalpha() for c in t) else (best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return counts, out


def test_languages_equal_brute_force(spark, monkeypatch):
    import trajlake.llm.textbatch as textbatch

    training = [("Thé cat, and the dog", "en"), ("le chat et le chien été", "fr"), ("der Hund und die Katze", "de"), ("the end", "en")]
    texts = ["the dog", "chien", "Katze!", "\u0301", "e\u0301", "12 3", "", "le the der " * 50]
    want_counts, want = brute_languages(training, texts)
    counts = collections.defaultdict(dict)
    for r in language_id.counted(spark.createDataFrame(training, "text string, lang string")).collect():
        if r["bucket"] >= 0:
            counts[r["lang"]][r["bucket"]] = r["n"]
    assert counts == {k: dict(v) for k, v in want_counts.items()}
    for limit in (64, 2):  # in one model, and put together from two
        monkeypatch.setattr(language_id, "LANGUAGES", limit)
        got = language_id.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(training, "text string, lang string")).orderBy("doc_id").collect()
        assert [r["lang_pred"] for r in got] == [x for x, _ in want] and np.allclose([r["score"] for r in got], [x for _, x in want])
    one = list(textbatch.chunks(["abcdefghij"], 100))
    for size in (1, 2, 3, 4):  # the n-grams of a text are those of its parts
        parts = [p for _, ps in textbatch.chunks(["abcdefghij"], size) for p in ps]
        whole = sorted(np.concatenate(language_id._grams(one[0][1])[0]))
        cut = sorted(np.concatenate([b for p in parts for b in language_id._grams([p])[0]]))
        assert [b for b in cut if b < 32768] == [b for b in whole if b < 32768]


def test_chats(spark):
    t = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, None, None), (5, 0, "", ""), (6, 0, None, None), (None, 0, "user", "z"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in t], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert sorted(got) == [3, 4, 5, 7] and got[4]["n_copies"] == 2 and got[3]["rendered"].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_e8():
    x = np.random.default_rng(0).normal(size=(2000, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    assert np.all(p * 2 == np.rint(p * 2)) and np.all(np.rint(p.sum(1)) % 2 == 0)
    d = ((x - p) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9 and all((((x - (p + v)) ** 2).sum(1) >= d - 1e-9).all() for v in embedding_dedup._shell())


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(40, 64))
    for i in range(400):
        v = base[i % 40] + rng.normal(size=64) * rng.choice([0, 0.05, 0.1, 0.14])
        rows.append((i, [float(np.float32(a)) for a in v], i % 2))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [float("nan")] * 64, 1), (1004, [None] * 64, 1), (1005, rows[0][1], None), (None, rows[0][1], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [1e308, 1e308], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_embeddings(df).collect()}
    assert len(got) == len(rows)
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    usable = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, v, a) in enumerate(usable):
        for j, w, b in usable[:n]:
            if a == b and len(v) == len(w) and (v / np.linalg.norm(v / abs(v).max()) / abs(v).max()) @ (w / np.linalg.norm(w / abs(w).max()) / abs(w).max()) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (links[i], find(i) if i is not None else None, find(i) == i) for i, *_ in rows}
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in where[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_minhash(spark, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op6_minhash_near_dedup"](spark, SF).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs_of(spark).collect()], 3, 85)
    rows = minhash_dedup.near_duplicates(odd, k=3, threshold=85).collect()
    assert len(rows) == len(ODD) and {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (1, 3, 4, None)} == {(1, 1), (3, 3), (4, 3), (None, None)}
    assert minhash_dedup.drop_near_duplicates(odd).columns == odd.columns
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_group_around_one_text(spark):
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(150, size=rng.integers(1, 9), replace=False):
            w[p] = f"m{i}_{p}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, threshold=85).collect()}
    want = brute_components(rows, 3, 85)
    assert sum(got[i] != want[i] for i in want) <= 1


def test_shingles_of_long_and_odd_texts():
    texts = [LONG, "y" * (3 << 20), "a b", None, "", "A B", " a\tb\n", "y" * (3 << 20) + " z"]
    got = list(shingles.shingle_sets(texts, 3))
    assert [len(s) for s in got] == [977, 1, 1, 0, 0, 1, 1, 1]
    assert got[2].tolist() == got[5].tolist() == got[6].tolist() and got[1].tolist() != got[7].tolist()


def test_exact_dedup(spark, odd):
    got = [r.asDict() for r in exact_dedup.exact_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3, 4)} == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True)}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0 and exact_dedup.drop_exact_duplicates(odd.limit(0)).count() == 0


REPEATS = [(1, "a b"), (2, "a b"), (1, "unique text"), (5, "z"), (5, "z"), (5, "Z"), (None, "n"), (None, "n"), (6, None), (6, ""), (7, "a c")]


def test_drops_are_by_row(spark):
    """A row goes only for its own text, and repeated rows leave one, whatever ids they share."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in REPEATS], "doc_id long, text string, _row string")
    left = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=str)
    assert [(i, (t or "").lower()) for i, t in left] == [(1, "unique text"), (2, "a b"), (5, "z"), (6, ""), (7, "a c"), (None, "n")]
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = collections.Counter((r["doc_id"], (r["text"] or "").lower()) for r in left.collect())
    assert got == {(1, "a b"): 1, (1, "unique text"): 1, (5, "z"): 1, (None, "n"): 2, (6, ""): 2, (7, "a c"): 1}


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    both = odd.select("doc_id", "text").unionByName(docs_of(spark).select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = packing.pack(both, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    parts = collections.defaultdict(dict)
    bins = collections.defaultdict(list)
    for r in rows:
        parts[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"] <= 1024
    for i, text in texts.items():
        own = [parts[i][k] for k in sorted(parts[i])]
        assert [x for r in own for x in r["ids"]] == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 1024
    assert packing.pack(odd.limit(0)).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for size in (10, 64, 1024):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, size + 1, 60), rng.integers(1, 30, 60), strict=True)}
        bins: list[int] = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [i for i, left in enumerate(bins) if left >= n]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= n
            else:
                bins.append(size - n)
        rules = packing.best_fit_plan(counts, size)
        fill = collections.Counter()
        for n, c in counts.items():
            own = sorted(r.tolist() for r in rules if r[0] == n)
            for rank in range(c):
                r = [x for x in own if x[1] <= rank][-1]
                fill[r[2] + (rank - r[1]) // r[3]] += n
        assert sorted(fill.values()) == sorted(size - b for b in bins)


def test_license_scan(spark):
    texts = [(1, "prose here\nReleased under the MIT License.\nmore"), (2, "RELEASED under the mit license"), (3, None), (4, ""), (5, "license"), (6, "Released under the MIT Licence!"), (7, "nothing of the kind is said in this line of prose")]
    got = {(r["doc_id"], r["unit"], r["license_id"]) for r in license_scan.scan_licenses(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, dice string")).collect()}
    assert got == {(1, 1, "MIT"), (2, 0, "MIT")}


def test_license_bounds_and_odd_tables(spark):
    """Matches at exactly the threshold count, by brute force over lines of every template with words added."""
    rows, want = [], set()
    grams = lambda t: set(license_scan._python_bigrams(t))

    def named(line, name, template):
        """Whether a line names the version of a template, if that has one."""
        version = re.search(r"-(\d+)\.(\d+)", name)
        if not version:
            return True
        both, one = " ".join(version.groups()), f" {version[1]}"
        return both in grams(line) if both in grams(template) else not any(g.endswith(one) for g in grams(template)) or any(g.endswith(one) for g in grams(line) & grams(template))

    for n, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        for k in range(6):
            for line in (f"{'Zeta ' * (k > 0)}{t} {' '.join(f'eta{i}' for i in range(k))}", " ".join(t.split()[: len(t.split()) - k])):
                rows.append((len(rows), line))
                dice = [(2 * len(grams(line) & grams(u)) / max(len(grams(line)) + len(grams(u)), 1), m) for m, u in license_scan.TEMPLATES.items() if named(line, m, u)]
                if max(dice, default=(0,))[0] >= 0.8:
                    want.add((len(rows) - 1, max(dice)[1], max(dice)[0]))
    rows.append((len(rows), "Module released under the MIT License today"))
    want.add((len(rows) - 1, "MIT", 0.8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["wording"], r["dice"]) for r in license_scan.scan_licenses(df).where("unit = 0").collect()}
    assert got == want
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    twice = license_scan.scan_licenses(spark.createDataFrame([(1, "Released under the MIT License.", "x")] * 2 + [(2, LONG + " released under the MIT License. " + LONG, "x")], "doc_id long, text string, unit string")).collect()
    assert sorted((r["doc_id"], r["unit"], r["license_id"]) for r in twice) == [(1, 0, "MIT"), (1, 0, "MIT"), (2, -2, "MIT")]
    same = license_scan.scan_licenses(df.where("doc_id = 0"), templates={"B": license_scan.TEMPLATES["MIT"], "A": license_scan.TEMPLATES["MIT"]}).collect()
    assert [r["license_id"] for r in same] == ["B"]


def test_license_families_texts_and_windows(spark):
    notice, isc, mit = license_scan.TEMPLATES["MPL-2.0"].split(), license_scan.TEMPLATES["ISC"].split(), license_scan.TEMPLATES["MIT (text)"]
    prose = " ".join(f"ordinary{i} prose" for i in range(200))
    wrap = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    texts = [
        (1, "prose here\nLicensed under CC BY-NC 4.0.\nmore"), (2, f"{prose}\n{wrap(notice, 9)}\n{prose}\n{wrap(isc, 8)}\n{prose}"), (3, f"{prose} released under the MIT license. {prose}"),
        (4, mit), (5, f"{prose}\n{wrap(mit.split(), 12)}\n{prose}"), (6, wrap(mit.split(), 12)), (7, prose),
    ]
    got = {(r["doc_id"], r["unit"], r["wording"]) for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    last = 2 + texts[1][1].split("\n").index(" ".join(isc[:8]))
    assert got == {(1, 1, "CC-BY-NC-4.0"), (1, -1, "CC-BY-NC-4.0"), (2, -3, "MPL-2.0"), (2, -last, "ISC"), (3, -2, "MIT"), (4, 0, "MIT (text)"), (5, -3, "MIT (text)"), (6, -1, "MIT (text)")}


def test_license_versions(spark):
    """The version that a text names, in lines and in windows; an unknown one is no match."""
    prose = " ".join(f"ordinary{i} prose" for i in range(100))
    notice = "This work is licensed under the GNU {}General Public License, version {}."
    cases = [(notice.format("", "2"), "GPL-2.0"), (notice.format("", "3"), "GPL-3.0"), (notice.format("Lesser ", "2.1"), "LGPL-2.1"), (notice.format("Lesser ", "3"), "LGPL-3.0"), (notice.format("", "7"), None)]
    cases += [(f"This work is licensed under a Creative Commons Attribution {v} International License.", f"CC-BY-{v}" if v in ("3.0", "4.0") else None) for v in ("3.0", "4.0", "9.0")]
    texts = [(i, t) for i, (t, _) in enumerate(cases)] + [(100 + i, f"{prose} {t} {prose}") for i, (t, _) in enumerate(cases)]
    got = {(r["doc_id"] % 100, r["unit"] < 0, r["license_id"]) for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {(i, w, name) for i, (_, name) in enumerate(cases) for w in (False, True) if name}


def test_quality(spark, odd, labels):
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    sf = "/root/testdata/sf0.01"
    held = QUERIES["op10_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert held.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_word_vectors_come_from_neighbours(spark):
    """Words with equal neighbours in other documents have equal directions, and long texts' words aren't cut."""
    texts = ["red cat sat down", "red dog sat down", "blue fish swam off", None, "", "alone"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    v = quality.word_vectors(docs)
    assert np.array_equal(v, quality.word_vectors(docs.repartition(5)))
    word = lambda w: v[quality._hashed(w)[0][0]]
    assert np.allclose(word("cat"), word("dog"), atol=1e-6) and word("cat") @ word("fish") < 0.9 and not word("alone").any()
    long = "ab" * 300_000 + " " + "cd" * 300_000 + " red"
    (_, _, ids, _), = quality._groups([long])
    assert ids.tolist() == [quality._hashed(w)[0][0] for w in long.split()]
    got = quality.features(["red cat", long, None, "cat red", "dog"], v)
    assert np.allclose(got[0], got[3]) and np.allclose(got[4][:64], word("dog")) and not got[2][:64].any()


def test_vectors_of_one_id_and_repeated_rows(spark):
    """Links follow vectors, not ids: (1, x) and (1, y) link with other vectors each on its own."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.05]
    df = spark.createDataFrame([(1, x, 0), (1, y, 0), (2, z, 0), (3, x, 0), (3, x, 0), (4, [0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.link_embeddings(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)])


def test_word_vectors_equal_brute_force(spark):
    """Sums of neighbours' index vectors, word by word, then directions less their mean; features are means of them."""
    texts = ["a b c d e", "b a", "solo", "", "c c a"]
    at, signs = quality._index()
    ident = lambda w: int(quality._hashed(w)[0][0])
    raw = np.zeros((quality.WORDS, quality.DIMENSIONS))
    for t in texts:
        w = t.split()
        for i, own in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    raw[ident(own), at[ident(w[j])]] += signs[ident(w[j])]
    used = raw.any(axis=1)
    raw[used] /= np.linalg.norm(raw[used], axis=1, keepdims=True)
    raw[used] -= raw[used].mean(axis=0)
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, raw, atol=1e-6)
    f = quality.features(texts, got)
    for t, row in zip(texts, f, strict=True):
        w = t.split()
        mean = sum((got[ident(x)] for x in w), np.zeros(quality.DIMENSIONS)) / max(len(w), 1)
        shares = [n / len(w) for n in collections.Counter(map(ident, w)).values()]
        want = [*mean, math.log(np.linalg.norm(mean) + 1e-6), math.log1p(len(w)), -sum(p * math.log(p) for p in shares) / math.log(len(w) + 2)]
        assert np.allclose(row, want, atol=1e-5)


def test_pipeline_of_nothing_and_clashing_names(spark, odd, labels, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    clashing = odd.withColumnsRenamed({"shard": "score", "target": "predicted", "kept": "_row", "taken": "_id"})
    for docs in (odd.limit(0), clashing):
        rows = docs
        for _, stage in p.STAGES:
            out = stage(spark, rows, sf)
            assert out.columns == docs.columns or stage is p.packed_sequences
            rows = out
        assert (rows.count() == 0) == (docs is not clashing)


def test_pipeline(spark, odd, labels, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    docs_of(spark).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs, counts = docs_of(spark), []
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{i}")
        docs = spark.read.parquet(f"{sf}/stage{i}")
        counts.append(docs.count())
        if i == 2:
            assert all(kept for *_, kept in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80).values())
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert p.run(spark, sf).count() == counts[-1]
    rest = odd
    for _, stage in p.STAGES:
        labels.write.mode("overwrite").parquet(f"{sf}/odd/labels.parquet")
        rest = stage(spark, rest, f"{sf}/odd")
    assert rest.count() > 0

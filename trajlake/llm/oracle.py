"""DuckDB SQL for the queries that SQL can express, written independently of the operators' own shortcuts."""

from __future__ import annotations

from trajlake.llm.license_scan import TEMPLATES

#: CRC-32 byte by byte; shards by the largest of 41 draws of 48 bits.
OP1 = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null') AS k,
        CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
          lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) END AS text_crc32
      FROM documents, tab),
draws AS (SELECT d.*, s, CAST('0x' || substr(md5('0:' || k || ':' || CAST(s // 2 AS VARCHAR)), CAST(1 + 16 * (s % 2) AS INTEGER), 12) AS BIGINT) AS u FROM d, range(41) r(s)),
won AS (SELECT doc_id, size, text_crc32, arg_max(s, u) FILTER (s < 40) AS shard, arg_max(s, u) AS grown_shard FROM draws GROUP BY doc_id, size, text_crc32),
slices AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'slot', CAST(doc_id AS VARCHAR), CAST(text_crc32 AS VARCHAR))), 1, 8) AS BIGINT) % 1024 AS slice FROM won)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM slices"""

#: All seats of all quotients are ranked here.
OP2 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(md5(text), ''))) AS h FROM documents),
rows_ AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS shard, substr(h, 9, 15) AS o, coalesce('s' || source, 'n') AS src FROM d),
src0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY src),
src1 AS (SELECT *, row_number() OVER (ORDER BY src = 'n', src) AS rk FROM src0),
src2 AS (SELECT *, [3, 1, 2][(rk - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM src1),
src3 AS (SELECT *, cap / w AS ratio FROM src2),
src4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM src3),
lvl AS (SELECT arg_min(level, (ratio, rk)) AS l FROM src4 WHERE ratio > level),
src5 AS (SELECT src, source_size, CASE WHEN ratio > level THEN l * w ELSE cap END AS target FROM src4, lvl),
st0 AS (SELECT src, shard, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY src, shard),
st1 AS (SELECT *, greatest((words + 8) // 16, 1) AS n FROM st0 JOIN src5 USING (src)),
st2 AS (SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / greatest(source_size, 1) * n * 1048576) AS BIGINT) ELSE 0 END AS v FROM st1),
seats AS (SELECT shard, CAST(floor(sum(v) / 1048576 + 0.5) AS BIGINT) AS seats FROM st2 GROUP BY shard),
won AS (SELECT shard, src, count(*) AS q FROM (
    SELECT shard, src, row_number() OVER (PARTITION BY shard ORDER BY v / (2 * s - 1) DESC, src, s) AS nth FROM st2, LATERAL (SELECT unnest(range(1, 2 * n + 1)) AS s)) x
  JOIN seats USING (shard) WHERE nth <= seats GROUP BY shard, src),
pl0 AS (SELECT st2.*, coalesce(q, 0) AS q, CAST('0x' || substr(md5('17:' || src || ':' || CAST(shard AS VARCHAR)), 1, 12) AS BIGINT) % n AS f FROM st2 LEFT JOIN won USING (shard, src)),
pl1 AS (SELECT *, q // n AS rounds, f * words // n AS a, least(f + q % n, n) * words // n AS b, greatest(f + q % n - n, 0) * words // n AS c FROM pl0),
pos AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src, shard ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM rows_)
SELECT doc_id, size, source_size, target,
  CAST(rounds * size + greatest(least(b, p + size) - greatest(a, p), 0) + greatest(least(c, p + size) - p, 0) AS BIGINT) AS taken
FROM pos JOIN pl1 USING (src, shard)"""

OP4 = r"""
WITH c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS m FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
eq AS (SELECT m, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY m)
SELECT conv_id, len(m) AS n_turns, n_copies,
  list_aggregate(list_transform(m, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM eq WHERE NOT EXISTS (SELECT 1 FROM eq e WHERE len(e.m) > len(eq.m) AND e.m[1:len(eq.m)] = eq.m)"""

#: All pairs of a label; then the least id that links reach.
OP5 = r"""
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
r(x, m) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.x WHERE r.m < l.b),
c AS (SELECT x, min(m) AS m FROM r GROUP BY x), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(m, vec_id) AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON x = vec_id"""

#: Shared shingles are counted for all pairs that have one; then the least id that links reach.
OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g WHERE doc_id IS NOT NULL),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(x, m) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.x WHERE r.m < l.b),
c AS (SELECT x, min(m) AS m FROM r GROUP BY x)
SELECT doc_id, len(g) AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(m, doc_id) AS kept FROM g LEFT JOIN c ON x = doc_id"""

OP7 = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


def op9() -> str:
    templates = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    words = lambda s: rf"list_filter(regexp_split_to_array(lower({s}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
WITH tpl AS (SELECT *, CASE WHEN m[1] IS NULL THEN [] WHEN list_contains(g, m[1] || ' ' || m[2]) THEN [m[1] || ' ' || m[2]] ELSE list_filter(g, lambda x: ends_with(x, ' ' || m[1])) END AS versions
  FROM (SELECT license_id, {grams("w")} AS g, string_split(nullif(regexp_extract(license_id, '-(\d+[.]\d+)', 1), ''), '.') AS m FROM (SELECT license_id, {words("t")} AS w FROM (VALUES {templates}) v(license_id, t)))),
lines AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l, i: struct_pack(unit := i - 1, w := {words("l")})), lambda x: len(x.w) > 0) AS ls FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, x.unit AS unit, x.w AS w FROM (SELECT doc_id, unnest(ls) AS x FROM lines) UNION ALL SELECT doc_id, -1, {words("text")} FROM lines WHERE len(ls) > 1),
scored AS (SELECT doc_id, unit, license_id, len(u.g) AS n, 2.0::DOUBLE * len(list_intersect(u.g, tpl.g)) / (len(u.g) + len(tpl.g)) AS dice
  FROM (SELECT doc_id, unit, {grams("w")} AS g FROM units WHERE len(w) > 1) u, tpl WHERE len(versions) = 0 OR len(list_intersect(u.g, versions)) > 0)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, regexp_replace(max_by(license_id, (dice, license_id)), ' \(.*\)$', '') AS license_id, max_by(license_id, (dice, license_id)) AS wording, any_value(n) AS n_bigrams, max(dice) AS dice
FROM scored WHERE dice >= 0.8 GROUP BY doc_id, unit"""


#: Nodes level by level, siblings from all nodes of a run, and each leaf's way up. CRC-32 byte by byte.
OP11 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d0 AS (SELECT doc_id, lang, text, concat(__DOC__, __SOURCE__, __LANG__, __CHARS__) AS head,
    doc_id IS NOT NULL AND xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) % 3 = 0 AS hit
  FROM documents, tab),
d1 AS (SELECT doc_id, lang, sha256(head || __TEXT__) AS leaf, sha256(CASE WHEN hit THEN head || __LOWER__ ELSE head || __TEXT__ END) AS found FROM d0),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM d1),
nodes(lang, lev, pos, n, digest) AS (SELECT lang, 0, pos, n, leaf FROM d
  UNION ALL SELECT lang, lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lev, n, pos // 8),
tops AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
top(lev, pos, n, digest) AS (SELECT 0, pos, n, digest FROM tops
  UNION ALL SELECT lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lev, n, pos // 8),
sib AS MATERIALIZED (SELECT a.lang, a.lev, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lev = b.lev AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lang, a.lev, a.pos),
tsib AS MATERIALIZED (SELECT a.lev, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lev = b.lev AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lev, a.pos),
up(id, lang, lev, pos, n, h, p) AS (SELECT id, lang, 0, pos, n, found, '' FROM d
  UNION ALL SELECT id, up.lang, up.lev + 1, up.pos // 8, (n + 7) // 8, sha256(l || h || r), p || l || r FROM up JOIN sib ON up.lang IS NOT DISTINCT FROM sib.lang AND up.lev = sib.lev AND up.pos = sib.pos WHERE n > 1),
over(id, lev, pos, n, h, p) AS (SELECT id, 0, tops.pos, tops.n, h, p FROM up JOIN tops ON up.lang IS NOT DISTINCT FROM tops.lang WHERE up.n = 1
  UNION ALL SELECT id, over.lev + 1, over.pos // 8, (n + 7) // 8, sha256(l || h || r), p || l || r FROM over JOIN tsib ON over.lev = tsib.lev AND over.pos = tsib.pos WHERE n > 1)
SELECT doc_id, leaf, tops.digest AS subroot, top.digest AS root, sha256(p) AS proof_sha256, h AS folded_root, h = top.digest AS verified
FROM d JOIN over ON over.id = d.id AND over.n = 1 JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang JOIN top ON top.n = 1"""
for _name, _value in {"DOC": "doc_id", "SOURCE": "source", "LANG": "lang", "CHARS": "n_chars", "TEXT": "text", "LOWER": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}.items():
    OP11 = OP11.replace(f"__{_name}__", f"coalesce(octet_length(encode(CAST({_value} AS VARCHAR))) || ':' || CAST({_value} AS VARCHAR), '-')")


def op12() -> str:
    """Distances to all entries, round by round; whole numbers below 2**53, so doubles are exact."""
    nearest = lambda books: f"""SELECT p.vec_id, p.label, p.nth, p.part, p.v, min_by(b.entry, (list_inner_product(b.c, b.c) - 2 * list_inner_product(p.v, b.c), b.entry)) AS entry,
      CAST(min(list_inner_product(b.c, b.c) - 2 * list_inner_product(p.v, b.c)) + list_inner_product(p.v, p.v) AS BIGINT) AS error FROM parts p JOIN {books} b USING (part) GROUP BY p.vec_id, p.label, p.nth, p.part, p.v"""  # noqa: E731
    steps = []
    for i in range(4):
        steps.append(f"""n{i} AS MATERIALIZED ({nearest(f"b{i}")}),
        s{i} AS (SELECT part, entry, place, floor(sum(v[place]) / count(*)) AS x FROM n{i}, range(1, 17) r(place) GROUP BY part, entry, place),
        b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(any_value(u.c), b.c) AS c FROM b{i} b LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS c FROM s{i} GROUP BY part, entry) u USING (part, entry) GROUP BY b.part, b.entry, b.c)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS nth FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, label, nth, part, v[1 + part * len(v) // 4:(part + 1) * len(v) // 4] AS v FROM kept, range(4) r(part)),
b0 AS (SELECT part, nth AS entry, v AS c FROM parts WHERE nth < 256),
{", ".join(steps)},
codes AS (SELECT vec_id, nth, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM ({nearest("b4")}) GROUP BY vec_id, nth)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256 FROM codes"""


#: Every 200-byte string of every text, two hex digits a byte, by a hash of 64 bits.
OP13 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT id, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
hits AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
marked AS (SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT id, min(i) AS a, max(i) + 200 AS b FROM (SELECT id, i, sum(new) OVER (PARTITION BY id ORDER BY i) AS r FROM marked) GROUP BY id, r),
cuts AS (SELECT id, a, b, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY a) AS before FROM runs),
gone AS (SELECT id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM cuts JOIN d USING (id) GROUP BY id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN gone USING (id)"""


ORACLE_SQL = {"op1_rendezvous_sharding": OP1, "op2_mixing_sources": OP2, "op4_chat_formatting": OP4, "op5_embedding_near_dedup": OP5, "op6_minhash_near_dedup": OP6, "op7_exact_dedup": OP7, "op9_license_scan": op9(), "op11_merkle_manifest": OP11, "op12_vector_codes": op12(), "op13_suffix_array_dedup": OP13}

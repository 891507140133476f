"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
lengths AS (SELECT DISTINCT n FROM phrase),
win AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
    FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lengths ON len(w) >= n) x),
hit AS (SELECT k, item_id, i, n FROM win JOIN phrase USING (n, p)),
words AS (SELECT k, count(DISTINCT word) AS n_hit
    FROM (SELECT k, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT k, i, n FROM hit) x) y GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
    FROM (SELECT DISTINCT k, cast(item_id AS VARCHAR) AS s FROM hit) x GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, array_to_string(w[i : i + 12], ' ') AS p
    FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13) x),
first AS (SELECT p, min(doc_id) AS owner FROM win GROUP BY p),
gone AS (SELECT DISTINCT k, word
    FROM (SELECT k, unnest(range(i, i + 13)) AS word FROM win JOIN first USING (p) WHERE owner < doc_id) x),
word AS (SELECT k, unnest(range(1, len(w) + 1)) AS word, unnest(w) AS s FROM d),
kept AS (SELECT k, string_agg(s, ' ' ORDER BY word) AS t FROM word ANTI JOIN gone USING (k, word) GROUP BY k),
cut AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k) LEFT JOIN cut USING (k)
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS c FROM d),
g AS (SELECT k, i, c, lag(c) OVER p AS b, lag(c, 2) OVER p AS a FROM t WINDOW p AS (PARTITION BY k ORDER BY i)),
n AS (SELECT k, i, c, b, a,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY k, c) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY k, b, c) ELSE 0 END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY k, a, b, c) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY k) AS rest FROM g),
h AS (SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM n WINDOW p AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, CASE WHEN c3 > 0 THEN c3 / h2
    WHEN c2 > 0 THEN c2 / h1 * pow(0.4, least(i - 1, 2) - 1)
    ELSE greatest(c1, 0.5) / greatest(rest, 1) * pow(0.4, least(i - 1, 2)) END AS s FROM h),
u AS (SELECT k, sum(cast(round_even(ln(s) * 1000000, 0) AS BIGINT)) AS units FROM s GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(units, 0) / 1000000 AS logprob FROM d LEFT JOIN u USING (k)
"""

#: Unsigned CRC-32 of the decimal digits of doc_id.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: xor(e >> 1, (e & 1) * 3988292384))), 4294967295)"""

OP11 = r"""
WITH c AS (SELECT row_number() OVER () AS k, doc_id, coalesce(@crc@, 1) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
t AS (SELECT k, n, unnest(range(n)) AS i, unnest(w) AS s FROM d),
pair AS (SELECT x.k, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.k = y.k AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS part FROM pair),
stretch AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY k, q, part
    HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT k, start, length, min(q) AS period FROM stretch GROUP BY k, start, length),
said AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list
    FROM run GROUP BY k),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length::DOUBLE / period DESC, start, period) AS r FROM run),
gone AS (SELECT DISTINCT k, i FROM (SELECT k, unnest(range(start + period, start + length)) AS i FROM run) x),
kept AS (SELECT k, string_agg(s, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
    sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (k) LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (k) LEFT JOIN kept USING (k)
""".replace("@crc@", CRC32)

OP12 = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS n
    FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (k)
"""


def _leaf(text: str) -> str:
    """What the hash of a row is made of, with `text` as its text."""
    parts = [f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN {CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
node(lvl, g, pos, h, n) AS (
    SELECT 0, g, pos, leaf, n FROM l UNION ALL
    SELECT lvl + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM node WHERE n > 1 GROUP BY lvl, g, pos // 3),
top AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
high(lvl, pos, h, n) AS (
    SELECT 0, pos, subroot, n FROM top UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM high WHERE n > 1 GROUP BY lvl, pos // 3),
low_fold(k, g, lvl, pos, h) AS (
    SELECT k, g, 0, pos, bad FROM l UNION ALL
    SELECT f.k, f.g, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.h ELSE s.h END, '' ORDER BY s.pos))
    FROM low_fold f JOIN node s ON s.g = f.g AND s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 AND s.n > 1
    GROUP BY f.k, f.g, f.lvl, f.pos),
low_end AS (SELECT k, g, arg_max(h, lvl) AS h FROM low_fold GROUP BY k, g),
high_fold(k, lvl, pos, h) AS (
    SELECT k, 0, pos, h FROM low_end JOIN top USING (g) UNION ALL
    SELECT f.k, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.h ELSE s.h END, '' ORDER BY s.pos))
    FROM high_fold f JOIN high s ON s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 AND s.n > 1 GROUP BY f.k, f.lvl, f.pos),
ends AS (SELECT k, arg_max(h, lvl) AS folded_root FROM high_fold GROUP BY k),
sibling AS (
    SELECT f.k, f.lvl, s.pos, s.h FROM low_fold f JOIN node s ON s.g = f.g AND s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 AND s.pos <> f.pos
    UNION ALL
    SELECT f.k, 1000 + f.lvl, s.pos, s.h FROM high_fold f JOIN high s ON s.lvl = f.lvl AND s.pos // 3 = f.pos // 3 AND s.pos <> f.pos),
proof AS (SELECT k, string_agg(h, '' ORDER BY lvl, pos) AS p FROM sibling GROUP BY k),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN top USING (g) JOIN ends USING (k) LEFT JOIN proof USING (k) CROSS JOIN root
"""

ORACLES = {
    "op2_decontamination": OP2, "op3_substring_dedup": OP3, "op4_lm_scoring": OP4, "op5_exact_dedup": OP5,
    "op11_periodic_runs": OP11, "op12_url_filters": OP12, "op13_merkle": OP13}

"""DuckDB SQL of the queries over phrases, near copies and the manifest."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sized(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(map(_sized, fields))})"


def _levels(first: str) -> str:
    return f"""SELECT 0 AS level, grp, idx, n, digest FROM {first} UNION ALL
  SELECT level + 1, grp, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx))
  FROM {{}} WHERE n > 1 GROUP BY level, grp, idx // 16"""


def _sides(nodes: str) -> str:
    return f"""SELECT a.level, a.grp, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.level = b.level AND a.grp = b.grp AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL"""


OP13_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS UINTEGER) AS v FROM range(256) x(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '-') AS grp, {_leaf('text')} AS leaf,
         {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
             lambda crc, c: xor(crc >> 8, CAST(tab.t[CAST(xor(crc, c) & 255 AS INTEGER) + 1] AS UBIGINT))), 4294967295::UBIGINT) AS crc
  FROM documents, tab),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n,
         leaf AS digest FROM d),
nodes AS ({_levels('leaves').format('nodes')}),
tops AS (
  SELECT '' AS grp, grp AS of, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
high AS ({_levels('tops').format('high')}),
sides AS ({_sides('nodes')}),
high_sides AS ({_sides('high')}),
steps AS (
  SELECT row, level, l, r FROM leaves JOIN sides s ON s.grp = leaves.grp AND s.idx = leaves.idx >> (4 * s.level) UNION ALL
  SELECT row, level + 100, l, r FROM leaves JOIN tops ON tops.of = leaves.grp JOIN high_sides s ON s.idx = tops.idx >> (4 * s.level)),
paths AS (SELECT row, string_agg(l || r, '' ORDER BY level) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM steps GROUP BY row),
folded AS (
  SELECT doc_id, leaf, tops.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END, 'r': ''}}, coalesce(path, [])),
           lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}).l AS folded_root
  FROM leaves JOIN tops ON tops.of = leaves.grp LEFT JOIN paths USING (row))
SELECT *, folded_root = root AS verified FROM folded
"""

OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM w, range(1, 5) s(size)),
g AS (SELECT lang, size, array_to_string(w[pos:pos + size - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, k.k, h.f AS l, t.f AS r, CAST(CAST(k.a AS HUGEINT) * 2000000 // (h.f + t.f) AS BIGINT) AS score
  FROM k JOIN g h ON h.lang = k.lang AND h.phrase = array_to_string(k.w[1:k.k], ' ') AND h.size = k.k
         JOIN g t ON t.lang = k.lang AND t.phrase = array_to_string(k.w[k.k + 1:], ' ') AND t.size = k.size - k.k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM x),
s AS (SELECT lang, w, size, a, unnest(range(2, size)) AS m FROM c WHERE size > 2),
u AS (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS pos FROM s),
v AS (SELECT lang, array_to_string(w[pos:pos + m - 1], ' ') AS phrase, max(a) AS longer FROM u GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase
  WHERE o = 1 AND (longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT row, array_to_string(w[pos:pos + 4], ' ') AS shingle
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
z AS (SELECT row, count(*) AS n FROM s GROUP BY row),
k AS (SELECT s.row, s.shingle, z.n FROM s JOIN z USING (row)),
c AS (
  SELECT x.row AS a, y.row AS b, x.n AS an, y.n AS bn, count(*) AS same FROM k x JOIN k y
  ON x.shingle = y.shingle AND x.row < y.row AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * same >= 85 * (an + bn - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(o.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d JOIN r ON r.a = d.row JOIN d o ON o.row = r.b LEFT JOIN z ON z.row = d.row GROUP BY d.row, d.doc_id
"""

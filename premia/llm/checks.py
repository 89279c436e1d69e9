"""SQL that recomputes the registered queries of this folder, where SQL can express them."""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def words(text: str) -> str:
    """Words between ASCII white space."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


# From directed pairs (x, y): the smallest node that each node reaches.
REACHED = """
reached(node, other) AS (
  SELECT x, y FROM pairs
  UNION
  SELECT r.node, p.y FROM reached r JOIN pairs p ON p.x = r.other
),
lowest AS (SELECT node, min(other) AS low FROM reached GROUP BY node)
"""

URLS = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
  FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), {LOWER}) AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON f.page_id = p.page_id AND f.n = 1
"""

EMBEDDINGS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
),
{REACHED},
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(l.low, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(l.low, v.vec_id) AS kept
FROM embeddings v LEFT JOIN degree d ON d.x = v.vec_id LEFT JOIN lowest l ON l.node = v.vec_id
"""

MINHASH = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {words(f"translate(text, {LOWER})")} AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM split, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
pairs AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
),
{REACHED}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.node = d.doc_id
"""

PREFERENCES = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
talks AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM turns GROUP BY conv_id
),
firsts AS (SELECT t[1] AS opening, min(conv_id) AS chosen_id FROM talks GROUP BY t[1]),
answers AS (SELECT *, [i FOR i IN range(1, len(t) + 1) IF t[i].role = 'assistant'] AS a FROM talks),
swapped AS (
  SELECT conv_id, t, [CASE WHEN i = a[len(a)] THEN t[a[1]] ELSE t[i] END FOR i IN range(1, len(t) + 1)] AS r
  FROM answers WHERE len(a) > 1
),
pairs AS (
  SELECT c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.t AS chosen, r.t AS rejected
  FROM talks r JOIN firsts f ON r.t[1] = f.opening JOIN talks c ON c.conv_id = f.chosen_id
  WHERE r.conv_id <> c.conv_id
  UNION ALL
  SELECT conv_id, conv_id, t, r FROM swapped WHERE t <> r
),
prefixes AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(chosen), len(rejected)) + 1) IF chosen[i] <> rejected[i]]) - 1,
                     least(len(chosen), len(rejected))) AS n
  FROM pairs
)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS n_common,
  sha256(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN chosen[1:n]], '')) AS prompt_sha256,
  sha256(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN chosen[n + 1:]], '')) AS chosen_sha256,
  sha256(array_to_string([x.text || '<|end|>' || chr(10) FOR x IN chosen[n + 1:] IF x.role = 'assistant'], '')) AS chosen_trained_sha256,
  sha256(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN rejected[n + 1:]], '')) AS rejected_sha256,
  sha256(array_to_string([x.text || '<|end|>' || chr(10) FOR x IN rejected[n + 1:] IF x.role = 'assistant'], '')) AS rejected_trained_sha256
FROM prefixes
"""

PASSAGE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PASSAGES = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{PASSAGE_WORDS}') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{PASSAGE_WORDS}') AS w FROM benchmark
),
passages AS (
  SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS p
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
),
tokens AS (SELECT doc_id, w[i] AS word, i FROM docs, unnest(range(1, len(w) + 1)) AS u(i)),
found AS (
  SELECT t.doc_id, p.item_id, t.i, len(p.p) AS n
  FROM tokens t JOIN passages p ON t.word = p.p[1] JOIN docs d ON d.doc_id = t.doc_id
  WHERE d.w[t.i : t.i + len(p.p) - 1] = p.p
),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id
),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN names n ON n.doc_id = d.doc_id
"""

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS k
  FROM docs, unnest(range(1, len(w) - 48)) AS u(i)
),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
covered AS (
  SELECT DISTINCT w.doc_id, p
  FROM windows w JOIN firsts f ON f.k = w.k AND f.first < w.doc_id, unnest(range(w.i, w.i + 50)) AS u(p)
),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS k
  FROM (SELECT doc_id, w[p] AS word, p FROM docs, unnest(range(1, len(w) + 1)) AS u(p)) t
  ANTI JOIN covered c ON c.doc_id = t.doc_id AND c.p = t.p
  GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def hexadecimal(digits: str) -> str:
    """The unsigned integer of hexadecimal digits."""
    return f"CAST('0x' || {digits} AS BIGINT)"


INFILL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
),
units AS (
  SELECT *, regexp_extract_all(t, '{UNITS}') AS u, {hexadecimal("substr(h, 1, 8)")} AS h1, {hexadecimal("substr(h, 9, 8)")} AS h2,
         {hexadecimal("substr(h, 17, 8)")} AS h3, {hexadecimal("substr(h, 25, 8)")} AS h4
  FROM docs
),
cuts AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
),
parts AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1 :], ''), '') AS s
  FROM cuts
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def field(name: str) -> str:
    """A value with its length in bytes before it, or a sign for null."""
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def record(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# The checksum bit by bit: the register starts with all bits set, takes a byte (not negative) and then eight shifts (-1).
CRC32 = """
xor(4294967295, list_reduce(
  [4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  LAMBDA c, x : CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END
))
"""


def tree(name: str, leaves: str) -> str:
    """All nodes above ``leaves`` (part, n, pos, h): the nodes of a level are the pairs of the one below."""
    return f"""
{name}(part, n, level, pos, h) AS (
  SELECT part, n, 0, pos, h FROM {leaves}
  UNION ALL
  SELECT part, (n + 1) // 2, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY part, n, level, pos // 2
)"""


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, {record()} AS leaf,
         CASE WHEN {CRC32} % 7 = 0 THEN {record("n_chars + 1")} ELSE {record()} END AS claimed
  FROM documents
),
leaves AS (
  SELECT *, leaf AS h, count(*) OVER (PARTITION BY part) AS n,
         row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM docs
),
{tree("nodes", "leaves")},
subroots AS (
  SELECT part AS name, '' AS part, h, level AS height, count(*) OVER () AS n, row_number() OVER (ORDER BY part) - 1 AS pos
  FROM nodes WHERE n = 1
),
{tree("upper", "subroots")},
heights AS (SELECT max(level) AS top FROM upper),
steps AS (
  SELECT l.part, l.pos, u.level, (l.pos >> u.level) % 2 AS side, coalesce(o.h, '') AS other
  FROM leaves l JOIN subroots s ON s.name = l.part, unnest(range(0, s.height)) AS u(level)
  LEFT JOIN nodes o ON o.part = l.part AND o.level = u.level AND o.pos = xor(l.pos >> u.level, 1)
  UNION ALL
  SELECT l.part, l.pos, s.height + u.level, (s.pos >> u.level) % 2, coalesce(o.h, '')
  FROM leaves l JOIN subroots s ON s.name = l.part, heights, unnest(range(0, top)) AS u(level)
  LEFT JOIN upper o ON o.level = u.level AND o.pos = xor(s.pos >> u.level, 1)
),
proofs AS (SELECT part, pos, sha256(string_agg(other, '' ORDER BY level)) AS proof FROM steps GROUP BY part, pos),
folds(part, pos, level, h) AS (
  SELECT part, pos, 0, claimed FROM leaves
  UNION ALL
  SELECT f.part, f.pos, f.level + 1, CASE side WHEN 1 THEN sha256(other || f.h) ELSE sha256(f.h || other) END
  FROM folds f JOIN steps s ON s.part = f.part AND s.pos = f.pos AND s.level = f.level
)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.name = l.part, upper r, heights t, folds f LEFT JOIN proofs p ON p.part = f.part AND p.pos = f.pos
WHERE r.n = 1 AND f.part = l.part AND f.pos = l.pos AND f.level = s.height + t.top
"""

SQL: dict[str, str] = {
    "op1_url_filter": URLS,
    "op2_embedding_dedup": EMBEDDINGS,
    "op3_minhash_dedup": MINHASH,
    "op4_preferences": PREFERENCES,
    "op5_decontaminate": PASSAGES,
    "op9_substring_dedup": SUBSTRINGS,
    "op11_fill_in_middle": INFILL,
    "op12_merkle_manifest": MERKLE,
}

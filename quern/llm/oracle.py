"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .url_filter import SHARED

_SHARED = ", ".join(f"'{x}'" for x in SHARED)
_STRENGTH = """SELECT least(greatest(coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000), 1), 1000)::DOUBLE AS s FROM (
  SELECT (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM {} WHERE n > 0)"""
OP5 = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
y AS (SELECT p.host, 1 AS one, 1 - l.quality AS bad FROM p JOIN labels l ON l.doc_id = p.page_id WHERE l.quality IS NOT NULL
      UNION ALL SELECT host, 0, 0 FROM p),
h0 AS (SELECT host, sum(one) AS n, sum(bad) AS bad, string_split(host, '.')[-1] AS suffix,
              array_to_string(string_split(host, '.')[CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SHARED}) THEN -3 ELSE -2 END:], '.') AS domain
       FROM y GROUP BY host),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
top AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS m FROM s0 HAVING sum(n) > 0),
s1 AS (SELECT s0.*, m FROM s0, top),
s2 AS (SELECT suffix, (m * s + bad) / (s + n) AS m FROM s1, ({_STRENGTH.format('s1')})),
d1 AS (SELECT d0.*, s2.m FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (m * s + bad) / (s + n) AS m FROM d1, ({_STRENGTH.format('d1')})),
h1 AS (SELECT h0.*, d2.m FROM h0 JOIN d2 USING (domain)),
h2 AS (SELECT host, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM h1, ({_STRENGTH.format('h1')})),
rep AS (SELECT host, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM h2),
r(name, rhost, rpath, rverdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
j AS (
  SELECT p.page_id, p.host, p.path, rep.lower,
         (SELECT max_by(r.name, length(r.name)) FROM r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule
  FROM p LEFT JOIN rep USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT rverdict FROM r WHERE r.name = j.rule)
            WHEN coalesce(lower > 0.25, false) THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""




def _spans(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Rows (t, rank, kind, s, e, v) of a kind's valid matches; a match stands after the pieces and matches before it."""
    return rf"""SELECT t, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
      SELECT t, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT t, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts) WHERE len(m) > 0))
    WHERE {valid}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), (i + 1)::INT, 1)::INT
       WHEN substr(reverse({_DIGITS}), (i + 1)::INT, 1)::INT > 4 THEN 2 * substr(reverse({_DIGITS}), (i + 1)::INT, 1)::INT - 9
       ELSE 2 * substr(reverse({_DIGITS}), (i + 1)::INT, 1)::INT END)) % 10 = 0"""
_IP = "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))"
#: Counts of values, terms and both over distinct texts, as stated in `pii`.
OP2 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS MATERIALIZED (SELECT DISTINCT t FROM docs),
b AS MATERIALIZED (
  {_spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_spans('ip', 1, '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', _IP)}
  UNION ALL {_spans('card', 2, '[0-9](?:[ -]?[0-9])+', _LUHN)}
  UNION ALL {_spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 10 AND 15")}),
ents AS (SELECT DISTINCT t, kind, CASE WHEN kind IN ('card', 'phone') THEN {_DIGITS} ELSE lower(v) END AS x FROM b),
n AS (SELECT count(*) AS total FROM texts),
gaps AS (SELECT *, coalesce(max(e) OVER (PARTITION BY t ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b),
blank AS (SELECT t, string_agg(substr(t, done::INT + 1, (greatest(s, done) - done)::INT) || repeat(' ', greatest(e - greatest(done, s), 0)::INT), '' ORDER BY s, rank) || substr(t, max(e)::INT + 1) AS u FROM gaps GROUP BY t),
w0 AS (SELECT t, regexp_extract_all(u, '[\p{{L}}\p{{N}}]{{2,}}') AS m, string_split_regex(u, '[\p{{L}}\p{{N}}]{{2,}}') AS g FROM blank),
w AS MATERIALIZED (SELECT t, lower(word) AS term, ends - length(word) AS s, ends AS e FROM (
  SELECT t, word, sum(length(gap) + length(word)) OVER (PARTITION BY t ORDER BY i) AS ends FROM (
    SELECT t, unnest(m) AS word, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM w0))),
ct AS MATERIALIZED (SELECT term, count(*) AS c_t FROM (SELECT DISTINCT t, unnest(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: lower(x))) AS term FROM texts) GROUP BY term),
ce AS (SELECT kind, x, count(*) AS c_e FROM ents GROUP BY ALL),
tw AS MATERIALIZED (SELECT DISTINCT t, term FROM w),
cet AS MATERIALIZED (SELECT kind, x, term, count(*) AS c_et FROM ents JOIN tw USING (t) GROUP BY ALL),
hit AS (SELECT DISTINCT ents.t, cet.term FROM ents JOIN cet USING (kind, x) JOIN tw ON tw.t = ents.t AND tw.term = cet.term JOIN ce USING (kind, x) JOIN ct ON ct.term = cet.term, n
  WHERE c_e < total AND log2(total * c_et / (c_e * c_t)) >= 0.8 * log2(total / c_e)),
marks AS (SELECT t, s, rank, kind, e FROM b UNION ALL SELECT w.t, w.s, 4, 'term', w.e FROM w JOIN hit USING (t, term)),
per AS (SELECT t, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone, count(*) FILTER (rank = 4) AS n_term,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) AS spans FROM marks GROUP BY t)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM docs LEFT JOIN per USING (t)
"""
#: All pairs that share a shingle.
OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ 	-
]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) ELSE [] END AS g FROM w),
sh AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
near AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
pairs AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x),
least_ AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM sets LEFT JOIN least_ USING (doc_id)
"""


def _back(c: str) -> str:
    """`chat_format.unescape`: doubled backslashes apart, then the single forms."""
    parts = rf"string_split({c}, '\\')"
    return rf"array_to_string(list_transform({parts}, lambda x: replace(replace(replace(x, '\e', '</turn>'), '\h', '### '), '\c', ': ')), '\')"


def _escaped(c: str) -> str:
    return rf"replace(replace(replace(replace({c}, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ': ', '\c')"


_CONTROL = " OR ".join(f"contains({c}, '{m}')" for c in ("role", "text") for m in ("</turn>", "### "))
OP9 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, {_CONTROL} OR contains(role, ': ') OR {_back('role')} <> role OR {_back('text')} <> text AS hard FROM c),
r AS (SELECT *, 14 + CASE WHEN hard THEN length({_escaped('role')}) + length({_escaped('text')}) ELSE length(role) + length(text) END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
#: Base 32 of SHA-1 in groups of five hexadecimal digits, which are four characters.
OP10 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda j: list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789abcdef', substr(h, (5 * j + k)::INT, 1)) - 1), lambda a, b: a * 16 + b)) AS vs FROM q)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(vs, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // d) % 32 + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
#: Every prefix as a list; a node's subtree are the nodes whose smallest member passes through it.
OP12 = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS b, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
led AS (SELECT convs.c, i, role, text FROM convs JOIN t ON t.c = b AND i < h),
heads AS (SELECT convs.c, h, count(led.c) AS nb FROM convs LEFT JOIN led USING (c) GROUP BY ALL),
seq AS (SELECT c, i + 1 AS d, role, text FROM led UNION ALL SELECT c, nb + i - h + 1, role, text FROM t JOIN heads USING (c) WHERE i >= h),
pre AS (SELECT c, d, length(text) AS chars, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d) AS p FROM seq UNION ALL SELECT c, 0, 0, [] FROM convs),
m AS MATERIALIZED (SELECT c, d, chars, min(c) OVER (PARTITION BY d, p) AS rep, d = max(d) OVER (PARTITION BY c) AS ends FROM pre),
node AS MATERIALIZED (SELECT rep, d, count(*) AS n, min(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM m GROUP BY rep, d),
up AS (SELECT node.rep, node.d, m.rep AS parent FROM node LEFT JOIN m ON m.c = node.rep AND m.d = node.d - 1),
kids AS MATERIALIZED (SELECT parent AS rep, d - 1 AS d, count(*) AS k FROM up WHERE parent IS NOT NULL GROUP BY ALL),
sums AS (SELECT a.rep, a.d, count(*) FILTER (k IS NULL) AS n_leaves, sum((n - 1) * y.chars) AS saved FROM node y LEFT JOIN kids USING (rep, d) JOIN m a ON a.c = y.rep AND a.d <= y.d GROUP BY ALL)
SELECT rep AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(k, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, e AS ends_sha256
FROM node JOIN up USING (rep, d) JOIN sums USING (rep, d) LEFT JOIN kids USING (rep, d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pii": OP2, "op4_minhash_near_dedup": OP4, "op5_url_filters": OP5, "op9_chat_formatting": OP9, "op10_warc": OP10, "op11_hard_negatives": OP11, "op12_prefix_trie": OP12}

"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from quern.functions.text import SECTION_WEIGHTS
from quern.sources.tables import STOP_WORDS

_TOKENS = r"regexp_extract_all(lower({}), '\b[a-z'']+\b')"
_STOP = "stop(word) AS (VALUES " + ", ".join(f"('{w}')" for w in STOP_WORDS) + ")"
_TOK = f"tok AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word FROM documents)"
_KEPT = f"{_STOP}, {_TOK}, kept AS (SELECT tok.* FROM tok ANTI JOIN stop USING (word))"
_LEX = (
    f"{_KEPT}, lexdf AS (SELECT word, count(DISTINCT doc_id) AS df FROM kept GROUP BY word), "
    "lexrank AS (SELECT word, row_number() OVER (ORDER BY df DESC, word) - 1 AS vec_id FROM lexdf), "
    "lex AS (SELECT word, embedding::DOUBLE[] AS vec FROM lexrank JOIN embeddings USING (vec_id))"
)
_W = "CASE section " + " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(SECTION_WEIGHTS)) + " END"
_WEIGHTED = " + ".join(f"count(*) FILTER (section = {i}) * {w}::DOUBLE" for i, w in enumerate(SECTION_WEIGHTS))
_SECTIONS = f"""{_LEX},
parts AS (SELECT doc_id, source AS title, string_split(text, chr(10)) AS p FROM documents),
secs AS (SELECT doc_id, title, p[1] AS intro, array_to_string(p[2:], ' ') AS rest FROM parts),
stok AS (SELECT doc_id, 0 AS section, unnest({_TOKENS.format('title')}) AS word FROM secs
   UNION ALL SELECT doc_id, 1, unnest({_TOKENS.format('intro')}) FROM secs
   UNION ALL SELECT doc_id, 2, unnest({_TOKENS.format('rest')}) FROM secs),
skept AS (SELECT stok.* FROM stok ANTI JOIN stop USING (word) WHERE word IN (SELECT word FROM lex)),
sfreq AS (SELECT doc_id, word, count(*) AS n, {_WEIGHTED} AS weighted, max(section) AS section FROM skept GROUP BY doc_id, word),
sdf AS (SELECT word, count(*) AS df FROM sfreq GROUP BY word),
ssize AS (SELECT doc_id, sum(n) AS size FROM sfreq GROUP BY doc_id),
w AS (SELECT f.doc_id, f.word, n, size, weighted, {_W} AS last,
        n / size * ln((SELECT count(DISTINCT doc_id) FROM documents) / (1 + df)) AS u
      FROM sfreq f JOIN sdf USING (word) JOIN ssize USING (doc_id))"""
_DOCVEC = f"""{_SECTIONS},
dims AS (SELECT unnest(range(0, (SELECT max(len(vec)) FROM lex))) AS i),
big AS (SELECT doc_id, sum(weighted * u) AS bw FROM w GROUP BY doc_id),
vsum AS (SELECT doc_id, dims.i AS i, sum(u * last / size * vec[dims.i + 1]) AS s FROM w JOIN lex USING (word), dims GROUP BY doc_id, dims.i),
dv AS (SELECT documents.doc_id, dims.i, CASE WHEN big.bw IS NULL THEN 0 WHEN big.bw <> 0 THEN s / big.bw END AS v
       FROM documents CROSS JOIN dims LEFT JOIN big ON big.doc_id = documents.doc_id
       LEFT JOIN vsum ON vsum.doc_id = documents.doc_id AND vsum.i = dims.i)"""
_QUERY = f"""qtok AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS word FROM benchmark),
qf AS (SELECT item_id, word, count(*) AS n FROM qtok WHERE word IN (SELECT word FROM lex) AND word NOT IN (SELECT word FROM stop) GROUP BY item_id, word),
qs AS (SELECT item_id, sum(n) AS size, sum(n * n) AS squares FROM qf GROUP BY item_id),
qdims AS (SELECT unnest(range(0, (SELECT max(len(vec)) FROM lex))) AS i),
qsum AS (SELECT item_id, qdims.i, sum(n / size / size * vec[qdims.i + 1]) / (any_value(squares) / any_value(size)) AS v FROM qf JOIN qs USING (item_id) JOIN lex USING (word), qdims GROUP BY item_id, qdims.i),
qv AS (SELECT b.item_id, qdims.i, coalesce(qsum.v, 0) AS v FROM benchmark b CROSS JOIN qdims LEFT JOIN qsum ON qsum.item_id = b.item_id AND qsum.i = qdims.i)"""
_LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)"
_NODES = "nodes AS (SELECT '127.0.0.1' AS ip, 10000 + i AS port, sha256('{\"ip\":\"127.0.0.1\",\"port\":' || (10000 + i) || '}') AS nid FROM range(5) t(i))"
_RENDEZVOUS = f"""{_NODES}, owner AS (
  SELECT c_name AS key, max_by(nid, sha256('"' || sha256('"' || c_name || '"') || nid || '"')) AS nid FROM customer, nodes GROUP BY c_name)"""
_NAIVE = _NODES.replace("{", "{{").replace("}", "}}") + """, ring AS (SELECT list(nid ORDER BY nid) AS nids FROM nodes),
placed AS (SELECT key, nids[list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(kid, i::INT, 1)) - 1)), lambda a, b: (a * 16 + b) % 5) + 1] AS nid
  FROM (SELECT {0}::VARCHAR AS key, sha256('"' || {0} || '"') AS kid FROM {1}), ring)"""
_EDGES = """pe AS (SELECT DISTINCT 'P' || l_partkey AS p, 'S' || l_suppkey AS s FROM lineitem),
edges AS (SELECT p AS src, s AS dst FROM pe UNION ALL SELECT s, p FROM pe)"""
_PLAIN = r"NOT regexp_matches({}, '[^\w\s]')"


def _crawl(rounds: int = 4, beta: int = 500, per_mille: int = 1) -> str:
    """The rounds written out; a round's frontier is what the last one extracted and nobody visited."""
    out = [f"{_EDGES}, f1 AS (SELECT 'P' || min(l_partkey) AS title FROM lineitem)"]
    for i in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT title FROM v{j}" for j in range(1, i + 1))
        old = f"AND title NOT IN ({' UNION ALL '.join(f'SELECT title FROM v{j}' for j in range(1, i))})" if i > 1 else ""
        out.append(f"p{i} AS MATERIALIZED (SELECT title FROM (SELECT title, row_number() OVER (ORDER BY sha256(title), title) AS r, count(*) OVER () AS n FROM f{i}) WHERE r <= greatest({beta}, n * {per_mille} // 1000))")
        out.append(f"v{i} AS MATERIALIZED (SELECT {i} AS round, title FROM p{i} WHERE {_PLAIN.format('title')} {old})")
        out.append(f"x{i} AS MATERIALIZED (SELECT DISTINCT {i} AS round, dst AS title FROM edges WHERE src IN (SELECT title FROM v{i}) AND {_PLAIN.format('dst')})")
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT title FROM x{i} WHERE title NOT IN ({seen}))")
    fetched = " UNION ALL ".join(f"SELECT round, title FROM v{i}" for i in range(1, rounds + 1))
    extracted = " UNION ALL ".join(f"SELECT round, title FROM x{i}" for i in range(1, rounds + 1))
    return ", ".join(out) + f", fetched AS ({fetched}), extracted AS ({extracted})"


def statements() -> dict[str, str]:
    top = "SELECT row_number() OVER (ORDER BY round(distance, 6) + 0, doc_id) AS rank, doc_id, round(distance, 6) + 0 AS distance"
    near = "SELECT v.vec_id AS doc_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings v, embeddings q WHERE q.vec_id = 0"
    found = {
        "tokenize_words": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_words FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)",
        "mr_wordcount": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
        "mr_max_by_key": "SELECT year(l_shipdate) AS ship_year, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1",
        "mr_group_values": "SELECT o_custkey, r // 1000000 AS segment, list(o_orderkey ORDER BY o_orderkey) AS orderkeys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders) GROUP BY ALL",
        "mr_combiner_sum": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "mr_reduce_side_join": "SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
        "mr_iterative_rounds": """WITH a AS (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey), b AS (SELECT count(*) AS k FROM a GROUP BY k)
            SELECT 3 AS round, k AS n_orders, count(*) AS times FROM b GROUP BY k""",
        "kv_scan_keys": "SELECT DISTINCT event_type AS key FROM events",
        "kv_scan_values": "SELECT user_id, count(*) AS n_values, round(max(value), 6) AS largest FROM events GROUP BY user_id",
        "kv_point_get": "SELECT user_id, list(value ORDER BY event_id) AS values FROM events WHERE user_id = 7 GROUP BY user_id",
        "kv_append_multi": "SELECT user_id, list(event_type ORDER BY ts, event_id) AS values FROM events GROUP BY user_id",
        "kv_last_write": "SELECT user_id, value AS last_value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "kv_content_key": "SELECT item_id, sha256(to_json(text)::VARCHAR) AS key FROM benchmark",
        "kv_delete": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type = 'error') GROUP BY user_id",
        "kv_deleted_values": "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type = 'error') GROUP BY user_id",
        "json_roundtrip": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "group_membership": "SELECT r_name AS gid, list(n_name ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "group_sum_metric": "SELECT n_regionkey AS gid, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
        "node_ids": f"WITH {_NODES} SELECT ip, port, nid, nid[1:5] AS sid FROM nodes",
        "rendezvous_owner": f"WITH {_RENDEZVOUS} SELECT key, nid FROM owner",
        "consistent_hash_owner": f"""WITH {_NODES}, k AS (SELECT c_name AS key, sha256('"' || c_name || '"') AS kid FROM customer)
            SELECT key, coalesce((SELECT min(nid) FROM nodes WHERE nid >= kid), (SELECT min(nid) FROM nodes)) AS nid FROM k""",
        "hash_partition_counts": f"WITH {_NAIVE.format('c_name', 'customer')} SELECT nid, count(*) AS n FROM placed GROUP BY nid",
        "naive_owner": f"WITH {_NAIVE.format('c_name', 'customer')} SELECT key, nid FROM placed",
        "node_numbers": f"WITH {_NODES} SELECT port, round(list_reduce(list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', substr(nid, i::INT, 1)) - 1)::DOUBLE), lambda a, b: a * 16 + b) / pow(2.0::DOUBLE, 256), 9) AS place FROM nodes",
        "group_edit": """WITH g AS (SELECT r_name AS gid, n_name AS sid FROM nation JOIN region ON n_regionkey = r_regionkey),
            asia AS (SELECT sid FROM g WHERE gid = 'ASIA'), own AS (SELECT min(sid) AS sid FROM g WHERE gid = 'EUROPE')
            SELECT gid, sid FROM (SELECT * FROM g UNION SELECT 'EUROPE', sid FROM asia UNION SELECT 'all', sid FROM asia)
            WHERE gid <> 'AFRICA' AND NOT (gid = 'EUROPE' AND sid = (SELECT sid FROM own))""",
        "group_gather": """WITH c AS (SELECT r_name AS gid, n_name AS sid, n_nationkey % 7 = 0 AS bad, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey)
            SELECT gid, coalesce(list(sid ORDER BY sid) FILTER (NOT bad), []) AS oks, coalesce(list(sid ORDER BY sid) FILTER (bad), []) AS errors, coalesce(sum(value) FILTER (NOT bad), 0)::BIGINT AS total FROM c GROUP BY gid""",
        "kv_store_append": "SELECT user_id, list(event_type ORDER BY event_id) AS values FROM events GROUP BY user_id",
        "kv_memory_scan": "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type",
        "json_typed_roundtrip": "SELECT event_id, epoch_us(ts) AS micros, value, true AS known, NULL::VARCHAR AS nothing, user_id, value AS again FROM events",
        "mr_python": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
        "udf_registered": "SELECT p_partkey, length(regexp_replace(p_name, '[^aeiou]', '', 'g')) AS n FROM part",
        "leading_ints": "SELECT c_custkey, -(right(c_name, 9)::INT) AS n FROM customer",
        "page_source_decode": "SELECT doc_id, 'Doc ' || doc_id AS title, length(text) AS n_chars, [coalesce(source, 'none'), 'Main'] AS links FROM documents",
        "url_build": "SELECT p_partkey, 'https://example.org/w/api.php?action=query&titles=' || replace(url_encode(p_name), '%20', '+') || '&format=json' AS url FROM part",
        "section_split": "SELECT doc_id, length(p[1]) AS intro_chars, length(array_to_string(p[2:], ' ')) AS rest_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)",
        "stopword_filter": f"WITH {_KEPT} SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id",
        "vocab_semijoin": f"WITH {_LEX} SELECT doc_id, count(*) AS n FROM kept WHERE word IN (SELECT word FROM lex) GROUP BY doc_id",
        "term_freq": f"WITH {_TOK} SELECT doc_id, word, count(*) AS n FROM tok GROUP BY doc_id, word",
        "doc_length": f"WITH {_TOK} SELECT doc_id, count(*) AS size FROM tok GROUP BY doc_id",
        "doc_freq": f"WITH {_TOK} SELECT word, count(DISTINCT doc_id) AS df FROM tok GROUP BY word",
        "tfidf_weights": f"WITH {_SECTIONS} SELECT * FROM (SELECT doc_id, word, round(u * last, 9) + 0 AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(u * last, 9) + 0 DESC, word) AS rank FROM w) WHERE rank <= 5",
        "tfidf_online": f"""WITH {_KEPT}, f AS (SELECT doc_id, word, count(*) AS n FROM kept GROUP BY doc_id, word),
            s AS (SELECT doc_id, sum(n) AS size FROM f GROUP BY doc_id),
            o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n_docs FROM documents),
            r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS df FROM f)
            SELECT doc_id, word, n_docs, df, round(n / size * ln(n_docs / (1 + df)), 9) + 0 AS weight FROM r JOIN s USING (doc_id) JOIN o USING (doc_id)""",
        "doc_embed_tfidf": f"WITH {_DOCVEC} SELECT doc_id, i, round(v, 9) + 0 AS v FROM dv",
        "lexicon_load": f"WITH {_LEX} SELECT word, len(vec) AS dim, round(vec[1], 6) AS first, round(vec[-1], 6) AS last FROM lex",
        "query_embed": f"WITH {_LEX}, {_QUERY} SELECT item_id, i, round(v, 9) + 0 AS v FROM qv",
        "search_text": f"""WITH {_DOCVEC}, {_QUERY},
            near AS (SELECT item_id AS query_id, doc_id, 1 - list_cosine_similarity(list(dv.v ORDER BY i), list(qv.v ORDER BY i)) AS distance FROM dv JOIN qv USING (i)
              WHERE item_id % 50 = 0 GROUP BY item_id, doc_id HAVING sum(dv.v * dv.v) > 0 AND sum(qv.v * qv.v) > 0)
            SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6) + 0, doc_id) AS rank, doc_id, round(distance, 6) + 0 AS distance FROM near) WHERE rank <= 10""",
        "inverted_index": f"WITH {_TOK} SELECT word, r // 1000000 AS segment, list(doc_id ORDER BY doc_id) AS doc_ids FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) - 1 AS r FROM (SELECT DISTINCT word, doc_id FROM tok)) GROUP BY ALL",
        "grep_regex": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bthe [a-z]+ion\b')",
        "vec_norm": "SELECT vec_id AS doc_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings",
        "vec_counts_by_partition": f"WITH {_NAIVE.format('vec_id::VARCHAR', 'embeddings')} SELECT nid, count(*) AS n FROM placed GROUP BY nid",
        "vec_store_latest": """WITH u AS (SELECT vec_id + 1 AS doc_id, list_reverse(embedding) AS embedding FROM embeddings)
            SELECT doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM u
            UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM u)""",
        "vec_topk_cosine": f"{top} FROM ({near}) ORDER BY rank LIMIT 10",
        "vec_topk_filtered": f"{top} FROM ({near} AND v.label = 1) ORDER BY rank LIMIT 10",
        "vec_topk_batch": """SELECT query_id, rank, doc_id, round(distance, 6) + 0 AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6) + 0, doc_id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS doc_id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
            FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
        "stream_runs": "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "vec_runs_topk": """WITH u AS (SELECT vec_id + 1 AS id, list_reverse(embedding)::DOUBLE[] AS e FROM embeddings),
            c AS MATERIALIZED (SELECT * FROM u UNION ALL SELECT vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id NOT IN (SELECT id FROM u))
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank, doc_id, distance FROM (
            SELECT q.id AS query_id, v.id AS doc_id, round(1 - list_cosine_similarity(v.e, q.e), 6) + 0 AS distance FROM c v, c q WHERE q.id % 50 = 0) QUALIFY rank <= 10""",
        "index_blocks": f"WITH {_TOK} SELECT word, count(DISTINCT doc_id) AS n, min(doc_id) AS first, max(doc_id) AS last FROM tok GROUP BY word",
        "index_lookup": f"WITH {_TOK} SELECT DISTINCT word, doc_id FROM tok WHERE word = 'the'",
        "crawl_rounds": f"WITH {_crawl()} SELECT f.round, f.n AS fetched, x.n AS extracted FROM (SELECT round, count(*) AS n FROM fetched GROUP BY round) f JOIN (SELECT round, count(*) AS n FROM extracted GROUP BY round) x USING (round)",
        "mr_table_function": "SELECT p_partkey, (i - 1)::INT AS at, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))",
        "event_sessions": """SELECT user_id, session, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS ended, count(*) AS n FROM (
            SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session""",
        "mr_reduce_python": "SELECT l_shipdate::DATE::VARCHAR AS shipdate, min(l_extendedprice)::DOUBLE AS cheapest, max(l_extendedprice)::DOUBLE AS dearest, count(*) AS n FROM lineitem GROUP BY 1",
        "json_variant": "SELECT event_id, event_id AS id, event_type AS kind, true AS known, NULL::VARCHAR AS nothing, NULL::BIGINT AS no_number, (props->>'$.k')::BIGINT AS k FROM events",
        "page_source_read": """SELECT 'Doc ' || doc_id AS title, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN length(text) END AS n_chars, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN [coalesce(source, 'none'), 'Main'] END AS links,
            CASE doc_id % 10 WHEN 3 THEN 'unreadable answer' WHEN 7 THEN 'no page' END AS error FROM documents""",
        "page_source_stream": """SELECT 'Doc ' || doc_id AS title, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN length(text) END AS n_chars, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN [coalesce(source, 'none'), 'Main'] END AS links,
            CASE doc_id % 10 WHEN 3 THEN 'unreadable answer' WHEN 7 THEN 'no page' END AS error FROM documents""",
        "kv_runs_latest": "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'",
        "kv_owner_join": "SELECT c_custkey AS custkey, c_name, count(*) AS n, max(o_totalprice) AS largest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
        "kv_owner_get": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7",
        "vec_topk_cells": """WITH c AS MATERIALIZED (SELECT vec_id * 12 + n AS doc_id, list_transform(range(0, len(e)), lambda i: e[i + 1] + 0.02 * n * e[(i * 5 + 3 * n) % len(e) + 1]) AS e
              FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(12) r(n))
            SELECT q.doc_id AS query_id, v.doc_id, round(1 - list_cosine_similarity(v.e, q.e), 6) + 0 AS distance,
              row_number() OVER (PARTITION BY q.doc_id ORDER BY round(1 - list_cosine_similarity(v.e, q.e), 6) + 0, v.doc_id) AS rank
            FROM c v, c q WHERE q.doc_id % 50 = 0 QUALIFY rank <= 10""",
        "vec_upsert_latest": """WITH u AS (SELECT vec_id + 1 AS doc_id, list_reverse(embedding) AS embedding FROM embeddings)
            SELECT doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM u
            UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM u)""",
        "vec_quantised": """SELECT vec_id AS doc_id, round(round(e[1] / s) * s, 5) AS first FROM (
            SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS s FROM embeddings)""",
        "page_extract": "SELECT page_id, regexp_extract(html, '<title>((?s:.*?))</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links FROM pages WHERE html <> ''",
        "url_parts": "SELECT page_id, host, path, string_split(path, '/')[2] AS service FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        "url_extract": f"WITH {_LINKS} SELECT DISTINCT page_id, link FROM links",
        "distinct_links": f"WITH {_LINKS} SELECT DISTINCT link FROM links",
        "link_filter": f"WITH {_LINKS} SELECT DISTINCT page_id, title FROM (SELECT page_id, regexp_replace(link, '^/', '') AS title FROM links) WHERE {_PLAIN.format('title')}",
        "title_filter": f"SELECT page_id, title FROM (SELECT page_id, regexp_extract(html, '<title>((?s:.*?))</title>', 1) AS title FROM pages WHERE html <> '') WHERE {_PLAIN.format('title')}",
        "crawl_reduce_links": f"WITH {_LINKS} SELECT page_id, list(link ORDER BY link) AS links FROM links GROUP BY page_id",
        "reverse_links": f"WITH {_LINKS} SELECT link, r // 1000000 AS segment, list(page_id ORDER BY page_id) AS page_ids FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id) - 1 AS r FROM (SELECT DISTINCT page_id, link FROM links)) GROUP BY ALL",
        "link_two_hop": "SELECT a.l_suppkey, count(DISTINCT b.l_suppkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_suppkey",
        "frontier_antijoin": f"WITH {_EDGES} SELECT DISTINCT dst AS title FROM edges WHERE dst LIKE 'P%' AND dst NOT IN (SELECT dst FROM edges WHERE src = 'S1')",
        "frontier_prune": "SELECT title FROM (SELECT 'P' || p_partkey AS title, row_number() OVER (ORDER BY sha256('P' || p_partkey), p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r <= greatest(20, n * 5 // 100)",
        "crawl_bfs": f"WITH {_crawl()} SELECT round, title FROM fetched",
        "crawl_stats": f"WITH {_crawl()} SELECT (SELECT count(*) FROM fetched) AS n_fetched, (SELECT count(DISTINCT title) FROM extracted) AS n_pages, (SELECT max(round) FROM fetched) AS rounds",
        "crawl_stats_saved": f"WITH {_crawl()} SELECT (SELECT count(*) FROM fetched) AS n_fetched, (SELECT count(DISTINCT title) FROM extracted) AS n_pages, (SELECT max(round) FROM fetched) AS rounds",
        "set_union_distinct": "SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders",
        "set_except": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
        "stream_upsert": "SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
        "stream_dedupe": "SELECT DISTINCT user_id FROM events",
        "stream_doc_freq": f"WITH {_TOK} SELECT word, count(DISTINCT doc_id) AS df FROM tok GROUP BY word",
    }
    found["stream_tfidf_online"] = found["tfidf_online"]
    return found

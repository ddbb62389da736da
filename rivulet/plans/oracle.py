"""The registry's queries as SQL for DuckDB, for a check by another engine."""

from __future__ import annotations

from ..functions import text

_HOURS = "(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * ({}))"
_NOW = "TIMESTAMP '2024-01-15 00:00:00'"
_SQL_ACCENTED, _SQL_PLAIN = text.ACCENTED, text.PLAIN

_ARTICLES = """articles AS (
  SELECT o_orderkey AS id, o_custkey AS source_id, 'Order ' || o_orderkey AS title, o_orderpriority AS summary, 'https://shop.example/orders/' || o_orderkey AS canonical_url,
         CAST(NULL AS VARCHAR) AS image_url, o_orderdate AS published_at, CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'F' THEN 'failed' ELSE 'duplicate' END AS status
  FROM orders)"""
_CUSTOMERS = "sources AS (SELECT c_custkey AS id, 'customer-' || c_custkey AS slug, c_name AS name FROM customer)"
_FEED = """SELECT a.id, a.title, a.summary, a.canonical_url, a.image_url, a.published_at, s.slug AS source_slug, s.name AS source_name
  FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.status = 'published'"""

_TRACKING = "('fbclid','gclid','dclid','msclkid','yclid','mc_cid','mc_eid','igshid','ref_src','ref_url','_hsenc','_hsmi','spm')"
_CANONICAL = rf"""raw AS (SELECT page_id, url, trim(url) AS u FROM pages), parts AS (
  SELECT page_id, url, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         lower(regexp_extract(u, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(u, '^[^:/?#]+://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1) AS port,
         regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q
  FROM raw
), kept AS (
  SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) LIKE 'utm\_%' ESCAPE '\' OR lower(split_part(p, '=', 1)) IN {_TRACKING})) AS ps FROM parts
), sorted AS (
  SELECT *, array_to_string(list_transform(list_sort(list_transform(ps, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda s: s.p), '&') AS qs FROM kept
), canonical AS (
  SELECT page_id, url, host, CASE WHEN scheme = '' OR host = '' THEN u ELSE scheme || '://' || host
         || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
         || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN coalesce(qs, '') = '' THEN '' ELSE '?' || qs END END AS canonical_url
  FROM sorted)"""

_NORM = r"trim(regexp_replace(translate(coalesce(text, ''), chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), ''), '[\s\x0b\x{a0}]+', ' ', 'g'))"
_BODIES = f"""bodies AS (SELECT doc_id AS id, {_HOURS.format("doc_id % 72")} AS published_at, {_NORM} AS norm FROM documents), hashed AS (
  SELECT *, CASE WHEN length(norm) >= 500 THEN sha256(norm) END AS content_hash FROM bodies)"""

_JOBS = """jobs AS (
  SELECT event_id AS id, user_id AS source_id, CASE WHEN event_id % 3 = 0 THEN 'fetch_article' ELSE 'fetch_feed' END AS job_type,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'dead' END AS state,
         (event_id % 6)::INTEGER AS attempt, 5 AS max_attempts, ts AS scheduled_at, CASE WHEN event_type = 'click' THEN ts END AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at,
         CASE WHEN event_type = 'click' THEN 'w0' END AS locked_by, CASE WHEN event_type = 'click' THEN ts + INTERVAL 300 SECOND END AS locked_until, CAST(NULL AS VARCHAR) AS last_error
  FROM events)"""
_SOURCES = f"""crawl AS (
  SELECT c_custkey AS id, c_name AS slug, CASE WHEN c_custkey % 11 <> 0 THEN 'https://feeds.example/' || c_custkey END AS feed_url, c_custkey % 7 <> 0 AS enabled, {_HOURS.format("c_custkey % 500")} AS next_crawl_at,
         (c_custkey % 4)::INTEGER AS consecutive_failures, (300 + c_custkey % 3 * 300)::INTEGER AS crawl_interval_sec, CASE WHEN c_custkey % 2 = 0 THEN 'W/"' || c_custkey || '"' END AS http_etag
  FROM customer)"""
_CLAIMED = f"""claimed AS (
  SELECT * FROM jobs WHERE state = 'pending' AND job_type = 'fetch_feed' AND scheduled_at <= {_NOW} AND attempt < max_attempts ORDER BY scheduled_at, id LIMIT {{}})"""
_WAITING = """content AS (SELECT DISTINCT l_orderkey AS article_id FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 25), waiting AS (
  SELECT a.id, a.source_id, a.published_at FROM articles a WHERE a.status <> 'duplicate' AND a.id % 5 < 3 AND NOT EXISTS (SELECT 1 FROM content c WHERE c.article_id = a.id))"""

_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_PLAIN = "translate({}, '" + _SQL_ACCENTED + "', '" + _SQL_PLAIN + "')"


def _tsv() -> str:
    parts = []
    for column, weight in (("title", "A"), ("summary", "B"), ("body", "C")):
        for form in (column, _PLAIN.format(column)):
            parts.append((_TOKENS.format(form), weight))
    lists = ", ".join(f"{words} AS w{i}" for i, (words, _) in enumerate(parts))
    union = " UNION ALL ".join(
        f"SELECT id, unnest(w{i}) AS lexeme, generate_subscripts(w{i}, 1) + {' + '.join(['0', *[f'len(w{j})' for j in range(i)]])} AS pos, '{weight}' AS weight FROM lists" for i, (_, weight) in enumerate(parts)
    )
    return f"""docs AS (SELECT doc_id AS id, left(text, 80) AS title, substr(text, 81, 200) AS summary, left(text, 200000) AS body FROM documents), lists AS (SELECT id, {lists} FROM docs), postings AS ({union})"""


_TRIGRAMS = r"""list_distinct(flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: '  ' || w || ' '), lambda p: list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))))"""
_VECTORS = f"""vecs AS (SELECT vec_id AS id, label, {_HOURS.format("vec_id % 240")} AS published_at, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
_HEALTH = """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, count(*)::BIGINT AS n, (count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS n_errors, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1"""
_AGO = "epoch_us(TIMESTAMP '2024-01-31 00:00:00' - ts) / 1e6"
_EXACT = "SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY published_at, id) AS winner FROM hashed WHERE content_hash IS NOT NULL"

# fingerprints in SQL: FNV-1a and the mix in 128-bit integers modulo 2^64, one hash for each window of three tokens
_SEP = "[ \\n\\t,.;:!?\"''()\\[\\]{}<>/\\\\|—–\\-…“”‘’]+"
_TWO64 = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {_TWO64})::UBIGINT"


_SIMHASH = f"""toks AS (SELECT id, list_filter(regexp_split_to_array(lower(norm), '{_SEP}'), lambda w: w <> '') AS w FROM hashed WHERE length(norm) >= 500),
  win AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ')) AS s FROM toks WHERE len(w) >= 10),
  one AS (SELECT s, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(s, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: {_mul("xor(h, c)", 0x100000001B3)}) AS h FROM (SELECT DISTINCT s FROM win)),
  m1 AS (SELECT s, {_mul("xor(h, h >> 30::UBIGINT)", 0xBF58476D1CE4E5B9)} AS h FROM one), m2 AS (SELECT s, {_mul("xor(h, h >> 27::UBIGINT)", 0x94D049BB133111EB)} AS h FROM m1), m3 AS (SELECT s, xor(h, h >> 31::UBIGINT) AS h FROM m2),
  votes AS (SELECT id, b, sum(CASE WHEN (h >> b::UBIGINT) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS v FROM win JOIN m3 USING (s), range(64) t(b) GROUP BY id, b),
  many AS (SELECT id FROM win GROUP BY id HAVING count(DISTINCT s) >= 8),
  fps AS (SELECT id, sum(CASE WHEN v > 0 THEN power(2, b)::HUGEINT ELSE 0::HUGEINT END)::UBIGINT AS u FROM votes SEMI JOIN many USING (id) GROUP BY id),
  signed AS (SELECT id, (u::HUGEINT - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS simhash FROM fps),
  prints AS (SELECT h.id, h.published_at, h.content_hash, s.simhash FROM hashed h LEFT JOIN signed s USING (id))"""
_NEAR = """SELECT l.id AS loser, w.id AS winner, bit_count(xor(l.simhash, w.simhash))::INTEGER AS distance, w.published_at AS winner_at FROM {0} l JOIN {0} w ON (w.published_at, w.id) < (l.published_at, l.id)
  AND w.published_at > l.published_at - INTERVAL 48 HOUR AND bit_count(xor(l.simhash, w.simhash)) <= 3"""

ORACLE_SQL: dict[str, str] = {
    "feed_first_page": f"WITH {_ARTICLES}, {_CUSTOMERS} {_FEED} ORDER BY a.published_at DESC, a.id DESC LIMIT 30",
    "feed_keyset_page": f"WITH {_ARTICLES}, {_CUSTOMERS} {_FEED} AND (a.published_at, a.id) < (TIMESTAMP '1998-01-01 00:00:00', 600) ORDER BY a.published_at DESC, a.id DESC LIMIT 50",
    "feed_per_source_topk": f"WITH {_ARTICLES}, r AS (SELECT id, source_id, published_at, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC)::INTEGER AS rank FROM articles) SELECT * FROM r WHERE rank <= 3",
    "feed_offset_page": f"WITH {_ARTICLES} SELECT id, published_at FROM articles WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 300",
    "feed_cursor_tokens": "SELECT o_orderkey AS id, rtrim(translate(to_base64(encode(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '|' || o_orderkey)), '+/', '-_'), '=') AS cursor FROM orders",
    "page_root_then_tags": f"""WITH {_ARTICLES}, page AS (SELECT id, published_at FROM articles WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 20)
        SELECT page.id, page.published_at, l_partkey AS tag_id, p_name AS label FROM page LEFT JOIN lineitem ON l_orderkey = page.id LEFT JOIN part ON p_partkey = l_partkey""",
    "feed_time_ago": f"""WITH s AS (SELECT event_id, floor({_AGO} / 60 + 0.5)::BIGINT AS m FROM events), h AS (SELECT *, floor(m / 60.0 + 0.5)::BIGINT AS h FROM s)
        SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE floor(h / 24.0 + 0.5)::BIGINT || 'd ago' END AS ago FROM h""",
    "url_canonicalize": f"WITH {_CANONICAL} SELECT page_id, canonical_url FROM canonical",
    "url_hash": f"WITH {_CANONICAL} SELECT page_id, sha256(canonical_url) AS url_hash FROM canonical",
    "url_host_stats": f"WITH {_CANONICAL} SELECT host, count(*)::BIGINT AS pages, count(DISTINCT canonical_url)::BIGINT AS addresses FROM canonical GROUP BY host",
    "url_collision_winners": f"""WITH {_CANONICAL}, p AS (SELECT page_id AS id, canonical_url AS new_url, {_HOURS.format("page_id % 72")} AS published_at FROM canonical),
        w AS (SELECT id, new_url, first_value(id) OVER (PARTITION BY new_url ORDER BY published_at, id) AS winner, count(*) OVER (PARTITION BY new_url)::BIGINT AS group_size FROM p)
        SELECT id, new_url, winner, id <> winner AS loses, group_size FROM w""",
    "body_normalize_hash": f"WITH {_BODIES} SELECT id, length(norm)::INTEGER AS chars, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END::INTEGER AS words, content_hash FROM hashed",
    "dedup_exact": f"WITH {_BODIES}, w AS ({_EXACT}) SELECT id, winner FROM w WHERE id <> winner",
    "dedup_exact_counts": f"WITH {_BODIES}, g AS (SELECT content_hash, count(*) AS n FROM hashed WHERE content_hash IS NOT NULL GROUP BY 1) SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS hashed, sum(n - 1)::BIGINT AS losers, max(n)::BIGINT AS largest FROM g",
    "dedup_exact_windows": f"WITH {_BODIES} SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY published_at, id) AS first_id, count(*) OVER (PARTITION BY content_hash)::BIGINT AS group_size FROM hashed WHERE content_hash IS NOT NULL",
    "simhash_fingerprint": f"WITH {_BODIES}, {_SIMHASH} SELECT id, simhash FROM prints",
    "dedup_near_pairs": f"WITH {_BODIES}, {_SIMHASH}, n AS ({_NEAR.format('prints')}) SELECT loser, winner, distance FROM n",
    "hamming_histogram": f"WITH {_BODIES}, {_SIMHASH} SELECT bit_count(xor(a.simhash, b.simhash))::INTEGER AS distance, count(*)::BIGINT AS pairs FROM prints a JOIN prints b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 20 GROUP BY 1",
    "dedup_sweep": f"""WITH {_BODIES}, {_SIMHASH}, x AS (SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY published_at, id) AS winner FROM prints WHERE content_hash IS NOT NULL),
        exact AS (SELECT id, winner FROM x WHERE id <> winner), rest AS (SELECT * FROM prints WHERE id NOT IN (SELECT id FROM exact)), n AS ({_NEAR.format('rest')}),
        d AS (SELECT id, winner FROM exact UNION ALL SELECT loser, arg_min(winner, (winner_at, winner)) FROM n GROUP BY loser)
        SELECT p.id, CASE WHEN d.id IS NULL THEN 'published' ELSE 'duplicate' END AS status, CASE WHEN u.winner IS NOT NULL AND u.winner <> p.id THEN u.winner ELSE d.winner END AS duplicate_of_id
        FROM prints p LEFT JOIN d ON d.id = p.id LEFT JOIN d u ON u.id = d.winner""",
    "dedup_flatten": """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'duplicate' ELSE 'published' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 2 END AS d FROM orders)
        SELECT a.id, a.status, CASE WHEN a.status = 'duplicate' AND u.d IS NOT NULL AND u.d <> a.id THEN u.d ELSE a.d END AS duplicate_of_id FROM a LEFT JOIN a u ON u.id = a.d AND u.status = 'duplicate'""",
    "jobs_by_state": f"WITH {_JOBS} SELECT state, count(*)::BIGINT AS n FROM jobs GROUP BY state",
    "enqueue_due": f"""WITH {_JOBS}, {_SOURCES} SELECT id AS source_id, 'fetch_feed' AS job_type, 'pending' AS state, {_NOW} AS scheduled_at FROM crawl
        WHERE enabled AND feed_url IS NOT NULL AND next_crawl_at <= {_NOW} AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_id = crawl.id AND j.job_type = 'fetch_feed' AND j.state IN ('pending', 'running'))""",
    "enqueue_extraction": f"""WITH {_JOBS}, {_SOURCES}, {_ARTICLES}, {_WAITING} SELECT id AS source_id, 'fetch_article' AS job_type, 'pending' AS state, {_NOW} AS scheduled_at FROM crawl
        WHERE enabled AND EXISTS (SELECT 1 FROM waiting w WHERE w.source_id = crawl.id) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_id = crawl.id AND j.job_type = 'fetch_article' AND j.state IN ('pending', 'running'))""",
    "claim_batch": f"WITH {_JOBS}, {_CLAIMED.format(10)} SELECT id, source_id, 'running' AS state, (attempt + 1)::INTEGER AS attempt, {_NOW} AS started_at, {_NOW} + INTERVAL 300 SECOND AS locked_until FROM claimed",
    "claimed_jobs": f"WITH {_JOBS}, {_SOURCES}, {_CLAIMED.format(40)} SELECT c.id, c.source_id, s.slug, s.feed_url, s.http_etag FROM claimed c LEFT JOIN crawl s ON s.id = c.source_id",
    "retry_or_dead": f"""WITH {_JOBS} SELECT id, CASE WHEN state <> 'running' THEN state WHEN attempt >= max_attempts THEN 'dead' ELSE 'pending' END AS state,
        CASE WHEN state = 'running' AND attempt < max_attempts THEN {_NOW} + INTERVAL 1 SECOND * least(60 * power(2, greatest(attempt - 1, 0)), 3600)::BIGINT ELSE scheduled_at END AS scheduled_at,
        CASE WHEN state = 'running' AND attempt >= max_attempts THEN {_NOW} END AS finished_at, CASE WHEN state = 'running' THEN 2000 END::INTEGER AS error_chars FROM jobs""",
    "mark_succeeded": f"""WITH {_JOBS}, d AS (SELECT *, state = 'running' AND attempt < 3 AS hit FROM jobs)
        SELECT id, CASE WHEN hit THEN 'succeeded' ELSE state END AS state, CASE WHEN hit THEN {_NOW} END AS finished_at, CASE WHEN NOT hit THEN locked_by END AS locked_by FROM d""",
    "reap_leases": f"""WITH {_JOBS}, d AS (SELECT *, coalesce(state = 'running' AND locked_until < TIMESTAMP '2024-01-10 00:00:00', FALSE) AS hit FROM jobs)
        SELECT id, CASE WHEN NOT hit THEN state WHEN attempt >= max_attempts THEN 'dead' ELSE 'pending' END AS state, CASE WHEN hit AND attempt >= max_attempts THEN TIMESTAMP '2024-01-10 00:00:00' END AS finished_at,
        CASE WHEN NOT hit THEN locked_by END AS locked_by, CASE WHEN NOT hit THEN locked_until END AS locked_until, CASE WHEN hit THEN 'lease expired' END AS last_error FROM d""",
    "backoff_schedule": "SELECT event_id, greatest(least(60 * power(2, greatest(event_id % 12 - 1, 0)), 3600)::BIGINT, 1)::BIGINT AS job_seconds, least(60 * power(2, least(greatest(event_id % 15 - 1, 0), 10)), 3600)::BIGINT AS source_seconds FROM events",
    "source_outcomes": f"""WITH {_SOURCES} SELECT id, CASE id % 4 WHEN 0 THEN {_NOW} + INTERVAL 1 SECOND * crawl_interval_sec WHEN 1 THEN {_NOW} + INTERVAL 1 SECOND * least(60 * power(2, least(consecutive_failures, 10)), 3600)::BIGINT
        WHEN 2 THEN {_NOW} + INTERVAL 1800 SECOND ELSE next_crawl_at END AS next_crawl_at, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN consecutive_failures + 1 ELSE consecutive_failures END::INTEGER AS consecutive_failures,
        CASE WHEN id % 4 < 2 THEN {_NOW} END AS last_crawled_at FROM crawl""",
    "crawl_log": f"SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::INTEGER AS http_status, CAST(NULL AS BIGINT) AS bytes, round(value)::INTEGER AS duration_ms, CASE WHEN event_type = 'error' THEN 2000 END::INTEGER AS error_chars, {_NOW} AS created_at FROM events",
    "pending_extraction": f"WITH {_ARTICLES}, {_WAITING}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC) AS k FROM waiting) SELECT id, source_id, published_at FROM r WHERE k <= 20",
    "extract_attempts": "SELECT o_orderkey AS id, (o_orderkey % 5 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS extract_attempts FROM orders",
    "host_rate_schedule": """WITH e AS (SELECT event_id AS id, user_id AS host, (epoch_us(ts) // 50000000)::BIGINT AS arrival, 3 + event_id % 3 AS gap FROM events),
        s AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY host ORDER BY arrival, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM e)
        SELECT id, host, arrival, (max(arrival - s) OVER (PARTITION BY host ORDER BY arrival, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + s)::BIGINT AS start FROM s""",
    "robots_decision": r"""WITH p AS (SELECT page_id, page_id % 6 AS h, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN strpos(u, '?') > 0 THEN '?' || q ELSE '' END AS path FROM
          (SELECT page_id, url AS u, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages))
        SELECT page_id, CASE h WHEN 0 THEN NOT (path LIKE '/en/%' AND NOT path LIKE '/en/4%') WHEN 1 THEN NOT regexp_matches(path, '\.html$') WHEN 2 THEN TRUE WHEN 4 THEN TRUE ELSE FALSE END AS allowed,
          CASE h WHEN 0 THEN 5.0 ELSE 3.0 END::DOUBLE AS gap_seconds FROM p""",
    "robots_expiry": "SELECT 'https://h' || i || '.example' AS origin, CASE WHEN i = 3 THEN 60 ELSE 84630 END::BIGINT AS seconds FROM range(5) t(i)",
    "upsert_idempotent": f"""WITH e AS (SELECT *, 'https://c.example/' || c_custkey AS u FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT *, 'https://c.example/' || c_custkey AS u, CASE WHEN c_custkey % 12 = 0 THEN 'old' ELSE 'new' END AS s FROM customer WHERE c_custkey % 3 = 0)
        SELECT CASE WHEN e.u IS NULL THEN 9999999 + row_number() OVER (PARTITION BY e.u IS NULL ORDER BY sha256(b.u)) ELSE e.c_custkey END::BIGINT AS id, coalesce(e.u, b.u) AS canonical_url, coalesce(b.c_name, e.c_name) AS title, coalesce(b.s, 'old') AS summary, CASE WHEN e.u IS NULL THEN 7 ELSE e.c_nationkey END::BIGINT AS source_id,
          CASE WHEN e.u IS NULL THEN {_NOW} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS published_at, CASE WHEN e.u IS NOT NULL AND b.s = 'new' THEN 1 ELSE 0 END::INTEGER AS version,
          CASE WHEN e.c_custkey % 4 = 0 THEN sha256(e.u) END AS content_hash, CASE WHEN e.u IS NULL THEN 'insert' WHEN b.s = 'new' THEN 'update' ELSE 'none' END AS change, 'none' AS second_change
        FROM e FULL JOIN b ON e.u = b.u""",
    "feed_ingest": f"""WITH {_CANONICAL}, x AS (SELECT c.page_id, r.n, c.page_id % 4 AS source_id, c.page_id * 2 + r.n AS idx, c.canonical_url, CASE WHEN r.n = 0 THEN c.url ELSE 'T' || c.page_id END AS title, {_HOURS.format("c.page_id % 72")} AS published_at FROM canonical c, range(2) r(n)),
        y AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY idx) AS k FROM x), z AS (SELECT * FROM y WHERE source_id <> 1 OR k <= 20)
        SELECT canonical_url, arg_min(source_id, (source_id, idx)) AS source_id, arg_min(published_at, (source_id, idx)) AS published_at, arg_max(title, (source_id, idx)) AS title, CAST(NULL AS VARCHAR) AS summary FROM z GROUP BY canonical_url""",
    "content_upsert": """WITH c AS (SELECT page_id FROM pages WHERE page_id % 3 = 0), b AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'same' ELSE 'other' END AS t FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0)
        SELECT coalesce(c.page_id, b.page_id) AS article_id, coalesce(b.t, 'same') AS text_plain, CASE WHEN b.t IS NOT NULL AND (c.page_id IS NULL OR b.t <> 'same') THEN 'n' ELSE 'h' END AS html,
          CASE WHEN b.t IS NOT NULL AND (c.page_id IS NULL OR b.t <> 'same') THEN 'reader' ELSE 'feed' END AS extractor, CASE WHEN b.t IS NULL OR (c.page_id IS NOT NULL AND b.t = 'same') THEN 'none' WHEN c.page_id IS NULL THEN 'insert' ELSE 'update' END AS change
        FROM c FULL JOIN b ON c.page_id = b.page_id""",
    "validators": f"WITH {_SOURCES} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' || id ELSE http_etag END AS http_etag, CASE WHEN id % 5 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS http_last_modified FROM crawl",
    "seed_absent": "SELECT c_name AS slug, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'seed' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "config_decode": """SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 'bot' END AS user_agent, CASE WHEN event_id % 6 = 5 THEN 5 END::INTEGER AS timeout_sec, CASE WHEN event_id % 6 = 1 THEN 7 END::INTEGER AS max_items, CASE WHEN event_id % 6 = 1 THEN TRUE END AS full_content FROM events""",
    "feed_parse": "SELECT 1::BIGINT AS id, i::INTEGER AS entry_idx, 'https://f.example/' || i AS link, 'T ' || i AS title, '<b>d</b> ' || i AS description, TIMESTAMP '2026-07-14 09:00:00' AS published FROM range(3) t(i)",
    "quality_checks": f"""WITH {_JOBS}, o AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k, CASE WHEN k % 89 = 0 THEN k WHEN k % 83 = 0 THEN k - 1 END AS d, CASE WHEN k % 79 = 0 THEN 'duplicate' WHEN k % 101 = 0 THEN 'odd' ELSE 'published' END AS st FROM o)
        SELECT 'word count not negative' AS rule, count(*)::BIGINT AS n FROM o WHERE k % 97 = 0 UNION ALL SELECT 'not its own duplicate', count(*) FROM s WHERE d IS NOT DISTINCT FROM k UNION ALL
        SELECT 'a duplicate has a target', count(*) FROM s WHERE st = 'duplicate' AND d IS NULL UNION ALL SELECT 'attempts not negative', count(*) FROM o WHERE k % 73 = 0 UNION ALL SELECT 'status known', count(*) FROM s WHERE st = 'odd' UNION ALL
        SELECT 'attempts within bounds', count(*) FROM jobs WHERE attempt NOT BETWEEN 0 AND max_attempts UNION ALL SELECT 'state known', 0""",
    "quality_keys": f"""WITH {_JOBS} SELECT 'orders unique' AS rule, count(*)::BIGINT AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL
        SELECT 'orders per customer and day', count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
        SELECT 'orders without customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL
        SELECT 'lines without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 50 <> 0) UNION ALL
        SELECT 'live jobs over one', count(*) FROM (SELECT source_id, job_type FROM jobs WHERE state IN ('pending', 'running') GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
        SELECT 'discount out of unit', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1""",
    "crawl_health_windows": _HEALTH,
    "fts_postings": f"WITH {_tsv()} SELECT id, lexeme, count(*)::BIGINT AS n, min(pos)::INTEGER AS first_pos, min(weight) AS best_weight FROM postings GROUP BY id, lexeme",
    "fts_search": f"""WITH {_tsv()}, w AS (SELECT id, lexeme, pos, CASE weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 ELSE 0.2 END AS x FROM postings WHERE lexeme IN ('the', 'of', 'idiot', 'été')),
        d AS (SELECT id, bool_or(lexeme = 'the') AS the, bool_or(lexeme = 'idiot') AS idiot, bool_or(lexeme = 'été') AS ete, sum(CASE WHEN lexeme <> 'idiot' THEN x ELSE 0 END) AS r FROM w GROUP BY id),
        ph AS (SELECT DISTINCT a.id FROM w a JOIN w b ON a.id = b.id AND a.lexeme = 'of' AND b.lexeme = 'the' AND b.pos = a.pos + 1)
        SELECT d.id, round((r / (r + 1))::DOUBLE, 6) AS rank FROM d LEFT JOIN ph ON ph.id = d.id WHERE (the AND ph.id IS NOT NULL AND NOT idiot) OR ete ORDER BY rank DESC, d.id LIMIT 30""",
    "title_trigram_pairs": f"""WITH t AS (SELECT doc_id AS id, {_TRIGRAMS.format(_PLAIN.format("left(text, 80)"))} AS g FROM documents), n AS (SELECT id, len(g) AS n FROM t), e AS (SELECT id, unnest(g) AS g FROM t),
        p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2), s AS (SELECT a, b, c / (na.n + nb.n - c)::DOUBLE AS s FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b)
        SELECT a, b, round(s, 6) AS similarity FROM s WHERE s >= 0.6 AND abs(a % 72 - b % 72) < 48""",
    "similar_titles": f"""WITH q AS (SELECT {_TRIGRAMS.format("'Was the thing in the ere of it'")} AS q), t AS (SELECT doc_id AS id, {_TRIGRAMS.format(_PLAIN.format("left(text, 80)"))} AS g FROM documents WHERE {_HOURS.format("doc_id % 72")} > TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 48 HOUR),
        s AS (SELECT id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE AS s FROM t, q) SELECT id, round(s, 6) AS similarity FROM s WHERE s >= 0.05 ORDER BY s DESC, id LIMIT 5""",
    "unaccent_tokens": f"WITH t AS (SELECT unnest({_TOKENS.format(_PLAIN.format('text'))}) AS token FROM documents) SELECT token, count(*)::BIGINT AS n FROM t GROUP BY token",
    "related_topk": f"WITH {_VECTORS} SELECT a.id, round(list_cosine_similarity(a.v, q.v), 6) AS similarity FROM vecs a, vecs q WHERE q.id = 7 AND a.id <> 7 ORDER BY list_cosine_similarity(a.v, q.v) DESC, a.id LIMIT 8",
    "related_filtered_topk": f"WITH {_VECTORS} SELECT a.id, round(list_cosine_similarity(a.v, q.v), 6) AS similarity FROM vecs a, vecs q WHERE q.id = 7 AND a.id <> 7 AND a.label = 3 ORDER BY list_cosine_similarity(a.v, q.v) DESC, a.id LIMIT 8",
    "semantic_dups": f"""WITH {_VECTORS}, s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM vecs a JOIN vecs b ON a.id <> b.id AND b.published_at BETWEEN a.published_at - INTERVAL 3 DAY AND a.published_at + INTERVAL 3 DAY),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other)::INTEGER AS rank FROM s WHERE s >= 0.4) SELECT id, other, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""",
    "semantic_winners": f"""WITH {_VECTORS}, s AS (SELECT a.id, b.id AS other, b.published_at AS p FROM vecs a JOIN vecs b ON a.id <> b.id AND b.published_at BETWEEN a.published_at - INTERVAL 3 DAY AND a.published_at + INTERVAL 3 DAY AND (b.published_at, b.id) < (a.published_at, a.id) AND list_cosine_similarity(a.v, b.v) >= 0.92)
        SELECT id, arg_min(other, (p, other)) AS winner FROM s GROUP BY id""",
    "synthetic_articles": """WITH a AS (SELECT i % 50 + 1 AS source_id, CASE WHEN i % 100 < 92 THEN 'published' WHEN i % 100 < 96 THEN 'failed' ELSE 'duplicate' END AS status, TIMESTAMP '2026-01-01 00:00:00' - INTERVAL 1 MINUTE * ((i * 7919) % 1051200) AS published_at, 'https://bench.example/' || md5(i::VARCHAR) AS canonical_url, 200 + i % 1800 AS word_count FROM range(1, 500001) t(i))
        SELECT source_id, status, count(*)::BIGINT AS n, min(published_at) AS first_at, max(canonical_url) AS last_url, sum(word_count)::BIGINT AS words FROM a GROUP BY source_id, status""",
    "stream_enqueue": f"SELECT DISTINCT user_id AS source_id, 'fetch_feed' AS job_type, 'pending' AS state, {_NOW} AS scheduled_at FROM events",
    "stream_health": f"WITH h AS ({_HEALTH}) SELECT * FROM h WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
}

# the streamed sweep runs the same layers as the one over the whole table
ORACLE_SQL["stream_dedup"] = ORACLE_SQL["dedup_sweep"]

# pages: their grammar has comments, raw script and style, inline a, b and meta, four entities and cut-off ends
_FOLD = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '</?(a|b|meta)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), chr(8203), ''), '[\s\x0b\x{{a0}}]+', ' ', 'g'))"""
_PAGES = rf"""cut AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '<[^>]*$', '') AS h FROM pages),
  texts AS (SELECT page_id, h, {_FOLD.format("h")} AS t FROM cut),
  found AS (SELECT page_id, regexp_extract(h, '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM cut),
  blocks AS (SELECT page_id, {_FOLD.format("a")} AS body, list_bool_or(list_transform(string_split(a, '<p>')[2:], lambda x: length({_FOLD.format("split_part(x, '</p>', 1)")}) >= 25)) AS prose FROM found)"""

_LOGGED = "(SELECT user_id % 20 AS source_id, value AS ms, event_type = 'error' AS bad FROM events)"
_UPSERT_SIDES = """e AS (SELECT c_custkey AS k, c_nationkey AS nation, TRUE AS old FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)"""
ORACLE_SQL |= {
    "html_text": f"WITH {_PAGES} SELECT page_id, length(t)::INTEGER AS chars, sha256(t) AS text_sha256 FROM texts",
    "html_summary": rf"WITH {_PAGES} SELECT page_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 280 THEN regexp_replace(left(t, 279), '\s+$', '') || '…' ELSE t END AS summary FROM texts",
    "link_density": f"""WITH {_PAGES}, l AS (SELECT page_id, length(t) AS n, list_sum(list_transform(regexp_extract_all(h, '(?s)<a [^>]*>(.*?)(?:</a>|$)', 1), lambda x: length({_FOLD.format("x")}))) AS a FROM texts)
        SELECT page_id, CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, coalesce(a, 0) / n), 6) END::DOUBLE AS link_density FROM l""",
    "html_extract": f"""WITH {_PAGES} SELECT page_id, CASE WHEN length(body) >= 200 THEN CASE WHEN coalesce(prose, FALSE) THEN 'readability' ELSE 'semantic-fallback' END END AS method, CASE WHEN length(body) >= 200 THEN length(body) END::INTEGER AS chars,
        CASE WHEN length(body) >= 200 THEN sha256(body) END AS text_sha256, CASE WHEN length(body) >= 200 THEN 0.0 END::DOUBLE AS link_density FROM blocks""",
    "extraction_store": f"WITH {_PAGES} SELECT page_id AS id, CASE WHEN length(body) >= 500 THEN sha256(body) END AS content_hash, CASE WHEN length(body) >= 500 THEN length(body) - length(replace(body, ' ', '')) + 1 END::INTEGER AS word_count FROM blocks",
    "source_hosts": f"WITH {_CANONICAL} SELECT page_id % 4 AS source_id, count(*)::BIGINT AS urls, count(DISTINCT host)::BIGINT AS hosts FROM canonical GROUP BY 1",
    "crawl_health_sources": f"""SELECT source_id, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE NOT bad) / count(*), 6) AS success_rate, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, round(max(ms), 6) AS max_ms FROM {_LOGGED} GROUP BY 1""",
    "queue_depth": f"""WITH {_JOBS} SELECT job_type, (count(*) FILTER (WHERE state = 'pending'))::BIGINT AS pending, (count(*) FILTER (WHERE state = 'pending' AND scheduled_at <= {_NOW}))::BIGINT AS due, (count(*) FILTER (WHERE state = 'running'))::BIGINT AS running,
        (count(*) FILTER (WHERE state = 'running' AND locked_until < {_NOW}))::BIGINT AS expired, min(scheduled_at) FILTER (WHERE state = 'pending' AND scheduled_at <= {_NOW}) AS oldest_due FROM jobs GROUP BY job_type""",
    "crawl_health_sliding": """WITH w AS (SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01 00:00:00') - INTERVAL 3 HOUR * i AS window_start, event_type, value FROM events, range(2) r(i))
        SELECT window_start, count(*)::BIGINT AS n, (count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS n_errors, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM w GROUP BY 1""",
    "session_activity": """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
        SELECT user_id, min(ts) AS started_at, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""",
    "status_rollup": f"WITH {_ARTICLES} SELECT status, summary AS priority, count(*)::BIGINT AS n, grouping_id(status, summary)::INTEGER AS level FROM articles GROUP BY ROLLUP (status, summary)",
    "article_sample": "SELECT o_orderkey AS id, o_custkey AS source_id FROM orders WHERE ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT % 100 < 10",
    "source_sets": f"""WITH {_JOBS}, {_SOURCES}, l AS (SELECT DISTINCT source_id FROM jobs WHERE state IN ('pending', 'running')), d AS (SELECT id AS source_id FROM crawl WHERE enabled AND feed_url IS NOT NULL AND next_crawl_at <= {_NOW})
        SELECT 'both' AS part, source_id FROM (SELECT * FROM l INTERSECT SELECT * FROM d) UNION ALL SELECT 'live only', source_id FROM (SELECT * FROM l EXCEPT SELECT * FROM d)
        UNION ALL SELECT 'due only', source_id FROM (SELECT * FROM d EXCEPT SELECT * FROM l) UNION ALL SELECT 'either', source_id FROM (SELECT * FROM l UNION SELECT * FROM d)""",
    "event_windows": """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS second_after, (ntile(4) OVER w)::INTEGER AS quarter, (dense_rank() OVER (PARTITION BY user_id ORDER BY event_type))::INTEGER AS kind_rank,
        (count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))::BIGINT AS in_a_day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "ingest_counters": f"""WITH {_UPSERT_SIDES}, m AS (SELECT coalesce(e.k, b.k) AS k, e.k IS NOT NULL AS old, b.k IS NOT NULL AS new, CASE WHEN e.k IS NULL THEN 7 ELSE nation END AS source_id FROM e FULL JOIN b ON e.k = b.k)
        SELECT source_id::BIGINT AS source_id, (count(*) FILTER (WHERE NOT old))::BIGINT AS written, (count(*) FILTER (WHERE old AND new AND k % 12 <> 0))::BIGINT AS updated, (count(*) FILTER (WHERE old AND (NOT new OR k % 12 = 0)))::BIGINT AS unchanged,
          (count(*) FILTER (WHERE old AND k % 4 = 0))::BIGINT AS bodied FROM m GROUP BY 1""",
    "fingerprint_backlog": "SELECT doc_id AS id, length(text)::INTEGER AS chars FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 AND length(text) >= 500",
    "full_content_ingest": f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '<>&', '   ') AS text FROM documents), n AS (SELECT doc_id, replace(replace({_NORM}, chr(173), ''), chr(8203), '') AS norm FROM d)
        SELECT 'https://d.example/' || doc_id AS canonical_url, 'short' AS summary, CASE WHEN doc_id % 3 = 0 AND length(norm) >= 500 THEN length(norm) - length(replace(norm, ' ', '')) + 1 END::INTEGER AS word_count, CASE WHEN doc_id % 3 = 0 AND length(norm) >= 500 THEN sha256(norm) END AS content_hash FROM n""",
    "article_touch": f"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS title FROM orders)
        SELECT id, title, CASE WHEN id % 11 = 0 OR title IS DISTINCT FROM t THEN {_NOW} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM o""",
    "url_uuid": f"""WITH {_CANONICAL}, h AS (SELECT page_id, md5(canonical_url) AS h FROM canonical)
        SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
    "fts_refresh": "WITH "
    + _tsv().replace(
        "left(text, 80) AS title", "CASE WHEN doc_id % 3 = 0 THEN 'New title ' || doc_id ELSE left(text, 80) END AS title"
    ).replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 1)")
    + " SELECT id, lexeme, count(*)::BIGINT AS n, min(pos)::INTEGER AS first_pos, min(weight) AS best_weight FROM postings GROUP BY id, lexeme",
}

"""SQL, for another engine, that gives the results of ``plans.tables``."""

from __future__ import annotations

_PAGES = "p AS (SELECT DISTINCT * FROM pages)"
_LINKS = (
    "k AS (SELECT url, file_path, source_name, indexed_at FROM (SELECT *, row_number() OVER "
    "(PARTITION BY url, file_path ORDER BY indexed_at DESC NULLS LAST, source_name DESC NULLS LAST) AS n FROM links) WHERE n = 1)"
)
_FIRST = "s AS (SELECT min(name) AS name FROM sources)"
_STATE = """CASE WHEN parsed_at IS NOT NULL THEN 'parsed' WHEN fetched_at IS NOT NULL AND fail_reason IS NOT NULL THEN 'parse_rejected'
    WHEN fetched_at IS NOT NULL THEN 'awaiting_parse' WHEN fail_reason IS NOT NULL THEN 'fetch_failed' ELSE 'pending' END"""
_COUNTS = "count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({_STATE} = '{s}') AS {s}" for s in ("pending", "fetch_failed", "awaiting_parse", "parse_rejected", "parsed")
)
# canonical form of the tables' URLs, which are plain: no fragment, no trackers, no slash at the end
_BARE = "split_part({u}, '#', 1)"
_QUERY = "nullif(split_part({b}, '?', 2), '')"
_KEPT = """array_to_string(list_sort(list_filter(string_split(coalesce({q}, ''), '&'),
    lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|(fbclid|gclid|gclsrc|dclid|msclkid|mc_eid|mc_cid|igshid|ref_src|ref_url|spm|_hsenc|_hsmi|vero_id|yclid|wt_mc|cmpid)(=|$))'))), '&')"""


def _canonical(url: str) -> str:
    bare = _BARE.format(u=url)
    path = f"regexp_replace(regexp_replace(split_part({bare}, '?', 1), '^https://www\\.', 'https://'), '([^/])/+$', '\\1')"
    kept = _KEPT.format(q=_QUERY.format(b=bare))
    return f"{path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


_DOMAIN = "regexp_extract({u}, '^https?://(?:[^/?#]*\\.)?([^./?#]+\\.[^./?#]+)(?:[/?#]|$)', 1)"
_SLUG = "regexp_replace({d}, '[^A-Za-z0-9.\\-]', '-', 'g') || '-' || left(md5({u}), 16)"
_HTML = "'<html><head><title> ' || coalesce(title, '') || ' </title></head><body>' || coalesce(md_content, '') || '</body></html>'"
_BLOCKS = "just a moment|attention required|access denied|403 forbidden|you are being redirected|please wait|checking your browser|security check|bot verification|error \\d{3}"
_VECTORS = "v AS (SELECT DISTINCT ON (vec_id) * FROM chunk_vectors ORDER BY vec_id)"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


_NEAR = f"""
    e AS (SELECT *, (label % 3)::VARCHAR AS collection FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, e.vec_id, e.collection, e.label, round(1 - {_cosine('q.embedding', 'e.embedding')}, 12) AS distance
        FROM e AS q, e WHERE q.vec_id % 100 = 0)"""
_RANKS = f"""{_NEAR},
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d),
    b AS (SELECT query_id, label, min(rank) AS rank FROM h WHERE rank <= 26 AND vec_id <> query_id GROUP BY ALL),
    o AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank, label) AS source_rank FROM b),
    r AS (SELECT q.vec_id AS query_id, min(o.source_rank) AS rank FROM e AS q LEFT JOIN o ON o.query_id = q.vec_id AND o.label = q.label
        WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id)"""

def _prune(where: str) -> str:
    return f"WITH {_PAGES}, {_LINKS} SELECT url, slug FROM p WHERE {where}"


SQL: dict[str, str] = {
    "status_by_domain": f"WITH {_PAGES} SELECT domain, {_COUNTS} FROM p GROUP BY domain",
    "status_counts": f"WITH {_PAGES} SELECT {_COUNTS} FROM p",
    "page_states": f"WITH {_PAGES} SELECT url, {_STATE} AS state FROM p",
    "fail_summary": f"WITH {_PAGES} SELECT domain, fail_reason, count(*) AS n FROM p WHERE fail_reason IS NOT NULL GROUP BY ALL",
    "duplicate_slugs": f"WITH {_PAGES} SELECT slug, count(*) AS n FROM p GROUP BY slug HAVING count(*) > 1",
    "shared_folders": f"WITH {_PAGES}, d AS (SELECT regexp_replace(slug, '-[0-9a-f]{{16}}$', '') AS slug FROM p) SELECT slug, count(*) AS n FROM d GROUP BY slug HAVING count(*) > 1",
    "list_newest": f"WITH {_PAGES} SELECT url, fetched_at FROM p WHERE fetched_at IS NOT NULL ORDER BY fetched_at DESC, url LIMIT 20",
    "list_of_source": f"""WITH {_PAGES}, {_LINKS}, {_FIRST} SELECT url, domain, fetched_at FROM p
        WHERE fetched_at IS NOT NULL AND url IN (SELECT url FROM k, s WHERE source_name = name)""",
    "unparsed": f"WITH {_PAGES} SELECT url FROM p WHERE fetched_at IS NOT NULL AND parsed_at IS NULL AND fail_reason IS NULL",
    "fetch_candidates": f"""WITH {_PAGES}, u AS (SELECT DISTINCT url FROM links)
        SELECT u.url, coalesce(p.original_url, u.url) AS original_url FROM u LEFT JOIN p USING (url) WHERE p.fetched_at IS NULL AND p.fail_reason IS NULL""",
    "linked_failures": f"WITH {_PAGES} SELECT url, fail_reason FROM p WHERE fail_reason IS NOT NULL AND url IN (SELECT url FROM links)",
    "prune_failed": _prune("fail_reason IS NOT NULL"),
    "prune_missing": _prune("fail_reason IS NOT NULL AND url NOT IN (SELECT url FROM k)"),
    "links_after_prune": f"WITH {_PAGES}, {_LINKS} SELECT url, file_path FROM k WHERE url NOT IN (SELECT url FROM p WHERE fail_reason IS NOT NULL)",
    "exclusive_pages": f"""WITH {_PAGES}, {_LINKS}, {_FIRST} SELECT url FROM p WHERE url IN (SELECT url FROM k, s WHERE source_name = name)
        AND url NOT IN (SELECT url FROM k, s WHERE source_name IS DISTINCT FROM name)""",
    "dangling_links": f"""WITH {_LINKS} SELECT url, file_path, 'page' AS missing FROM k WHERE url NOT IN (SELECT url FROM pages)
        UNION ALL SELECT url, file_path, 'source' FROM k WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT name FROM sources)""",
    "dangling_after_prune": f"""WITH {_LINKS}, {_FIRST} SELECT url, file_path, 'page' AS missing FROM k WHERE url NOT IN (SELECT url FROM pages WHERE fail_reason IS NULL)
        UNION ALL SELECT url, file_path, 'source' FROM k, s WHERE source_name IS NOT NULL AND (source_name = name OR source_name NOT IN (SELECT name FROM sources))""",
    "newest_links": f"WITH {_LINKS} SELECT * FROM k",
    "replace_links": f"""WITH {_LINKS}, {_FIRST}, f AS (SELECT DISTINCT file_path FROM links, s WHERE source_name = name)
        SELECT url, file_path, source_name, indexed_at FROM k WHERE file_path NOT IN (SELECT file_path FROM f)
        UNION ALL SELECT 'https://leafmill.example/', file_path, NULL, '2099' FROM f""",
    "remove_source": f"WITH {_LINKS}, {_FIRST} SELECT url, file_path, CASE WHEN source_name <> name THEN source_name END AS source_name, indexed_at FROM k, s",
    "upsert_pages": f"""WITH {_PAGES}, c AS (SELECT * FROM (SELECT url, title, word_count, converted_at, row_number() OVER
        (PARTITION BY url ORDER BY converted_at DESC, result_id DESC) AS n FROM (SELECT DISTINCT * FROM conversion_results) WHERE converted_at IS NOT NULL) WHERE n = 1)
        SELECT p.url, CASE WHEN n IS NULL THEN p.title ELSE c.title END AS title, CASE WHEN n IS NULL THEN p.word_count ELSE c.word_count END AS word_count,
            CASE WHEN n IS NULL THEN fail_reason END AS fail_reason, coalesce(added_at, CASE WHEN n = 1 THEN '2099' END) AS added_at, CASE WHEN n IS NULL THEN fetched_at ELSE converted_at END AS fetched_at
        FROM p LEFT JOIN c USING (url)""",
    "insert_absent": f"""WITH {_PAGES}, o AS (SELECT * FROM p WHERE parsed_at IS NOT NULL), n AS (SELECT DISTINCT url, {_DOMAIN.format(u='url')} AS domain FROM links)
        SELECT url, original_url, domain, slug, parsed_at FROM o
        UNION ALL SELECT url, url, domain, {_SLUG.format(d='domain', u='url')}, NULL FROM n WHERE url NOT IN (SELECT url FROM o)""",
    "diverted_pages": f"WITH {_PAGES} SELECT url, fail_reason FROM p",
    "url_verdicts": f"""WITH {_PAGES} SELECT url, original_url, {_canonical('original_url')} AS target, 'passthrough' AS verdict,
        NULL::VARCHAR AS reason, NULL::VARCHAR AS rule FROM p""",
    "registered_urls": f"""WITH r AS (SELECT *, {_canonical('original_url')} AS target FROM pages),
        f AS (SELECT target AS url, original_url, row_number() OVER (PARTITION BY target ORDER BY added_at NULLS FIRST, original_url) AS n, {_DOMAIN.format(u='target')} AS domain FROM r)
        SELECT url, original_url, domain, {_SLUG.format(d='domain', u='url')} AS slug FROM f WHERE n = 1""",
    "url_parts": f"""WITH {_PAGES}, f AS (SELECT url, {_DOMAIN.format(u='url')} AS filed, lower(regexp_extract(url, '^https://[^/]*([^?#]*)', 1)) AS path FROM p)
        SELECT url, filed, {_SLUG.format(d='filed', u='url')} AS made_slug, path LIKE '%.pdf' OR regexp_matches(path, '^/+pdf/+[^/]') AS pdf,
            regexp_matches(path, '\\.(md|txt|rst|csv|tsv)$') AS raw_text FROM f""",
    # the notes hold bare URLs only, none of them run together
    "note_urls": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s<>\[\]"]+') AS urls FROM (SELECT DISTINCT doc_id, text FROM documents))
        SELECT doc_id, unnest(range(len(urls)))::INT AS pos, regexp_replace(unnest(urls), '[.,;:!?'']+$', '') AS url FROM m""",
    "html_checks": f"""WITH h AS (SELECT DISTINCT result_id, title, {_HTML} AS html FROM conversion_results),
        b AS (SELECT *, strlen(html) AS size, regexp_extract(left(html, 3000),
            '(?i)<title[^>]*>\\s*((?:just a moment|attention required|access denied|403 forbidden|you are being redirected|please wait|checking your browser|security check|bot verification|error \\d{{3}})(?:\\s*\\.{{1,3}})?)\\s*</title>', 1) AS bad FROM h)
        SELECT result_id, CASE WHEN size > 10485760 THEN 'html too large (' || (size // 1048576) || 'MB)' WHEN size < 512 THEN 'html suspiciously small (' || size || ' bytes)'
            WHEN bad <> '' THEN 'block page (title: ''' || bad || ''')'
            {' '.join(f"WHEN contains(left(html, 5000), '{m}') THEN 'block page (marker: ''{m}'')'" for m in ('cf-browser-verification', 'challenge-platform', 'cf_chl_opt', '_cf_chl_tk', 'enable JavaScript and cookies to continue'))}
            END AS reason, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM b""",
    "too_short": r"""WITH t AS (SELECT DISTINCT result_id, len(regexp_extract_all(md_content, '[\p{L}\p{N}_]+'))::INT AS words, strlen(md_content) AS size
            FROM conversion_results WHERE md_content IS NOT NULL)
        SELECT result_id, words, CASE WHEN words < 50 THEN 'too short (' || words || ' words < 50, from ' ||
            CASE WHEN size < 1024 THEN size || ' B' ELSE (size // 1024) || ' KB' END || ' html)' END AS reason FROM t""",
    "index_changes": f"""WITH {_VECTORS}, a AS (SELECT source, id FROM v),
        c AS (SELECT source, CASE WHEN chunk_index = 0 THEN md5(id) ELSE id END AS id FROM v WHERE length(source) % 7 <> 0)
        SELECT source, id, 'new' AS change FROM c WHERE (source, id) NOT IN (SELECT source, id FROM a)
        UNION ALL SELECT source, id, 'stale' FROM a WHERE source IN (SELECT source FROM c) AND (source, id) NOT IN (SELECT source, id FROM c)
        UNION ALL SELECT source, id, 'pruned' FROM a WHERE source NOT IN (SELECT source FROM c)""",
    "collections": f"WITH {_VECTORS} SELECT collection, count(*) AS chunks, count(DISTINCT source) AS files FROM v GROUP BY collection",
    "collection_roots": f"""WITH {_VECTORS} SELECT collection, count(*) AS chunks, count(DISTINCT source) AS files, path AS root FROM
        (SELECT v.*, s.path FROM v LEFT JOIN sources AS s ON s.name = v.collection) GROUP BY collection, path""",
    "knn": f"""WITH {_NEAR}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
        SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM h WHERE rank <= 5""",
    "knn_collections": f"""WITH {_NEAR}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, collection, vec_id) AS rank FROM d)
        SELECT query_id, vec_id, collection, rank::INT AS rank, round(greatest(0.0, (1 - distance) * 100), 4) AS confidence FROM h WHERE rank <= 5""",
    "knn_chunks": f"""WITH {_VECTORS}, w AS (SELECT * FROM v WHERE embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0),
        d AS (SELECT q.vec_id AS query_id, w.vec_id, round(1 - {_cosine('q.embedding', 'w.embedding')}, 12) AS distance FROM w AS q, w WHERE q.vec_id % 100 = 0),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
        SELECT query_id, vec_id, rank::INT AS rank FROM h WHERE rank <= 5""",
    "retrieval_ranks": f"WITH {_RANKS} SELECT query_id, rank::INT AS rank FROM r",
    "retrieval_metrics": f"""WITH {_RANKS} SELECT count(*) AS queries, {', '.join(f"round_even(avg(CASE WHEN rank <= {n} THEN 1.0 ELSE 0.0 END), 3) AS hit_at_{n}" for n in (1, 3, 5))},
        round_even(avg(coalesce(1 / rank, 0.0)), 3) AS mrr FROM r""",
    "imperfect_queries": f"WITH {_RANKS} SELECT query_id, rank::INT AS rank FROM r WHERE rank IS NULL OR rank > 1",
    "crawl": f"""WITH {_PAGES}, {_LINKS}, n AS (SELECT DISTINCT url, file_path, domain FROM k JOIN p USING (url)), l0 AS (SELECT min(url) AS url FROM p GROUP BY domain),
        f0 AS (SELECT DISTINCT file_path, domain FROM n JOIN l0 USING (url)), l1 AS (SELECT DISTINCT url FROM n JOIN f0 USING (file_path, domain) WHERE url NOT IN (SELECT url FROM l0)),
        f1 AS (SELECT DISTINCT file_path, domain FROM n JOIN l1 USING (url)), l2 AS (SELECT DISTINCT url FROM n JOIN f1 USING (file_path, domain) WHERE url NOT IN (SELECT url FROM l0 UNION SELECT url FROM l1))
        SELECT url, 0 AS level FROM l0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2""",
    "rule_actions": f"""WITH {_PAGES}, d AS (SELECT domain AS top FROM p GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1),
        m AS (SELECT url, top, regexp_extract(url, '^https://([^/?#]*)', 1) AS host, {_DOMAIN.format(u='url')} AS own FROM p, d),
        r AS (SELECT *, CASE WHEN host = 'blog.' || top THEN 'no blog of its own' WHEN starts_with(url, 'https://docs.') THEN 'by way of a mirror'
            WHEN regexp_matches(url, '^https://[^/]+/\\d{{4}}/\\d\\d/') THEN 'a year is enough' WHEN own = top THEN 'not this site' END AS named FROM m),
        t AS (SELECT *, CASE named WHEN 'no blog of its own' THEN replace(url, '://blog.', '://') WHEN 'by way of a mirror' THEN 'https://mirror.example/' || url
            WHEN 'a year is enough' THEN regexp_replace(url, '/(\\d{{4}})/\\d\\d/', '/\\1/') ELSE url END AS moved FROM r)
        SELECT url, CASE WHEN named = 'not this site' THEN NULL ELSE {_canonical('moved')} END AS target,
            CASE WHEN named = 'not this site' THEN 'skipped' WHEN named IS NULL THEN 'passthrough' ELSE 'rewritten' END AS verdict,
            CASE WHEN named = 'not this site' THEN 'too much of it' END AS reason, named AS rule FROM t""",
    "run_failures": f"""WITH {_PAGES}, {_LINKS}, {_FIRST} SELECT domain, fail_reason, count(*) AS n FROM p WHERE fail_reason IS NOT NULL
        AND url IN (SELECT url FROM k, s WHERE source_name = name) GROUP BY ALL ORDER BY n DESC, domain, fail_reason LIMIT 10""",
    "fetch_errors": f"""WITH {_PAGES} SELECT url, ['timeout', 'DNS resolution failed', 'connection refused', 'net::ERR_CONNECTION_RESET at', 'odd', 'timeout'][length(url) % 6 + 1] AS reason,
        length(url) % 6 IN (3, 5) AS again FROM p""",
    "parsed_pages": f"""WITH {_PAGES}, h AS (SELECT *, length(url) AS n, '<html><head><title> ' || coalesce(title, '') || ' </title><style>' || repeat('x', 20 * (length(url) % 31)) || '</style></head><body><nav>Home</nav><h1>' || slug
            || '</h1><p>' || repeat('plain words here ', length(url) % 23) || '</p><ul><li>first</li><li>second</li></ul><footer>the end</footer></body></html>' AS html, coalesce(content_type, 'html') = 'pdf' AS pdf FROM p),
        t AS (SELECT *, strlen(html) AS size, CASE WHEN pdf THEN html ELSE '# ' || slug || CASE WHEN n % 23 > 0 THEN chr(10) || chr(10) || trim(repeat('plain words here ', n % 23)) ELSE '' END || chr(10) || chr(10) || '- first' || chr(10) || '- second' END AS text FROM h),
        w AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM t),
        f AS (SELECT *, CASE WHEN NOT pdf AND size < 512 THEN 'html suspiciously small (' || size || ' bytes)'
            WHEN NOT pdf AND regexp_full_match(trim(title), '(?i)({_BLOCKS})(\\s*\\.{{1,3}})?') THEN 'block page (title: ''' || trim(title) || ''')'
            WHEN words < 50 THEN 'too short (' || words || ' words < 50, from ' ||
            CASE WHEN size < 1024 THEN size || ' B' ELSE (size // 1024) || ' KB' END || CASE WHEN pdf THEN ' pdf)' ELSE ' html)' END END AS why FROM w)
        SELECT url, slug, CASE WHEN why IS NULL THEN text END AS markdown, CASE WHEN why IS NULL AND NOT pdf THEN nullif(trim(title), '') END AS title,
            CASE WHEN why IS NULL THEN words ELSE 0 END::BIGINT AS word_count, why AS fail_reason FROM f""",
    "page_links": f"""WITH {_PAGES} SELECT url, url AS link FROM p UNION ALL SELECT url, regexp_extract(url, '^https://[^/?#]*') || '/next' FROM p""",
    "embedded_chunks": f"""WITH {_VECTORS}, c AS (SELECT vec_id, list_transform(range(26), lambda i: (length(lower(document)) - length(replace(lower(document), chr(97 + i::INT), '')))::DOUBLE) AS n FROM v WHERE document IS NOT NULL),
        u AS (SELECT vec_id, CASE WHEN list_sum(n) = 0 THEN list_transform(range(26), lambda i: (i = 0)::INT::DOUBLE) ELSE n END AS n FROM c)
        SELECT vec_id, unnest(range(26))::INT AS letter, round(unnest(n) / sqrt(list_dot_product(n, n))::FLOAT, 3) AS share FROM u""",
    "markdown_spaces": r"""SELECT DISTINCT ON (doc_id) doc_id, regexp_replace(text, '([a-z][.:;!?])([A-Z][a-z])', '\1 \2', 'g') AS spaced FROM documents""",
    "chunk_checks": r"""SELECT DISTINCT file_path AS source, true AS numbered, true AS short, true AS addressed, true AS in_order FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]')""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sliding_windows": """SELECT (date_trunc('day', ts) - i * INTERVAL 1 DAY)::TIMESTAMP AS start, event_type, count(*) AS n
        FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2""",
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, run""",
}
SQL["stream_event_windows"] = SQL["event_windows"]

"""DuckDB SQL with the same results as the queries of ``importing``."""

from __future__ import annotations

from .catalog import QUERY, QUERY_VECTOR
from .oracle import bm25, near, toks


def _indexed(query: str, formula: str, where: str = "true", weighted: bool = False) -> str:
    words = query.lower().split()
    values = ", ".join(f"('{w}', {words.count(w)})" for w in dict.fromkeys(words))
    idf = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * times" if formula == "fts" else "greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5)))"
    factor = "* CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.7 ELSE 1.0 END" if weighted else ""
    order = "'Document ' || doc_id, doc_id" if weighted else "doc_id"
    return f"""WITH q(t, times) AS (VALUES {values}),
docs AS (SELECT doc_id, {toks('text')} AS toks FROM documents WHERE {where}),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
tf AS (SELECT doc_id, t, times, len(toks) AS dl, len(list_filter(toks, lambda x: x = t)) AS tf FROM docs, q),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
summed AS (SELECT doc_id, sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (t), stats WHERE tf > 0 GROUP BY doc_id),
scored AS (SELECT s.doc_id, s.score {factor} AS score FROM summed s LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(score, 9) DESC, {order} LIMIT 10"""


_ITEMS = """items AS (SELECT source AS feed, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)"""


def oracle_sql() -> dict[str, str]:
    return {
        "fts_search": _indexed(f"{QUERY} the", "fts"),
        "index_filtered_search": _indexed("der und ein von erly", "scan", "lang = 'de'", True),
        "replaced_sources": """SELECT doc_id::VARCHAR AS item, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 20 = 3 THEN 'insert' WHEN doc_id % 10 = 3 THEN 'replace' ELSE 'left' END AS action,
  length(text) + CASE WHEN doc_id % 10 = 3 THEN 10 ELSE 0 END AS n_chars FROM documents WHERE trim(text) <> ''""",
        "reembed_ranges": """WITH c AS (SELECT CASE vec_id % 5 WHEN 1 THEN 'updated' WHEN 2 THEN 'created' WHEN 3 THEN 'updated' ELSE 'unchanged' END AS action FROM embeddings)
SELECT action, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'other_models', count(*) FROM embeddings WHERE vec_id % 5 = 4""",
        "block_index_upkeep": _indexed(f"{QUERY} the", "scan", "doc_id % 100 <> 1", True),
        "block_index_filters": _indexed(
            "der und ein von erly", "scan",
            "doc_id % 3 < 2 AND (lang = 'de' OR lang IS NULL) AND regexp_matches(source, '^src1?[13579]$') AND (doc_id % 2 = 0 OR doc_id % 5 = 3)",
        ),
        "versioned_page_links": r"""WITH p AS (SELECT page_id, html, string_split(html, '<a ') AS s FROM pages),
a AS (SELECT page_id, html, s, unnest(range(1, len(s)))::BIGINT AS k FROM p),
b AS (SELECT page_id, html, k, s[k + 1] AS rest, (list_sum(list_transform(s[1:k], lambda x: length(x))) + 3 * (k - 1))::BIGINT AS start FROM a),
c AS (SELECT page_id, k, start, html, regexp_extract(rest, 'href="([^"]+)"', 1) AS url, regexp_replace(string_split(string_split(rest, '</a>')[1], '>')[2], '<[^>]+>', ' ', 'g') AS label FROM b WHERE contains(rest, '</a>')),
v AS (SELECT page_id, k, url, CASE WHEN contains(lower(regexp_replace(substr(html, greatest(start - 300, 0) + 1, start + 200 - greatest(start - 300, 0)), '<[^>]+>', ' ', 'g')), 'and') THEN 'legacy' ELSE 'current' END AS version
  FROM c WHERE contains(url, '/') AND contains(lower(url || ' ' || label), 'th')),
f AS (SELECT page_id, version, url, min(k) AS k FROM v GROUP BY ALL),
n AS (SELECT page_id, url, version, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS n FROM f),
e AS (SELECT page_id, count(*) = 2 AND count(DISTINCT version) = 1 AS alike FROM n WHERE n < 2 GROUP BY page_id)
SELECT page_id, n, CASE WHEN alike AND n = 0 THEN 'current' WHEN alike AND n = 1 THEN 'legacy' ELSE version END AS version, url FROM n JOIN e USING (page_id)""",
        "vector_index_search": f"WITH {near('v', QUERY_VECTOR)} SELECT doc_id, round(score, 6) AS score FROM v",
        "vector_batch_topk": """WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
        "vector_decode": "SELECT vec_id AS doc_id, CASE WHEN vec_id % 7 <> 0 THEN len(embedding) END AS dims, CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings",
        "corpus_version": "SELECT count(*) AS n, max(event_id)::VARCHAR AS created, max(user_id)::VARCHAR AS updated FROM events",
        "json_weights": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 2.0::DOUBLE WHEN 3 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, CASE doc_id % 5 WHEN 3 THEN 'x' END AS tree FROM documents",
        "normalized_titles": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM t""",
        "title_versions": """WITH t AS (SELECT doc_id, doc_id % 1200 - 3 AS n, CASE WHEN doc_id % 4 = 0 THEN 'b' ELSE '' END AS s FROM documents)
SELECT doc_id, n::INT AS number, 'show-' || CASE WHEN n < 0 THEN '-' || lpad(abs(n)::VARCHAR, 2, '0') WHEN n > 999 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END || s AS item_id,
  CASE doc_id % 3 WHEN 0 THEN 'legacy' WHEN 1 THEN 'current' END AS label, CASE doc_id % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS weight FROM t""",
        "document_anchors": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '(?is)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1) AS k FROM pages),
f AS (SELECT page_id, href, min(k) AS k FROM a WHERE (contains(lower(label), 'th') OR (contains(lower(href), 'th') AND contains(lower(href), '.pdf'))) AND (contains(lower(href), '.pdf') OR contains(lower(href), 'th')) GROUP BY page_id, href),
g AS (SELECT page_id, count(*) AS n, string_agg(href, ' ' ORDER BY k) AS found FROM f GROUP BY page_id)
SELECT p.page_id, coalesce(n, 0) AS n, coalesce(found, '') AS found FROM pages p LEFT JOIN g USING (page_id)""",
        "episode_pages": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://example.org/' || doc_id WHEN 1 THEN 'https://www.buzzsprout.com/11/' || doc_id WHEN 2 THEN 'https://www.buzzsprout.com/11/' || doc_id ELSE '' END AS url FROM documents""",
        "tree_and_time_metadata": """SELECT doc_id, 'the-' || lower(source) || '-show' AS source_tree_slug, 'podcast' AS source_tree_type, CASE WHEN doc_id % 2 = 0 THEN 'proportional_estimate' ELSE 'asr_segment' END AS timestamp_provenance,
  CASE WHEN doc_id % 2 = 0 THEN 'approximate' ELSE 'segment' END AS timestamp_precision, 'chunk_start' AS citation_anchor FROM documents""",
        "chronological_numbers": """WITH k AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN '9999-12-31T23:59:59+00:00' ELSE strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS date_key FROM events)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_key, event_id) AS number FROM k""",
        "glossaries": """WITH f AS (SELECT source, doc_id % 40 AS t, min(doc_id) AS k FROM documents GROUP BY 1, 2),
r AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY k) AS i, count(*) OVER (PARTITION BY source) AS many FROM f),
w AS (SELECT source, string_agg('Part ' || t, '. ' ORDER BY i) AS terms, any_value(many) AS many FROM r GROUP BY source)
SELECT source, CASE WHEN 2 * many + 1 > 30 THEN array_to_string(list_slice(string_split('Extra. ' || terms || '.', ' '), 1, 30), ' ') ELSE 'Extra. ' || terms || '.' END AS glossary FROM w""",
        "sentence_ends": r"""WITH t AS (SELECT ((conv_id + turn) % 9)::INT AS kind, text || ['', '?"', '.' || chr(8221), ' and', chr(39), '! ' || chr(10) || ' ', ',', chr(8221), ' ' || chr(10)][((conv_id + turn) % 9)::INT + 1] AS text FROM conversations)
SELECT kind, regexp_matches(regexp_replace(text, '\s+$', ''), '([.?!]|\.”|[?!]"|[.?!]'')$') AS ends, count(*) AS n FROM t GROUP BY ALL""",
        "serialized_jobs": """SELECT event_id AS job_id, '{"job_id":' || event_id || ',"job_type":"' || event_type || '","owner":' || user_id || '}' AS json FROM events""",
        "stale_urls": "SELECT page_id, url FROM pages WHERE contains(url, '/en/1') OR contains(url, '?page=') OR contains(url, '.org/de')",
        "caption_identities": """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'source_tree_slug' WHEN page_id % 10 = 0 THEN 'video_id' WHEN page_id % 7 = 0 THEN 'guid' WHEN page_id % 6 = 0 THEN 'canonical_url' END AS problem FROM pages""",
        "feed_episodes": f"""WITH {_ITEMS} SELECT feed, idx::INT AS idx, doc_id || ': Talk & more' AS title, 'g-' || doc_id AS guid, 'https://example.org/' || doc_id AS link, (60 + doc_id % 10)::BIGINT AS seconds, doc_id::VARCHAR AS number, 'Talk & more' AS episode_title, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS transcripts FROM items""",
        "feed_transcripts": "SELECT 'g-' || doc_id AS guid, 'text/srt' AS kind, 'https://example.org/t.srt' AS url FROM documents WHERE doc_id % 3 = 0",
        "feed_guids": "SELECT source AS feed, 'g-' || doc_id AS guid, doc_id || ': Talk &amp; more' AS title FROM documents",
        "vtt_line_machine": r"""WITH c AS (SELECT conv_id AS file, turn, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]+>', '', 'g')) AS body FROM conversations)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY turn) AS idx, ((turn // 15) * 60 + (turn % 15) * 4) * 1000 + 250 AS start_ms, ((turn // 15) * 60 + (turn % 15) * 4) * 1000 + 750 AS end_ms, length(body) AS n_chars FROM c WHERE body <> '' AND NOT regexp_matches(body, '^\d+$')""",
        "source_configs": """WITH c AS (SELECT doc_id AS position, 'Name ' || doc_id AS name, 's-' || (doc_id % 50) AS slug, NULL::VARCHAR AS feed_url, 'https://example.org/' || doc_id AS url, 'https://example.org/' || doc_id AS address FROM documents)
(SELECT * FROM c WHERE slug = 's-7' ORDER BY position LIMIT 1) UNION ALL (SELECT * FROM c WHERE name = 'Name 3' ORDER BY position LIMIT 1)""",
        "manifest_contract": """WITH c AS (SELECT doc_id + 1 AS p FROM documents), g AS (SELECT p, CASE WHEN p % 19 = 0 THEN ' ' ELSE 'g' || CASE WHEN p % 23 = 0 THEN 0 ELSE p END END AS guid FROM c),
m AS (SELECT p, guid, count(*) OVER (PARTITION BY guid) AS times FROM g)
SELECT p AS position, problem FROM (SELECT p, CASE WHEN p % 13 = 0 THEN 'queue_number' WHEN p % 17 = 0 THEN 'artifact_stem' WHEN p % 19 = 0 THEN 'guid' WHEN times > 1 THEN 'duplicate' WHEN p % 29 = 0 THEN 'missing_text' END AS problem FROM m) WHERE problem IS NOT NULL""",
        "artifact_triplets": """WITH r AS (SELECT page_id AS n, CASE WHEN page_id % 11 = 0 THEN 'missing or invalid artifact' WHEN page_id % 5 = 0 THEN 'no segments' WHEN page_id % 19 = 0 THEN 'statistics not complete' WHEN page_id % 23 = 0 AND page_id <> -1 THEN 'mismatch: queue_number'
  WHEN page_id % 7 = 0 THEN 'no word times' WHEN page_id % 13 = 0 THEN 'an empty chunk' WHEN page_id % 17 = 0 THEN 'no chunk anchors' END AS reason FROM pages)
SELECT 's' || n AS stem, CASE WHEN reason IS NOT NULL THEN 'skipped_incomplete' WHEN n % 2 = 0 THEN 'reconcile' ELSE 'import' END AS status, reason FROM r""",
        "import_loop_results": """WITH RECURSIVE c AS (SELECT doc_id AS n, 'T' || (doc_id % 601) AS title, 'u' || (doc_id * 7 % 701) AS url FROM documents),
k AS (SELECT 'T' || doc_id AS title, 'u' || (doc_id + 350) AS url FROM documents WHERE doc_id % 17 = 3),
s AS (SELECT n, title, url, row_number() OVER (ORDER BY n) AS i, CASE WHEN n % 10 = 1 THEN 'already_done' WHEN n % 19 = 0 THEN 'skipped_incomplete' WHEN n % 13 = 0 THEN 'missing_transcript'
  WHEN title IN (SELECT title FROM k) OR url IN (SELECT url FROM k) THEN 'skipped_existing' WHEN n % 11 IN (2, 5) THEN 'error' ELSE 'imported' END AS first FROM c),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS n, NULL::VARCHAR AS status, []::VARCHAR[] AS had, 0 AS counted
  UNION ALL SELECT i, n, status, CASE WHEN status = 'imported' THEN list_concat(had, [title, url]) ELSE had END, counted + CASE WHEN status IN ('imported', 'skipped_existing') THEN 1 ELSE 0 END
  FROM (SELECT s.i, s.n, s.title, s.url, w.had, w.counted, CASE WHEN w.counted >= 300 THEN 'not_reached' WHEN s.first IN ('imported', 'error') AND (list_contains(w.had, s.title) OR list_contains(w.had, s.url)) THEN 'skipped_existing' ELSE s.first END AS status FROM w JOIN s ON s.i = w.i + 1))
SELECT n AS position, 'g' || n AS guid, status, CASE WHEN status = 'error' THEN CASE WHEN n % 11 = 2 THEN 'transcript could not be read' ELSE 'transcript has no segments' END WHEN status = 'skipped_incomplete' THEN 'statistics not complete' END AS reason,
  status IN ('imported', 'skipped_existing') AS has_source, CASE WHEN status = 'imported' THEN CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END END AS n_segments FROM w WHERE i > 0""",
        "bundle_round_trip": """SELECT 'documents' AS name, count(*) AS "rows", 'doc_id,text,lang,source,n_chars' AS columns, sum(length(text))::BIGINT AS total FROM documents
UNION ALL SELECT 'labels', count(*), 'doc_id,quality,toxic', sum(doc_id)::BIGINT FROM labels""",
        "caption_folder": r"""WITH c AS (SELECT conv_id // 50 AS folder, conv_id, turn, role, text, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)
SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY conv_id, turn, role, text) AS idx, turn * 4000 AS start_ms, length(body) AS n_chars FROM c WHERE body <> ''""",
        "import_actions": """WITH a AS (SELECT doc_id AS position, 'g' || doc_id AS guid, CASE WHEN doc_id % 20 = 1 THEN 'skip_terminal' WHEN doc_id % 3 = 0 THEN 'missing_transcript' WHEN doc_id % 4 = 2 OR doc_id % 14 = 5 THEN 'skip_existing' ELSE 'import' END AS action FROM documents),
f AS (SELECT position FROM a WHERE action IN ('skip_existing', 'import') ORDER BY position LIMIT 40)
SELECT position, guid, CASE WHEN action IN ('skip_existing', 'import') AND position NOT IN (SELECT position FROM f) THEN 'later' ELSE action END AS action FROM a""",
        "caption_statuses": """SELECT doc_id AS guid, CASE WHEN doc_id % 9 = 0 THEN 'no_caption' WHEN doc_id % 5 = 0 THEN 'missing_caption_file' WHEN doc_id % 4 = 0 THEN 'empty_caption' WHEN doc_id % 21 = 0 THEN 'conflict' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'skipped_existing' WHEN doc_id % 3 = 0 THEN 'reimported' ELSE 'imported' END AS status FROM documents""",
        "source_owners": "SELECT 'src_' || doc_id AS source_id, CASE WHEN source = 'src1' THEN 'foreign' ELSE 'importer' END AS owner FROM documents WHERE lang = 'en'",
        "rekeyed_state": "SELECT doc_id % 97 AS episode, 'g' || max(doc_id) AS guid, arg_max(lang, doc_id) AS status FROM documents WHERE doc_id % 6 > 0 GROUP BY 1",
        "applied_results": """SELECT d.doc_id AS episode, CASE WHEN l.toxic = 0 THEN 'imported' ELSE 'queued' END AS status, CASE WHEN l.toxic = 0 THEN 's' || d.doc_id END AS source_id FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "generated_without_published": "SELECT d.doc_id AS episode, lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1",
        "patched_metadata": "SELECT doc_id AS source_id, lang AS a, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS b, CASE WHEN doc_id % 2 = 0 THEN 'more' END AS c, source AS kept_b FROM documents",
        "inferred_trees": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'tree-b' WHEN starts_with('Document ' || doc_id, 'Document 1') THEN 'tree-a' WHEN starts_with('Document ' || doc_id, 'Document 2') OR doc_id % 5 = 0 THEN 'tree-b' END AS tree FROM documents""",
        "known_corpus": """SELECT 'video' AS kind, name, NULL AS tree FROM (SELECT lpad(doc_id::VARCHAR, 11, 'x') AS name FROM documents WHERE doc_id % 2 = 0 UNION SELECT lpad((doc_id % 1000)::VARCHAR, 11, 'y') FROM documents WHERE doc_id % 3 = 0)
UNION ALL SELECT 'title', 'talk ' || (doc_id % 100), coalesce(first(CASE WHEN doc_id % 200 > 20 THEN source END ORDER BY doc_id), '(no tree)') FROM documents GROUP BY doc_id % 100""",
        "merged_tabs": """WITH e AS (SELECT 'videos' AS listing, 1 AS lo, doc_id AS position, CASE WHEN doc_id % 50 > 0 THEN 'v' || (doc_id % 300) END AS item, 'A' || doc_id AS title FROM documents
  UNION ALL SELECT 'shorts', 2, doc_id, 'v' || (doc_id % 400), 'B' || doc_id FROM documents WHERE doc_id % 3 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY lo, position) AS nth FROM e WHERE item IS NOT NULL),
l AS (SELECT item, string_agg(DISTINCT listing, ',' ORDER BY listing DESC) AS listings FROM e WHERE item IS NOT NULL GROUP BY item)
SELECT item, title, lo AS listing_order, position, listings FROM f JOIN l USING (item) WHERE nth = 1 UNION ALL SELECT item, title, lo, position, listing FROM e WHERE item IS NULL""",
        "inverted_playlists": "SELECT doc_id % 61 AS video, string_agg(DISTINCT source, ',' ORDER BY source) AS playlists FROM documents GROUP BY 1",
        "offset_slice": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 30 OFFSET 20",
        "keyset_pages": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 25",
        "required_fields": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'url' ELSE 'guid,url' END AS missing FROM documents",
        "entity_listing": "SELECT DISTINCT CASE WHEN lang = 'en' THEN 'person' ELSE 'organization' END AS type, source AS slug, upper(source) AS label FROM documents",
        "episode_keys": """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id = 999 THEN -1 ELSE doc_id END END::INT AS raw, CASE doc_id % 3 WHEN 0 THEN (doc_id % 1000)::VARCHAR WHEN 1 THEN doc_id || 'a' END AS item FROM documents""",
        "rewritten_paths": """SELECT doc_id, '{"path":"artifacts://' || source || '/items/d' || doc_id || '/source.pdf","other":"data/in/x"}' AS json FROM documents""",
        "exported_transcripts": r"""WITH s AS (SELECT conv_id AS source, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text) END AS text FROM conversations)
SELECT source, count(*) AS segments, count(*) - 1 AS last_index, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '') || chr(10)) AS digest FROM s GROUP BY source""",
        "reembedded": """WITH s AS (SELECT vec_id AS d, embedding AS v FROM embeddings), k AS (
  SELECT d, 'm' AS model, CASE WHEN d % 11 = 5 THEN v[1] WHEN d % 3 = 0 THEN list_reverse(v)[1] ELSE v[1] END AS x FROM s WHERE d % 11 <> 5 OR d % 10 <> 0)
SELECT model, count(*) AS n, round(sum(x::DOUBLE), 4) AS first FROM k GROUP BY model""",
        "missing_identities": "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)",
        "entity_search": f"""WITH {bm25('b', QUERY, "source IN ('src3', 'src5')")} SELECT doc_id, round(score, 6) AS score FROM b""",
        "tenant_search": f"""WITH {bm25('b', QUERY, "lang = 'en'")} SELECT doc_id, round(score, 6) AS score FROM b""",
        "jobs_of_owner": "SELECT event_id AS job_id, event_type AS job_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10",
        "item_metadata": """SELECT doc_id, '{"transcript_provenance":"' || CASE doc_id % 3 WHEN 0 THEN 'auto_caption' WHEN 1 THEN 'published_current' ELSE 'other' END || '","retrieval_weight":' || CASE doc_id % 3 WHEN 0 THEN '0.8' WHEN 1 THEN '2.0' ELSE '1.0' END
  || ',"source_tree_slug":"' || source || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"guid":"g' || doc_id || '"' ELSE '' END || '}' AS json FROM documents""",
        "manifest_defaults": """WITH r AS (SELECT doc_id, source AS slug, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Show' END AS show_title FROM documents)
SELECT doc_id, slug, show_title, show_title || ' Press' AS publisher, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE show_title || ' Press' END AS author FROM r""",
        "transcript_kinds": r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' WHEN 2 THEN 'json' ELSE CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\.html?$') THEN 'html' ELSE 'text' END END AS kind FROM pages""",
        "batch_locations": "SELECT DISTINCT source, 'channel/' || source || '/queue.json' AS manifest, 'channel/' || source || '/audio' AS audio, 'channel/' || source || '/artifacts' AS artifacts, 'channel-' || source AS namespace FROM documents",
        "backup_generations": """WITH g AS (SELECT doc_id, source, '20240102T' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || '.' || CASE WHEN doc_id % 2 = 0 THEN '500000000' ELSE '000000000' END AS generation FROM documents),
r AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY generation DESC) AS nth FROM g) SELECT doc_id, source, generation FROM r WHERE nth <= 2""",
        "resume_points": "SELECT doc_id AS position, 'queued' AS status FROM documents WHERE doc_id >= 17 AND doc_id % 2 = 1 ORDER BY doc_id LIMIT 1",
    }

"""DuckDB SQL with the same results as the catalogue's queries."""

from __future__ import annotations

from ..functions.language import STOP_WORDS
from ..functions.text import SYNONYMS
from .catalog import BOUNDS, QUERY, QUERY_VECTOR, TRANSLATED, TRANSLATED_VECTOR, TREE_RULES

TOKS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def toks(column: str) -> str:
    return TOKS.format(column)


def terms(text: str) -> list[str]:
    return list(dict.fromkeys(text.lower().split()))


def values(items: list[str]) -> str:
    return ", ".join(f"('{x}')" for x in items)


def bm25(name: str, query: str, where: str = "true", limit: int = 10, weighted: bool = False, everywhere: bool = False) -> str:
    """CTEs that end in ``name`` (doc_id, score)."""
    factor = "* CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.7 ELSE 1.0 END" if weighted else ""
    join = "LEFT JOIN labels l ON l.doc_id = s.doc_id" if weighted else ""
    order = "'Document ' || doc_id, doc_id" if weighted else "doc_id"
    return f"""
{name}_all AS (SELECT doc_id, lang, source, {toks('text')} AS toks FROM documents),
{name}_sel AS (SELECT * FROM {name}_all WHERE {where}),
{name}_base AS (SELECT * FROM {name}_{'all' if everywhere else 'sel'}),
{name}_stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_base),
{name}_q(t) AS (VALUES {values(terms(query))}),
{name}_df AS (SELECT t, count(*) AS df FROM {name}_base, {name}_q WHERE list_contains(toks, t) GROUP BY t),
{name}_tf AS (SELECT doc_id, len(toks) AS dl, t, len(list_filter(toks, lambda x: x = t)) AS tf FROM {name}_sel, {name}_q),
{name}_sum AS (
  SELECT doc_id, sum(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_tf JOIN {name}_df USING (t), {name}_stats WHERE tf > 0 GROUP BY doc_id
),
{name}_weighted AS (SELECT s.doc_id, s.score {factor} AS score FROM {name}_sum s {join}),
{name} AS (SELECT doc_id, score FROM {name}_weighted WHERE score > 0 ORDER BY round(score, 9) DESC, {order} LIMIT {limit})"""


def near(name: str, vector: int, limit: int = 10) -> str:
    return f"""
{name}_all AS (
  SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id = {vector}
),
{name} AS (SELECT * FROM {name}_all WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT {limit})"""


def fused(name: str, runs: list[str], limit: int) -> str:
    ranked = " UNION ALL ".join(f"SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM {x}" for x in runs)
    return f"""
{name} AS (
  SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM ({ranked}) GROUP BY doc_id ORDER BY round(score, 12) DESC, doc_id LIMIT {limit}
)"""


def scored(ctes: list[str], last: str, digits: int = 6) -> str:
    return f"WITH {', '.join(ctes)} SELECT doc_id, round(score, {digits}) AS score FROM {last}"


def batch(limit: int) -> str:
    return f"""
toks AS (SELECT doc_id, {toks('text')} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM toks),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({toks('text')})) AS token FROM benchmark),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM toks) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
part AS (
  SELECT tf.token, doc_id, greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
  FROM tf JOIN df USING (token), stats
),
summed AS (SELECT query_id, doc_id, sum(part) AS score FROM asked JOIN part USING (token) GROUP BY query_id, doc_id HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM summed),
run AS (SELECT * FROM ranked WHERE rank <= {limit})"""


def hashed(text: str, where: str) -> str:
    """CTE ``hashed`` (doc_id, v): unit vectors of eight from token hashes."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items())
    return f"""
normal AS (
  SELECT doc_id, unnest(list_transform({toks(text)}, lambda x: CASE x {cases} ELSE CASE WHEN length(x) > 1 THEN regexp_replace(x, 's$', '') ELSE x END END)) AS token
  FROM {where}
),
signed AS (
  SELECT doc_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 8 AS i,
    sum(CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v
  FROM normal GROUP BY 1, 2
),
lengths AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM signed GROUP BY doc_id),
hashed AS (
  SELECT d.doc_id, list_transform(range(8), lambda k: coalesce(list_sum(list_filter(list_transform(any_value(x), lambda p: CASE WHEN p.i = k THEN p.v ELSE 0 END), lambda z: true)), 0) / coalesce(nullif(any_value(norm), 0), 1)) AS v
  FROM (SELECT DISTINCT doc_id FROM {where}) d
  LEFT JOIN (SELECT doc_id, list({{'i': i, 'v': v}}) AS x FROM signed GROUP BY doc_id) s USING (doc_id) LEFT JOIN lengths USING (doc_id)
  GROUP BY d.doc_id
)"""


def detected() -> str:
    """CTE ``found`` (doc_id, lang, language, confidence), for text in Latin script."""
    hits = ", ".join(
        f"len(list_filter(toks, lambda x: list_contains([{', '.join(repr(w) for w in sorted(set(stop.split())))}], x))) AS {code}_n"
        for code, stop in STOP_WORDS.items()
    )
    most = "greatest(" + ", ".join(f"{c}_n" for c in STOP_WORDS) + ")"
    pick = " ".join(f"WHEN {c}_n = {most} THEN '{c}'" for c in STOP_WORDS)
    return f"""
sample AS (SELECT doc_id, lang, {STRIP.format('text')} AS s FROM documents),
shape AS (
  SELECT doc_id, lang, length(s) AS size, length(s) - length(regexp_replace(s, '[A-Za-z\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]', '', 'g')) AS latin,
    {toks('s')} AS toks FROM sample
),
hits AS (SELECT doc_id, lang, latin, least(1.0, latin::DOUBLE / greatest(20, size)) AS dense, len(toks) AS words, {hits} FROM shape),
found AS (
  SELECT doc_id, lang, CASE WHEN latin = 0 THEN NULL WHEN {most} = 0 THEN 'en' {pick} END AS language,
    CASE WHEN latin = 0 OR words = 0 THEN 0.0 WHEN {most} = 0 THEN dense ELSE least(1.0, greatest({most}::DOUBLE / words, dense)) END AS confidence
  FROM hits
)"""


def packed(source: str, most: int, gap: int) -> str:
    """Recursive CTE ``packed`` (doc_id, idx, piece) over ``source`` (doc_id, idx, n): greedy packing of lengths."""
    return f"""
fold AS (
  SELECT doc_id, idx, n AS cur, 0 AS piece FROM {source} WHERE idx = 1
  UNION ALL
  SELECT s.doc_id, s.idx, CASE WHEN f.cur + {gap} + s.n > {most} THEN s.n ELSE f.cur + {gap} + s.n END,
    CASE WHEN f.cur + {gap} + s.n > {most} THEN f.piece + 1 ELSE f.piece END
  FROM fold f JOIN {source} s ON s.doc_id = f.doc_id AND s.idx = f.idx + 1
),
packed AS (SELECT doc_id, idx, piece FROM fold)"""


def sentence_units(paragraphs: str) -> str:
    cut = r"string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"""
paras AS (SELECT doc_id, unnest({paragraphs}) AS p, generate_subscripts({paragraphs}, 1) AS k FROM documents),
kept AS (SELECT doc_id, k, {STRIP.format('p')} AS p FROM paras),
sent AS (SELECT doc_id, k, unnest(CASE WHEN length(p) > 1800 THEN {cut} ELSE [p] END) AS unit, generate_subscripts(CASE WHEN length(p) > 1800 THEN {cut} ELSE [p] END, 1) AS j FROM kept),
clean AS (SELECT doc_id, k, j, {STRIP.format('unit')} AS unit FROM sent),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS idx, unit, length(unit) AS n FROM clean WHERE unit <> '')"""


def pieces(variant: str) -> str:
    """CTE ``pieces`` (doc_id, idx, body)."""
    most, least = {"a": (1200, 10), "b": (1200, 20), "c": (1000, 0)}[variant]
    split = r"[regexp_replace(" + STRIP.format("text") + r", '\s+', ' ', 'g')]" if variant == "a" else "string_split(text, chr(10))"
    return f"""{sentence_units(split)}, {packed('units', most, 1)},
joined AS (SELECT u.doc_id, piece, string_agg(unit, ' ' ORDER BY u.idx) AS body FROM units u JOIN packed p ON p.doc_id = u.doc_id AND p.idx = u.idx GROUP BY u.doc_id, piece),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS idx, body FROM joined WHERE length(body) >= {least})"""


_CHUNKS = f"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
placed AS (
  SELECT doc_id, k, {STRIP.format('unit')} AS unit,
    sum(length(unit) + 2) OVER (PARTITION BY doc_id ORDER BY k) - length(unit) - 2 + length(unit) - length(regexp_replace(unit, '^\\s+', '')) AS pos
  FROM raw
),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS idx, unit, length(unit) AS n, pos FROM placed WHERE unit <> ''),
{packed('units', 700, 2)},
chunks AS (
  SELECT u.doc_id, piece + 1 AS chunk_index, string_agg(unit, chr(10) || chr(10) ORDER BY u.idx) AS body, min(pos) AS start_char
  FROM units u JOIN packed p ON p.doc_id = u.doc_id AND p.idx = u.idx GROUP BY u.doc_id, piece
)"""

_SOURCES = """
src AS (
  SELECT d.doc_id, 'src_' || d.doc_id AS source_id, 'Document ' || d.doc_id AS title, CASE WHEN d.doc_id % 2 = 0 THEN 'podcast_episode' ELSE 'text_note' END AS source_type,
    d.lang AS language, d.source AS tree,
    CASE WHEN d.doc_id % 2 = 0 THEN 'https://example.org/e/' || d.doc_id || CASE WHEN d.doc_id % 3 = 0 THEN '?x=1' ELSE '' END END AS url,
    CASE l.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CASE l.quality WHEN 1 THEN 'current' WHEN 0 THEN 'legacy' END AS preference
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def stamp(ms: str) -> str:
    s = f"(({ms}) // 1000)"
    short = f"lpad((({s} // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"
    return f"CASE WHEN {s} >= 3600 THEN lpad(({s} // 3600)::VARCHAR, 2, '0') || ':' || {short} ELSE {short} END"


def label(show: str, ms: str) -> str:
    return f"CASE WHEN source_type = 'podcast_episode' THEN coalesce(nullif({show}, ''), title) || ', ' || title || ', ' || ({stamp(ms)}) ELSE title || ', chunk 1' END"


def link(ms: str) -> str:
    return f"CASE WHEN source_type = 'podcast_episode' THEN url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 't=' || (({ms}) // 1000) END"


def retimed(url: str, ms: str) -> str:
    query = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    kept = f"list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^t(=|$)'))"
    return f"regexp_extract({url}, '^[^?#]*') || '?' || array_to_string(list_append({kept}, 't=' || (({ms}) // 1000) || 's'), '&') || regexp_extract({url}, '#.*$')"


def unescaped(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def collapsed(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ \t\n\x0B\f\r\x{{A0}}]+', ' ', 'g'), '^ | $', '', 'g')"


def _html() -> str:
    cdata = r"regexp_replace(html, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g')"
    flat = collapsed(unescaped(f"regexp_replace({cdata}, '(?s)<[^>]+>', ' ', 'g')"))
    broken = rf"regexp_replace(regexp_replace({cdata}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10) || chr(10), 'g')"
    each = f"list_transform(string_split({unescaped(f'''regexp_replace({broken}, '(?s)<[^>]+>', ' ', 'g')''')}, chr(10)), lambda x: {collapsed('x')})"
    return f"""WITH t AS (SELECT page_id, {flat} AS flat, array_to_string(list_filter({each}, lambda x: x <> ''), chr(10)) AS blocks FROM pages)
SELECT page_id, length(flat) AS n_flat, md5(flat) AS flat, length(blocks) AS n_blocks, md5(blocks) AS blocks FROM t"""


_QUEUE = """
WITH e AS (
  SELECT page_id AS position, CASE WHEN page_id % 11 <> 0 THEN 'v' || (page_id % 97) END AS video_id,
    CASE WHEN page_id % 17 = 0 OR page_id % 11 = 0 THEN 'missing_video_id_or_title' WHEN page_id % 7 = 0 THEN 'video_unavailable' WHEN page_id % 13 = 0 THEN 'missing_duration' END AS first
  FROM pages
),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, first IS NULL ORDER BY position) AS nth FROM e),
f AS (SELECT position, video_id, CASE WHEN first IS NULL AND nth > 1 THEN 'duplicate_in_playlist' ELSE first END AS reason FROM r)
SELECT position, video_id, reason, CASE WHEN reason IS NULL THEN sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY position) END AS queue_number FROM f"""

_TREES = f"""
WITH rules(playlist, tree, priority) AS (VALUES {', '.join(map(str, TREE_RULES))}),
m AS (SELECT page_id AS item, unnest(CASE WHEN page_id % 9 = 0 THEN [NULL] ELSE ['p' || (page_id % 6), 'p' || (page_id % 4)] END) AS playlist FROM pages),
r AS (SELECT item, m.playlist, tree, priority FROM m LEFT JOIN rules USING (playlist)),
b AS (SELECT item, min(priority) AS best, count(playlist) AS lists FROM r GROUP BY item),
t AS (SELECT r.item, list_sort(list(DISTINCT tree)) AS trees, min(playlist) AS rule FROM r JOIN b ON b.item = r.item AND r.priority = b.best GROUP BY r.item)
SELECT b.item, CASE WHEN len(trees) = 1 THEN trees[1] ELSE 'unsorted' END AS tree,
  CASE WHEN len(trees) = 1 THEN rule WHEN trees IS NOT NULL THEN 'ambiguous:' || array_to_string(trees, '+') WHEN lists = 0 THEN 'no_playlist' ELSE 'unmapped_playlist' END AS reason
FROM b LEFT JOIN t USING (item)"""

_METRICS = f"""
WITH {batch(10)},
top AS (SELECT r.query_id, r.rank, coalesce(l.quality, 0) AS grade FROM run r LEFT JOIN labels l USING (doc_id) WHERE r.rank <= 10),
got AS (
  SELECT query_id, count(*) FILTER (grade >= 1) AS hits, min(rank) FILTER (grade >= 1) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM top GROUP BY query_id
),
best AS (SELECT quality AS grade, row_number() OVER (ORDER BY quality DESC, doc_id) AS r FROM labels WHERE quality >= 1),
ideal AS (SELECT count(*) AS total, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (r <= 10) AS idcg FROM best)
SELECT query_id, round(coalesce(hits / least(total, 10), 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg
FROM got, ideal"""

_CUES = """
WITH RECURSIVE c AS (
  SELECT conv_id AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn * 4000 AS s, turn * 4000 + 4000 AS e, length(text) AS n FROM conversations
),
fold AS (
  SELECT source, i, s AS began, n AS chars, 0 AS piece FROM c WHERE i = 1
  UNION ALL
  SELECT c.source, c.i, CASE WHEN f.chars + 1 + c.n > 400 OR c.e - f.began > 20000 THEN c.s ELSE f.began END,
    CASE WHEN f.chars + 1 + c.n > 400 OR c.e - f.began > 20000 THEN c.n ELSE f.chars + 1 + c.n END,
    CASE WHEN f.chars + 1 + c.n > 400 OR c.e - f.began > 20000 THEN f.piece + 1 ELSE f.piece END
  FROM fold f JOIN c ON c.source = f.source AND c.i = f.i + 1
)
SELECT c.source, piece AS idx, min(s) AS start_ms, max(e) AS end_ms, max(chars) AS n_chars FROM fold JOIN c ON c.source = fold.source AND c.i = fold.i GROUP BY c.source, piece"""

_SPLIT = """
WITH c AS (SELECT conv_id AS source, turn, text, turn * 4000 AS s, greatest(1, ceil(length(text) / 50.0), 1)::BIGINT AS parts FROM conversations),
w AS (SELECT *, ceil(length(text) / parts::DOUBLE)::BIGINT AS width FROM c),
p AS (SELECT *, unnest(range(parts)) AS i FROM w),
x AS (
  SELECT source, turn, i, CASE WHEN parts = 1 THEN s ELSE floor(s + 4000 * i / parts::DOUBLE)::BIGINT END AS start_ms,
    CASE WHEN parts = 1 THEN s + 4000 ELSE floor(s + 4000 * (i + 1) / parts::DOUBLE)::BIGINT END AS end_ms,
    CASE WHEN parts = 1 THEN text ELSE trim(substr(text, i * width + 1, width)) END AS body, parts
  FROM p
)
SELECT source, turn, row_number() OVER (PARTITION BY source, turn ORDER BY i) - 1 AS idx, start_ms, end_ms, body FROM x WHERE parts = 1 OR body <> ''"""

_TIMED = f"""
WITH RECURSIVE {pieces('b')},
total AS (SELECT doc_id, greatest(sum(length(body)), 1) AS chars, count(*) AS n FROM pieces GROUP BY doc_id),
run AS (SELECT doc_id, idx, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY idx) AS seen FROM pieces),
timed AS (
  SELECT r.doc_id, r.idx, 0::BIGINT AS start_ms, CASE WHEN r.idx = n.n - 1 THEN 100000 ELSE greatest(1000, floor(100000 * seen / chars::DOUBLE))::BIGINT END AS end_ms
  FROM run r JOIN total n ON n.doc_id = r.doc_id WHERE r.idx = 0
  UNION ALL
  SELECT r.doc_id, r.idx, t.end_ms, CASE WHEN r.idx = n.n - 1 THEN 100000 ELSE greatest(t.end_ms + 1000, floor(100000 * seen / chars::DOUBLE))::BIGINT END
  FROM timed t JOIN run r ON r.doc_id = t.doc_id AND r.idx = t.idx + 1 JOIN total n ON n.doc_id = r.doc_id
)
SELECT doc_id, idx, start_ms, end_ms FROM timed"""

_NEAREST = """
WITH e AS (SELECT user_id AS source, event_id AS idx, epoch_us(ts) // 1000 AS ms, event_type AS kind FROM events),
n AS (
  SELECT a.source, a.idx, arg_min(w.ms, abs(w.ms - a.ms) * 10 + CASE WHEN w.ms > a.ms THEN 1 ELSE 0 END) AS anchor_ms
  FROM e a JOIN e w ON w.source = a.source AND w.kind = 'view' AND abs(w.ms - a.ms) <= 3600000 WHERE a.kind <> 'view' GROUP BY 1, 2
)
SELECT a.source, a.idx, a.ms AS start_ms, n.anchor_ms FROM e a LEFT JOIN n USING (source, idx) WHERE a.kind <> 'view'"""


def _season() -> str:
    return "CASE " + " ".join(f"WHEN doc_id % 530 <= {b} THEN {n}" for b, n in BOUNDS) + " END"


def oracle_sql() -> dict[str, str]:
    q, tr = QUERY, TRANSLATED
    doc_vectors = hashed("text", "documents")
    asked = f"asked AS (SELECT -1 AS doc_id, '{q}' AS text)"
    from . import importing_oracle

    return importing_oracle.oracle_sql() | {
        "bm25_search": scored([bm25("b", q, "lang = 'en' OR lang IS NULL")], "b"),
        "tokenize_documents": f"WITH t AS (SELECT doc_id, {toks('text')} AS toks FROM documents) SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM t",
        "token_df_stats": f"WITH t AS (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY token",
        "bm25_filtered_lang": scored([bm25("b", tr, "lang = 'de' AND source = 'src3'")], "b"),
        "bm25_weighted": scored([bm25("b", q, weighted=True)], "b"),
        "bm25_global_stats": scored([bm25("b", q, "lang = 'en'", everywhere=True)], "b"),
        "bm25_batch_topk": f"WITH {batch(10)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM run",
        "vector_cosine_topk": scored([near("v", QUERY_VECTOR)], "v"),
        "vector_weighted_filtered": f"""WITH {_SOURCES},
w AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * weight AS score
  FROM embeddings e JOIN src ON src.doc_id = e.vec_id, embeddings q WHERE q.vec_id = {QUERY_VECTOR} AND tree IN ('src1', 'src2', 'src3'))
SELECT doc_id, round(score, 6) AS score FROM w WHERE score > 0 ORDER BY round(w.score, 9) DESC, doc_id LIMIT 10""",
        "hash_embedding_vectors": f"WITH {doc_vectors} SELECT doc_id, {', '.join(f'round(v[{i + 1}], 6) AS v{i}' for i in range(8))} FROM hashed",
        "hash_vector_search": f"WITH {asked}, {doc_vectors}, {hashed('text', 'asked').replace('normal', 'normal2').replace('signed', 'signed2').replace('lengths', 'lengths2').replace('hashed', 'hashed2')}, "
        "s AS (SELECT h.doc_id, list_cosine_similarity(h.v, a.v) AS score FROM hashed h, hashed2 a) "
        "SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(s.score, 9) DESC, doc_id LIMIT 10",
        "mixed_model_guard": scored([near("v", QUERY_VECTOR)], "v"),
        "rrf_hybrid": scored([bm25("b", q, limit=20), near("v", QUERY_VECTOR, 20), fused("h", ["b", "v"], 10)], "h", 9),
        "rrf_translated_multi_run": scored(
            [bm25("b", q, limit=40), near("v", QUERY_VECTOR, 40), fused("h", ["b", "v"], 20), bm25("b2", tr, limit=40), near("v2", TRANSLATED_VECTOR, 40), fused("h2", ["b2", "v2"], 20), fused("f", ["h", "h2"], 10)],
            "f",
            9,
        ),
        "language_detect": f"WITH {detected()} SELECT doc_id, language, round(confidence, 6) AS confidence FROM found",
        "language_confusion": f"WITH {detected()} SELECT lang, language, count(*) AS n FROM found GROUP BY 1, 2",
        "language_tagging": f"WITH {detected()} SELECT CASE WHEN confidence >= 0.4 THEN language END AS language, count(*) AS n FROM found GROUP BY 1",
        "dominant_language": "SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 1",
        "corpus_languages": "SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1",
        "language_guard_counts": "SELECT count(*) AS total, count(*) FILTER (lang = 'fr') AS matching FROM documents",
        "language_policy": """WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
d AS (SELECT (SELECT lang FROM c ORDER BY n DESC, lang LIMIT 1) AS top, (SELECT count(*) FROM documents) AS total, coalesce((SELECT n FROM c WHERE lang = 'de'), 0) AS de, coalesce((SELECT n FROM c WHERE lang = 'fr'), 0) AS fr)
SELECT 'any' AS policy, NULL::VARCHAR AS given, NULL::VARCHAR AS language, false AS undetermined
UNION ALL SELECT 'auto', NULL, CASE WHEN de = 0 OR (total >= 10 AND de < greatest(1.0, total * 0.1)) THEN top ELSE 'de' END, true FROM d
UNION ALL SELECT 'strict', NULL, CASE WHEN de = 0 THEN top ELSE 'de' END, false FROM d
UNION ALL SELECT 'auto', 'fr', CASE WHEN fr = 0 THEN top ELSE 'fr' END, true FROM d
UNION ALL SELECT 'strict', 'xx', top, false FROM d""",
        "query_language_notice": """WITH k AS (SELECT string_agg(lang, ',' ORDER BY n DESC, lang) AS known FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang))
SELECT '!!!' AS query, 'cross_language_query' AS code, NULL::VARCHAR AS query_language, known AS corpus_languages FROM k
UNION ALL SELECT 'что говорит книга об исходе', 'cross_language_query', 'ru', known FROM k
UNION ALL SELECT 'where is the book', NULL, NULL, NULL""",
        "entity_filter_semijoin": f"WITH {_SOURCES} SELECT source_id, title, language FROM src WHERE tree IN ('src3', 'src5')",
        "source_entities_listing": "SELECT 'organization' AS entity_type, source AS slug, upper(source) AS label, 'related' AS role, count(*) AS sources FROM documents GROUP BY source",
        "chunk_text": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, length(body) AS n_chars, md5(body) AS digest FROM chunks",
        "chunk_offsets": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, start_char, start_char + length(body) AS end_char FROM chunks",
        **{f"segments_variant_{v}": f"WITH RECURSIVE {pieces(v)} SELECT doc_id, idx, length(body) AS n_chars, md5(body) AS digest FROM pieces" for v in "abc"},
        "proportional_segments": _TIMED,
        "caption_cue_packing": _CUES,
        "oversized_cue_split": _SPLIT,
        "cue_clip_lead": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS start_ms FROM events) SELECT *, least(start_ms + 3600000, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), start_ms + 3600000)) AS end_ms FROM e",
        "nearest_word_anchor": _NEAREST,
        "citation_labels": f"WITH {_SOURCES} SELECT doc_id, {label('''CASE WHEN doc_id % 4 = 0 THEN '' ELSE tree END''', 'doc_id * 7000')} AS citation FROM src",
        "timestamp_urls": f"WITH {_SOURCES} SELECT doc_id, {link('doc_id * 1000')} AS link, {retimed('(url || chr(35) || chr(97))', 'doc_id * 1000')} AS replaced FROM src",
        "context_pack": f"""WITH {bm25('b', q, limit=8)}, {_SOURCES}
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, b.doc_id) AS rank, b.doc_id, title, md5(text) AS text, {label('tree', 'src.doc_id * 1000')} AS citation, {link('src.doc_id * 1000')} AS link
FROM b JOIN src ON src.doc_id = b.doc_id JOIN documents d ON d.doc_id = b.doc_id""",
        "resolve_source": f"""WITH {_SOURCES}, m AS (SELECT *, (1 + CASE WHEN doc_id = 10 THEN 11 ELSE 0 END + CASE WHEN starts_with(doc_id::VARCHAR, '10') THEN 5 ELSE 0 END)::DOUBLE AS match FROM src)
SELECT source_id, title, match, weight, preference FROM m
ORDER BY match DESC, CASE preference WHEN 'current' THEN 0 WHEN 'legacy' THEN 3 ELSE 2 END, weight DESC, title, doc_id LIMIT 1""",
        "summary_context": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, 'Document ' || doc_id AS title, chunk_index, md5(body) AS digest FROM chunks WHERE doc_id = 10 AND chunk_index <= 5",
        "html_clean": _html(),
        "link_extract": r"""WITH l AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*?href="([^"]*)"', 1))) AS f FROM pages) SELECT page_id, len(f) AS n, array_to_string(f, ' ') AS found FROM l""",
        "url_resolve": rf"""WITH p AS (SELECT page_id, url, lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) AS host,
  lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://', ''), '^[^/]*', '')) AS path FROM pages)
SELECT page_id, CASE WHEN contains(host, 'podcasts.apple.com') AND regexp_matches(path, '/id[0-9]+') THEN CASE WHEN regexp_matches(split_part(url, '#', 1), '[?&]i=[^&]') THEN 'apple_episode' ELSE 'apple_podcast' END
  WHEN ends_with(path, '.xml') OR ends_with(path, '.rss') OR ends_with(path, '/feed') OR ends_with(path, '/rss') OR contains(path, 'rss') THEN 'rss_feed' ELSE 'unknown_url' END AS kind,
  {retimed('url', 'page_id * 1500')} AS timed FROM p""",
        "slugify_titles": "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
        "durations": """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN (doc_id % 90) || ':' || (doc_id % 60) ELSE (doc_id % 24) || ':' || (doc_id % 60) || ':' || (doc_id % 59) END AS raw FROM documents)
SELECT doc_id, raw, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN doc_id WHEN 2 THEN (doc_id % 90) * 60 + doc_id % 60 ELSE ((doc_id % 24) * 60 + doc_id % 60) * 60 + doc_id % 59 END AS seconds FROM r""",
        "season_lookup": f"SELECT doc_id, {_season()} AS season FROM documents",
        "job_log_recent": "SELECT event_id AS job_id, event_type AS job_type, user_id AS owner FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
        "job_status_rollup": "SELECT event_type AS job_type, count(*) AS jobs, count(*) FILTER (value > 50) AS large, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
        "list_sources": f"WITH {_SOURCES} SELECT source_id, title, source_type FROM src ORDER BY doc_id DESC LIMIT 50",
        "point_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42",
        "reembed_diff": """WITH fresh AS (
  SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 10 <> 9
  UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 50 = 0
),
x AS (SELECT e.vec_id, f.doc_id, list_cosine_similarity(e.embedding::DOUBLE[], f.v::DOUBLE[]) AS c FROM embeddings e FULL JOIN fresh f ON e.vec_id = f.doc_id)
SELECT CASE WHEN vec_id IS NULL THEN 'created' WHEN doc_id IS NULL THEN 'orphaned' WHEN c < 0.999 THEN 'updated' ELSE 'unchanged' END AS action,
  count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS least FROM x GROUP BY 1""",
        "index_drift": """WITH i AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 1000000 FROM documents WHERE doc_id % 100 = 0)
SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM i) AS indexed,
  (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS missing, (SELECT count(*) FROM documents WHERE doc_id % 100 = 0) AS stale""",
        "dedup_first_wins": "SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations GROUP BY conv_id",
        "anti_join_missing": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "two_hop_lookup": """WITH l AS (SELECT doc_id AS key, quality || '-' || toxic AS title FROM labels), n(title, target) AS (VALUES ('1-0', 'good'), ('0-0', 'poor'))
SELECT d.doc_id AS key, l.title, n.target, CASE WHEN l.title IS NULL THEN 'no_title' WHEN n.target IS NULL THEN 'no_target' ELSE 'ok' END AS outcome
FROM documents d LEFT JOIN l ON l.key = d.doc_id LEFT JOIN n ON n.title = l.title""",
        "queue_with_reasons": _QUEUE,
        "tree_assignment": _TREES,
        "manifest_counts": "SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2",
        "keep_last_n": "SELECT doc_id, source, doc_id // 100 AS generation, dense_rank() OVER (PARTITION BY source ORDER BY doc_id // 100 DESC) <= 3 AS kept FROM documents",
        "eval_metrics": _METRICS,
        "delete_cascade": """SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)""",
        "preference_overlay": f"WITH {_SOURCES} SELECT CASE WHEN doc_id % 4 = 0 THEN 3.0 ELSE weight END::DOUBLE AS weight, CASE WHEN doc_id % 4 = 0 THEN 'current' ELSE preference END AS preference, count(*) AS n FROM src GROUP BY 1, 2",
        "ingest_notes": f"""WITH {detected()}
SELECT 'Document ' || d.doc_id AS title, 'src_' || substr(sha256('local|Document ' || d.doc_id || '|' || text), 1, 32) AS source_id,
  CASE WHEN confidence >= 0.4 THEN language END AS language, 1 AS chunk_index, length({STRIP.format('text')}) AS n_chars
FROM documents d JOIN found USING (doc_id) WHERE {STRIP.format('text')} <> ''""",
        "vtt_round_trip": "SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, turn * 4000 + 250 AS start_ms, turn * 4000 + 750 AS end_ms FROM conversations",
    }

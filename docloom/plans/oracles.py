r"""DuckDB SQL that gives the same rows as the registered queries.

Queries without an entry here run as a DataFrame only; their docstrings or tests say against what they are held.
"""

from __future__ import annotations

from docloom.plans.corpus import NOW
from docloom.plans.queries import WORDS

_CHUNKS = r"""
pieces AS (
  SELECT doc_id, coalesce(lang, 'none') AS library_id, coalesce(source, '') AS source,
    list_filter(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: length(x) > 0) AS l
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
lines AS (SELECT doc_id, library_id, source, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ordinal FROM pieces),
chunks AS (
  SELECT library_id, doc_id, doc_id * 1000000 + ordinal AS chunk_id, ordinal,
    CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN (ordinal % 7 + 1) || '.1'
      ELSE (ordinal // 10 + 1) || '.' || (ordinal % 10 + 1) END AS section,
    CASE WHEN (doc_id + ordinal) % 13 = 0 THEN '' WHEN doc_id % 7 = 0 THEN source
      WHEN doc_id % 4 = 1 THEN source || ' > Glossary > Term ' || ordinal
      ELSE source || ' > Part ' || (ordinal // 10) || ' > Item ' || (ordinal // 2) END AS heading_path,
    text,
    CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ordinal // 4 + 1 + CASE WHEN ordinal // 4 >= 3 THEN 1 ELSE 0 END END AS INTEGER) AS page_start,
    CASE WHEN ordinal % 3 = 0 THEN doc_id % 3 ELSE 0 END AS image_count,
    CASE WHEN ordinal % 17 = 5 THEN 'keyword-reference' ELSE 'prose' END AS kind
  FROM lines),
docs AS (
  SELECT library_id, doc_id, CAST(len(l) AS BIGINT) AS chunk_count,
    CAST(CASE WHEN doc_id % 3 <> 0 THEN len(l) // 4 + 3 END AS INTEGER) AS page_count,
    CASE WHEN doc_id % 11 = 0 THEN 'ingesting' ELSE 'ready' END AS status
  FROM pieces),
terms AS (
  SELECT DISTINCT library_id, doc_id, lower(regexp_extract(text, '[A-Za-z]{5,}', 0)) AS term,
    CASE WHEN doc_id % 6 = 0 THEN section || '.9' ELSE section END AS section
  FROM chunks WHERE ordinal % 7 = 3 AND section IS NOT NULL AND regexp_extract(text, '[A-Za-z]{5,}', 0) <> '')
"""
_WIDE = r"[\x{3000}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
_ATOM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_ATOMS = rf"""CAST(len(regexp_extract_all(regexp_replace(text, '{_WIDE}', ' ', 'g'), '{_ATOM}'))
  + round_even(len(regexp_extract_all(text, '{_WIDE}')) / 1.3, 0) AS BIGINT)"""
_SIZED = rf"{_CHUNKS}, sized AS (SELECT *, CAST(floor({_ATOMS} * 1.3) AS BIGINT) AS tokens FROM chunks)"


def _bm25(query: str) -> str:
    words = ", ".join(f"('{w}')" for w in dict.fromkeys(query.lower().split()))
    return rf"""{_CHUNKS},
q(term) AS (VALUES {words}),
tok AS (SELECT library_id, doc_id, chunk_id, regexp_extract_all(lower(concat_ws(' ', heading_path, heading_path, text)), '[\p{{L}}\p{{N}}_]+') AS w FROM chunks),
lib AS (SELECT library_id, count(*) AS n, avg(len(w)) AS avgdl FROM tok GROUP BY 1),
hit AS (SELECT library_id, doc_id, chunk_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM tok, q WHERE list_contains(w, term)),
df AS (SELECT library_id, term, count(*) AS df FROM hit GROUP BY 1, 2),
score AS (
  SELECT hit.library_id, doc_id, chunk_id,
    round(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25
  FROM hit JOIN df USING (library_id, term) JOIN lib USING (library_id) GROUP BY 1, 2, 3)"""


def _pooled(query: str, k: int, where: str = "TRUE") -> str:
    return rf"""{_bm25(query)},
pool AS (
  SELECT * FROM (
    SELECT s.*, c.ordinal, c.section, c.heading_path, c.kind,
      row_number() OVER (PARTITION BY s.library_id, s.doc_id ORDER BY bm25, s.chunk_id) AS pool_rank
    FROM score s JOIN chunks c USING (library_id, doc_id, chunk_id) JOIN docs d USING (library_id, doc_id)
    WHERE d.status = 'ready' AND ({where})) WHERE pool_rank <= {4 * k})"""


def _ranked(query: str, k: int, where: str = "TRUE", boost: bool = False, penalty: bool = True) -> str:
    marks = "FALSE"
    extra = ""
    if boost:
        held = " OR ".join(f"contains(term, '{w}')" for w in dict.fromkeys(query.split()) if len(w) >= 3)
        extra = f", wanted AS (SELECT DISTINCT library_id, doc_id, section FROM terms WHERE {held})"
        marks = """EXISTS (SELECT 1 FROM wanted w WHERE w.library_id = pool.library_id AND w.doc_id = pool.doc_id
          AND (pool.section = w.section OR starts_with(pool.section, w.section || '.')))"""
    add = "CASE WHEN kind = 'keyword-reference' THEN 6.0 ELSE 0.0 END" if penalty else "0.0"
    return rf"""{_pooled(query, k, where)}{extra},
marked AS (SELECT *, {marks} AS matched_book_index FROM pool),
adj AS (SELECT *, round(bm25 + CASE WHEN matched_book_index THEN -2.0 ELSE 0.0 END + {add}, 6) AS adjusted FROM marked),
ranked AS (
  SELECT *, round(greatest(-adjusted, 0.0) / (greatest(-adjusted, 0.0) + 10.0), 6) AS relevance FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY library_id, doc_id ORDER BY adjusted, pool_rank) AS INTEGER) AS doc_rank FROM adj)
  WHERE doc_rank <= {k})"""


def _search(query: str, k: int, where: str = "TRUE", penalty: bool = True) -> str:
    return f"""WITH {_ranked(query, k, where, penalty=penalty)},
best AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_rank, adjusted, library_id, doc_id) AS INTEGER) AS rank FROM ranked)
SELECT library_id, doc_id, chunk_id, adjusted, doc_rank, relevance, rank FROM best WHERE rank <= {k}"""


_FINDINGS = rf"""{_SIZED},
facts AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (tokens > 1200) AS over,
    count(*) FILTER (NOT (image_count > 0 AND tokens < 40) AND section IS NULL) AS population,
    count(*) FILTER (NOT (image_count > 0 AND tokens < 40) AND section IS NULL AND tokens < 100) AS fragments,
    max(len(string_split(heading_path, ' > '))) AS deepest,
    count(*) FILTER (image_count > 0 AND tokens < 40) AS figures
  FROM sized GROUP BY 1 HAVING count(*) >= 25),
paths AS (SELECT doc_id, count(*) AS paths, max(n) AS largest FROM (SELECT doc_id, heading_path, count(*) AS n FROM chunks GROUP BY 1, 2) GROUP BY 1),
found AS (
  SELECT doc_id, 'oversized' AS code, CASE WHEN over / n >= 0.35 THEN 'unusable' WHEN over / n >= 0.10 THEN 'degraded' END AS severity FROM facts
  UNION ALL SELECT doc_id, 'fragmented', CASE WHEN population >= 25 THEN CASE WHEN fragments / population >= 0.60 THEN 'unusable' WHEN fragments / population >= 0.30 THEN 'degraded' END END FROM facts
  UNION ALL SELECT doc_id, 'flat_hierarchy', CASE WHEN n >= 50 AND deepest <= 1 THEN 'degraded' END FROM facts
  UNION ALL SELECT doc_id, 'figure_dominated', CASE WHEN figures / n >= 0.25 THEN 'degraded' END FROM facts
  UNION ALL SELECT doc_id, 'unaddressable', CASE WHEN largest / n >= 0.50 OR paths / n < 0.50 THEN CASE WHEN paths / n < 0.35 THEN 'unusable' ELSE 'degraded' END END FROM facts JOIN paths USING (doc_id)
  UNION ALL SELECT DISTINCT doc_id, 'boilerplate', 'degraded' FROM (
    SELECT doc_id, key, count(DISTINCT chunk_id) AS times FROM line_keys GROUP BY 1, 2) JOIN facts USING (doc_id) WHERE times >= greatest(8, floor(n * 0.25))),
findings AS (SELECT * FROM found WHERE severity IS NOT NULL)"""
_LINES = r"""line_keys AS (
  SELECT library_id, doc_id, chunk_id, regexp_replace(regexp_replace(trim(text, E' \t\r\f\v'), '[\t\n\f\r ]+', ' ', 'g'), '[0-9]+', '#', 'g') AS key
  FROM chunks WHERE length(trim(text, E' \t\r\f\v')) BETWEEN 20 AND 120 AND regexp_matches(text, '[\p{L}\p{Nl}\p{No}]'))"""
_FINDINGS = _FINDINGS.replace(",\nfacts AS", f",\n{_LINES},\nfacts AS", 1)

_FOOTED = _CHUNKS.replace("\n    text,", "\n    CASE WHEN ordinal % 2 = 0 THEN 'Printed for the reader, page ' || ordinal || ' of the manual' ELSE text END AS text,", 1)
_ENLARGED = _FINDINGS.replace(" AS tokens FROM chunks)", " * CASE WHEN doc_id % 10 = 3 THEN 50 ELSE 1 END AS tokens FROM chunks)", 1)

_ACCESS = """
libraries AS (
  SELECT n_nationkey AS library_id, CASE WHEN n_nationkey % 6 <> 5 THEN lower(n_name) END AS slug, CAST(n_nationkey * 3 AS BIGINT) AS owner_id, n_nationkey % 10 = 7 AS deleted FROM nation),
grants AS (SELECT c_nationkey AS library_id, c_custkey AS user_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS rank FROM customer),
members AS (SELECT DISTINCT o_orderkey % 20 AS group_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 5 = 0),
group_grants AS (SELECT DISTINCT s_suppkey % 20 AS group_id, s_nationkey AS library_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS rank FROM supplier),
roles AS (
  SELECT user_id, library_id, max(rank) AS rank FROM (
    SELECT user_id, library_id, rank FROM grants UNION ALL SELECT user_id, library_id, rank FROM members JOIN group_grants USING (group_id)) GROUP BY 1, 2)
"""
_ROLE = "CASE rank WHEN 1 THEN 'reader' WHEN 2 THEN 'editor' ELSE 'admin' END"
_NOW = NOW.replace("TIMESTAMP_NTZ", "TIMESTAMP")
_JOBS = """
jobs AS (
  SELECT event_id AS id, CAST(user_id % 25 AS INTEGER) AS library_id, user_id AS requested_by, 'src-' || (user_id % 40) || '-' || (event_id % 50) AS source,
    (['queued', 'running', 'done', 'failed', 'cancelled'])[event_id % 5 + 1] AS status, event_id % 4 AS attempts, event_id % 17 = 0 AS cancel_req,
    ts AS created_at, ts + INTERVAL 1 HOUR AS updated_at, CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 300 SECOND END AS lease_until,
    event_id % 90 AS cur, event_id % 100 AS total
  FROM events)
"""
_CLAIMABLE = f"(status = 'queued' OR (status = 'running' AND lease_until < {_NOW})) AND attempts < 3 AND NOT cancel_req"

#: The path of a normal URL: dot segments taken out one after the other.
_URL = r"""
parts AS (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 1)) AS scheme,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 2)) AS host,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS path,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 4) AS query
  FROM pages),
normal AS (
  SELECT page_id, CASE WHEN scheme = '' THEN NULL ELSE scheme || '://'
    || CASE scheme WHEN 'http' THEN regexp_replace(host, ':(80)?$', '') WHEN 'https' THEN regexp_replace(host, ':(443)?$', '') ELSE host END
    || CASE WHEN path = '' THEN '/' ELSE path END || query END AS normal
  FROM parts)
"""


def oracle_sql() -> dict[str, str]:
    out = {
        "bm25_topk": _search(WORDS, 10),
        "bm25_pool": f"WITH {_pooled(WORDS, 2)} SELECT library_id, doc_id, chunk_id, bm25, CAST(pool_rank AS INTEGER) AS pool_rank FROM pool",
        "bm25_interleave": f"WITH {_ranked(WORDS, 3)} SELECT library_id, doc_id, chunk_id, adjusted, doc_rank, relevance FROM ranked",
        "bm25_per_library": f"WITH {_bm25(WORDS)} SELECT library_id, term, df, n AS chunks, round(avgdl, 6) AS mean_length FROM df JOIN lib USING (library_id)",
        "search_section_filter": _search(WORDS, 20, "heading_path = 'src8' OR starts_with(heading_path, 'src8 > ')"),
        "search_one_document": _search(WORDS, 10, "doc_id = 1"),
        "search_libraries": _search(WORDS, 10, "library_id IN ('de', 'none')"),
        "read_passages": f"WITH {_CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE ordinal BETWEEN 2 AND 41",
        "best_overlap": f"""WITH {_CHUNKS}, f AS (SELECT doc_id, heading_path, ordinal, CAST(len(list_filter({WORDS.split()}, lambda t: contains(lower(concat_ws(' ', heading_path, text)), t))) AS INTEGER) AS found FROM chunks)
            SELECT doc_id, heading_path, found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY found DESC, ordinal) AS r FROM f) WHERE r = 1""",
        "library_lists": f"""WITH {_ACCESS}, h AS (SELECT user_id, library_id FROM roles JOIN libraries USING (library_id) WHERE NOT deleted AND rank >= 2)
            SELECT c_custkey AS user_id, coalesce(string_agg(CAST(library_id AS VARCHAR), ',' ORDER BY library_id), '') AS libraries FROM customer LEFT JOIN h ON user_id = c_custkey GROUP BY 1""",
        "job_notes": f"""WITH {_JOBS} SELECT id, CASE WHEN total > 0 THEN cur || '/' || total || ' (' || CAST(round_even(100.0 * cur / total, 0) AS BIGINT) || '%)' ELSE '' END AS progress,
            CASE WHEN status = 'failed' THEN CASE WHEN id % 3 = 0 THEN 'permanent' ELSE 'exhausted' END END AS disposition FROM jobs""",
        "search_index_boost": f"WITH {_ranked('the thent ention', 3, boost=True)} SELECT doc_id, chunk_id, bm25, matched_book_index, adjusted, doc_rank FROM ranked",
        "search_keyword_penalty": _search(WORDS, 25),
        "search_keyword_included": _search(WORDS, 25, penalty=False),
        "token_estimate": rf"""WITH {_CHUNKS} SELECT chunk_id, {_ATOMS} AS atoms, CAST(floor({_ATOMS} * 1.3) AS BIGINT) AS tokens,
            CAST(floor(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]')) * 1.3) AS BIGINT) AS query_tokens FROM chunks""",
        "script_share": r"""SELECT doc_id, round(CASE WHEN len(regexp_extract_all(t, '\p{L}')) > 0
            THEN len(regexp_extract_all(t, '[\x{0370}-\x{03ff}\x{0400}-\x{04ff}\x{0530}-\x{058f}\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{0e00}-\x{0e7f}\x{10a0}-\x{10ff}]'))
              / len(regexp_extract_all(t, '\p{L}')) ELSE 0.0 END, 9) AS share
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL)""",
        "outline": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, ordinal, chunk_id, string_split(heading_path, ' > ') AS parts FROM chunks WHERE heading_path <> ''),
            e AS (SELECT doc_id, ordinal, chunk_id, len(parts) AS whole, parts, unnest(range(1, least(len(parts), 2) + 1)) AS level FROM p),
            h AS (SELECT *, array_to_string(parts[1:level], ' > ') AS heading FROM e),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY ordinal, level) AS n FROM h)
            SELECT doc_id, ordinal, CAST(level AS INTEGER) AS level, heading, CASE WHEN level = whole THEN chunk_id END AS chunk_id FROM r WHERE n = 1""",
        "context_span": f"""WITH {_CHUNKS}, a AS (SELECT doc_id, CAST(chunk_count // 2 AS INTEGER) AS anchor FROM docs WHERE chunk_count > 3)
            SELECT doc_id, anchor, ordinal, chunk_id FROM chunks JOIN a USING (doc_id) WHERE ordinal BETWEEN anchor - 2 AND anchor + 3""",
        "context_trim": rf"""WITH {_CHUNKS}, a AS (SELECT doc_id, CAST(chunk_count // 2 AS INTEGER) AS anchor FROM docs WHERE chunk_count > 3),
            s AS (SELECT doc_id, anchor, ordinal, CAST(floor(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]')) * 1.3) AS BIGINT) AS tokens
              FROM chunks JOIN a USING (doc_id) WHERE ordinal BETWEEN anchor - 10 AND anchor + 10),
            f AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id, anchor ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM s),
            k AS (SELECT * FROM f WHERE ordinal >= anchor OR suffix <= 120),
            b AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id, anchor ORDER BY ordinal) AS prefix FROM k)
            SELECT doc_id, anchor, ordinal, tokens FROM b WHERE ordinal <= anchor OR prefix <= 120""",
        "top_headings": f"""WITH {_CHUNKS}, t AS (SELECT doc_id, string_split(heading_path, ' > ')[1] AS heading, min(ordinal) AS first FROM chunks WHERE heading_path <> '' GROUP BY 1, 2)
            SELECT doc_id, heading, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, heading) AS INTEGER) AS place FROM t) WHERE place <= 15""",
        "stride_sample": f"""WITH {_CHUNKS} SELECT doc_id, chunk_id, place FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS INTEGER) AS place FROM chunks) WHERE place % 7 = 0""",
        "section_covers": f"""WITH {_CHUNKS}, r AS (SELECT DISTINCT doc_id, split_part(section, '.', 1) AS reference FROM chunks WHERE section IS NOT NULL)
            SELECT doc_id, reference, chunk_id FROM chunks JOIN r USING (doc_id) WHERE section = reference OR starts_with(section, reference || '.')""",
        "unjoinable_sections": f"""WITH {_CHUNKS} SELECT DISTINCT doc_id, section FROM terms t WHERE NOT EXISTS (
            SELECT 1 FROM chunks c WHERE c.doc_id = t.doc_id AND (c.section = t.section OR starts_with(c.section, t.section || '.')))""",
        "page_range": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, page_start AS page, TRUE AS truncated FROM chunks WHERE page_start BETWEEN 2 AND 21",
        "token_spread": f"""WITH {_SIZED}, t AS (SELECT doc_id, list_sort(list(tokens)) AS t, sum(tokens) AS total, count(*) AS n FROM sized GROUP BY 1)
            SELECT doc_id, t[1] AS token_min, t[CAST(least(n - 1, floor(n * 0.5)) AS BIGINT) + 1] AS token_median, t[CAST(least(n - 1, floor(n * 0.95)) AS BIGINT) + 1] AS token_p95,
              t[-1] AS token_max, CAST(floor(total / n) AS BIGINT) AS token_mean, CAST(total AS BIGINT) AS total_tokens FROM t""",
        "extremes": f"""WITH {_SIZED},
            a AS (SELECT doc_id, 'longest' AS "end", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, ordinal DESC) AS INTEGER) AS place, ordinal, tokens FROM sized),
            b AS (SELECT doc_id, 'shortest' AS "end", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tokens, ordinal) AS INTEGER) AS place, ordinal, tokens FROM sized)
            SELECT * FROM a WHERE place <= 10 UNION ALL SELECT * FROM b WHERE place <= 10""",
        "ordinal_gaps": f"""WITH {_CHUNKS}, c AS (SELECT doc_id, ordinal, lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS b FROM (SELECT doc_id, ordinal + ordinal // 11 AS ordinal FROM chunks))
            SELECT doc_id, CAST(b + 1 AS INTEGER) AS missing FROM c WHERE ordinal <> b + 1""",
        "scattered_sections": f"WITH {_CHUNKS} SELECT doc_id, section FROM chunks WHERE section IS NOT NULL GROUP BY 1, 2 HAVING max(ordinal) - min(ordinal) + 1 <> count(*)",
        "uncovered_pages": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page FROM docs WHERE page_count > 0)
            SELECT doc_id, page FROM p ANTI JOIN (SELECT doc_id, page_start AS page FROM chunks WHERE page_start IS NOT NULL) c USING (doc_id, page)""",
        "measures": f"""WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks, count(*) FILTER (image_count > 0) AS with_images, count(*) FILTER (heading_path = '') AS headless,
            count(*) FILTER (page_count IS NOT NULL AND page_start IS NULL) AS missing_locator FROM chunks JOIN docs USING (doc_id) GROUP BY 1""",
        "section_counts": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, heading_path, count(*) AS n, min(ordinal) AS first FROM chunks GROUP BY 1, 2)
            SELECT doc_id, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(CASE WHEN trim(heading_path) = '' THEN n ELSE 0 END) AS BIGINT) AS headless, count(*) AS paths,
              first(heading_path ORDER BY n DESC, first) AS largest, max(n) AS largest_size FROM p GROUP BY 1""",
        "verdict": f"""WITH {_FINDINGS}, w AS (SELECT doc_id, max(CASE WHEN severity = 'unusable' THEN 2 ELSE 1 END) AS worst FROM findings GROUP BY 1)
            SELECT doc_id, CASE WHEN worst = 2 OR chunk_count = 0 THEN 'unusable' WHEN worst = 1 THEN 'degraded' ELSE 'good' END AS verdict FROM docs LEFT JOIN w USING (doc_id)""",
        "grade_boilerplate": f"""WITH {_FOOTED}, {_LINES}, n AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1),
            t AS (SELECT doc_id, key AS line_key, count(DISTINCT chunk_id) AS times FROM line_keys GROUP BY 1, 2)
            SELECT doc_id, line_key, times FROM t JOIN n USING (doc_id) WHERE times >= greatest(8, floor(chunks * 0.25))""",
        "classify_kinds": rf"""WITH {_CHUNKS}, f AS (
              SELECT doc_id, chunk_id, CASE WHEN len(string_split(heading_path, ' > ')) > 2 AND string_split(heading_path, ' > ')[2] = 'Glossary' THEN string_split(heading_path, ' > ')[1] || ' > Glossary' END AS family,
                len(regexp_extract_all(string_split(heading_path, ' > ')[-1], '[\p{{L}}\p{{Nl}}\p{{No}}]+')) <= 4 AS short FROM chunks),
            g AS (SELECT doc_id, family FROM f WHERE family IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30 AND count(*) FILTER (short) / count(*) >= 0.6)
            SELECT chunk_id, CASE WHEN g.family IS NULL THEN 'prose' ELSE 'keyword-reference' END AS kind FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.family = g.family""",
        "block_groups": f"""WITH {_CHUNKS}, s AS (SELECT doc_id, ordinal, CASE WHEN row_number() OVER w > 1 AND section IS NOT DISTINCT FROM lag(section) OVER w
              AND heading_path IS NOT DISTINCT FROM lag(heading_path) OVER w THEN 0 ELSE 1 END AS starts FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
            u AS (SELECT doc_id, ordinal, sum(starts) OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS unit FROM s)
            SELECT doc_id, CAST(unit AS BIGINT) AS unit, min(ordinal) AS first, count(*) AS blocks FROM u GROUP BY 1, 2""",
        "readable_libraries": f"""WITH {_ACCESS}, r AS (SELECT user_id, library_id, slug, coalesce(owner_id = user_id, FALSE) AS own, {_ROLE} AS role FROM roles JOIN libraries USING (library_id) WHERE NOT deleted)
            SELECT user_id, library_id, CASE WHEN own THEN 'personal' ELSE coalesce(slug, CAST(library_id AS VARCHAR)) END AS label, role,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY own DESC, slug NULLS LAST, library_id) AS INTEGER) AS place FROM r""",
        "waiting_queues": f"""WITH {_ACCESS}, {_JOBS} SELECT DISTINCT j.library_id, j.requested_by FROM jobs j
            JOIN roles r ON r.library_id = j.library_id AND r.user_id = j.requested_by AND r.rank >= 2 JOIN libraries l ON l.library_id = j.library_id AND NOT deleted WHERE {_CLAIMABLE}""",
        "audit_listing": """SELECT e.event_id, coalesce(a.c_name, 'was-' || e.user_id, '') AS actor, e.event_type AS action,
            coalesce(s.c_name, CASE WHEN e.event_id % 3 = 0 THEN 'gone-' || (e.event_id % 50) END, '') AS subject
            FROM events e LEFT JOIN customer a ON a.c_custkey = e.user_id LEFT JOIN customer s ON s.c_custkey = CASE WHEN e.event_id % 4 <> 0 THEN e.event_id * 7 % 3000 END""",
        "members_listing": f"""WITH {_ACCESS}, e AS (SELECT library_id, user_id, rank, FALSE AS invited FROM grants
              UNION ALL SELECT DISTINCT library_id, group_id, rank, TRUE FROM group_grants)
            SELECT library_id, c_name AS username, {_ROLE} AS role, invited,
              CAST(row_number() OVER (PARTITION BY library_id ORDER BY invited, rank DESC, c_name) AS INTEGER) AS place FROM e JOIN customer ON c_custkey = user_id""",
        "group_sizes": f"WITH {_ACCESS}, g AS (SELECT range AS group_id FROM range(25)) SELECT g.group_id, 'g' || g.group_id AS slug, count(m.user_id) AS members FROM g LEFT JOIN members m USING (group_id) GROUP BY 1",
        "last_admin": f"""WITH {_ACCESS} SELECT library_id, min(user_id) AS user_id FROM (
            SELECT library_id, user_id FROM grants WHERE rank = 3 AND library_id % 2 = 0 UNION ALL SELECT library_id, owner_id FROM libraries) GROUP BY 1 HAVING count(*) = 1""",
        "deleted_libraries": f"""WITH {_ACCESS}, gone AS (SELECT library_id, slug, library_id * 2 AS by_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (library_id - 7) AS deleted_at FROM libraries WHERE deleted)
            SELECT g.user_id, library_id, slug, deleted_at, deleted_at + INTERVAL 14 DAY AS purge_at, coalesce(c_name, '') AS deleted_by
            FROM gone JOIN grants g USING (library_id) LEFT JOIN customer ON c_custkey = by_id WHERE g.rank = 3 AND deleted_at >= {_NOW} - INTERVAL 14 DAY""",
        "purged_jobs": f"""WITH {_ACCESS}, {_JOBS} SELECT id, library_id FROM jobs WHERE library_id NOT IN (
            SELECT library_id FROM libraries WHERE deleted AND TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (library_id - 7) < {_NOW} - INTERVAL 14 DAY)""",
        "resolved_ids": f"""WITH {_ACCESS}, readable AS (
              SELECT r.user_id, l.library_id, CASE WHEN owner_id = r.user_id THEN 'personal' ELSE coalesce(slug, CAST(l.library_id AS VARCHAR)) END AS label FROM roles r JOIN libraries l USING (library_id) WHERE NOT deleted),
            asked AS (SELECT c_custkey AS user_id, unnest(['d' || c_custkey, coalesce(slug, CAST(library_id AS VARCHAR)) || '/a/' || c_custkey, 'personal/' || c_custkey]) AS asked FROM customer JOIN libraries ON library_id = c_nationkey)
            SELECT a.user_id, asked, library_id, CASE WHEN contains(asked, '/') THEN substr(asked, strpos(asked, '/') + 1) ELSE asked END AS doc_id
            FROM asked a JOIN readable r ON r.user_id = a.user_id AND r.label = CASE WHEN contains(asked, '/') THEN split_part(asked, '/', 1) ELSE 'personal' END""",
        "active_jobs": f"WITH {_JOBS} SELECT id, library_id, status FROM jobs WHERE status IN ('queued', 'running')",
        "recent_jobs": f"WITH {_JOBS} SELECT id, status FROM jobs ORDER BY (status IN ('queued', 'running')) DESC, updated_at DESC, id DESC LIMIT 25",
        "unclaimable_jobs": f"""WITH {_ACCESS}, {_JOBS} SELECT j.id, 'failed' AS status, TRUE AS permanent FROM jobs j
            WHERE (status = 'queued' OR (status IN ('running', 'cancelling') AND lease_until < {_NOW})) AND NOT EXISTS (
              SELECT 1 FROM roles r JOIN libraries l USING (library_id) WHERE NOT deleted AND r.rank >= 2 AND r.user_id = j.requested_by AND l.library_id = j.library_id)""",
        "heading_contains": f"WITH {_CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE contains(lower(heading_path), 'glossary > term 1')",
        "doc_prefix": f"WITH {_CHUNKS} SELECT doc_id, source || '/' || doc_id AS title, status FROM docs JOIN pieces USING (doc_id) WHERE starts_with(source || '/' || doc_id, 'src1/1')",
        "display_text": r"""SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS title_sha256,
            substr(coalesce(text, ''), 1, 60) AS head, format('{:,}', length(coalesce(text, '')) * 1000) AS shown,
            CAST(CAST(round_even((doc_id % 201) / 200.0 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM documents WHERE doc_id IS NOT NULL""",
        "round_three": """SELECT l_orderkey, l_linenumber, CAST(format('{:.3f}', CAST(l_orderkey AS DOUBLE) / 16) AS DOUBLE) AS a,
            CAST(format('{:.3f}', (CAST(l_orderkey AS DOUBLE) * 10 + 5) / 10000) AS DOUBLE) AS b,
            CAST(format('{:.3f}', CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS c FROM lineitem""",
        "claim_order": f"WITH {_JOBS} SELECT library_id, requested_by, id, CAST(row_number() OVER (PARTITION BY library_id, requested_by ORDER BY created_at, id) AS INTEGER) AS place FROM jobs WHERE {_CLAIMABLE}",
        "queue_position": f"WITH {_JOBS} SELECT id, count(*) OVER (PARTITION BY library_id ORDER BY id) AS position FROM jobs WHERE status IN ('queued', 'running')",
        "swept_jobs": f"WITH {_JOBS} SELECT id, CASE WHEN cancel_req THEN 'cancelled' ELSE 'failed' END AS status FROM jobs WHERE status = 'running' AND lease_until < {_NOW} AND (cancel_req OR attempts >= 3)",
        "job_status": f"""WITH {_JOBS} SELECT id, status, CASE WHEN total > 0 THEN CAST(floor(100 * cur / total) AS INTEGER) END AS percent,
            coalesce(status = 'running' AND lease_until < {_NOW}, FALSE) AS stalled,
            CAST(floor((epoch_us(CASE WHEN status IN ('queued', 'running') THEN {_NOW} ELSE updated_at END) - epoch_us(created_at)) / 1000000) AS BIGINT) AS elapsed_seconds FROM jobs""",
        "latest_job": f"WITH {_JOBS} SELECT source, id, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS n FROM jobs) WHERE n = 1",
        "sync_plan": f"""WITH {_JOBS},
            shown AS (SELECT * FROM (SELECT 'src-' || (o_orderkey % 40) || '-' || (o_orderkey % 50) AS source, max(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (o_orderkey % 25)) AS modified FROM orders GROUP BY 1) WHERE length(source) % 2 = 0),
            held AS (SELECT source, max(updated_at) AS ingested_at FROM jobs WHERE status = 'done' GROUP BY 1),
            latest AS (SELECT source, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS n FROM jobs) WHERE n = 1),
            r AS (SELECT coalesce(s.source, h.source) AS source, s.source IS NOT NULL AS shown, modified, ingested_at FROM shown s FULL JOIN held h ON s.source = h.source)
            SELECT r.source, CASE WHEN shown AND (coalesce(status IN ('queued', 'running'), FALSE) OR coalesce(status = 'failed' AND updated_at >= modified, FALSE) OR coalesce(ingested_at >= modified, FALSE)) THEN 'skip'
              WHEN shown THEN 'push' WHEN coalesce(status IN ('queued', 'running'), FALSE) THEN 'skip' ELSE 'retire' END AS action FROM r LEFT JOIN latest l ON l.source = r.source""",
        "url_normalise": f"WITH {_URL} SELECT page_id, normal FROM normal",
        "coverage_union": f"""WITH {_URL}, u AS (SELECT normal AS url, page_id AS place, 0 AS source FROM normal WHERE page_id % 3 = 0 UNION ALL SELECT normal, page_id, 1 FROM normal WHERE page_id % 2 = 0 UNION ALL SELECT normal, page_id, 2 FROM normal)
            SELECT url, source, place FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, place) AS n FROM u) WHERE n = 1""",
        "site_chrome": r"""WITH b AS (SELECT url, unnest(list_concat(regexp_extract_all(html, '<(?:a|div)[^>]*>([^<]+)</', 1), [' All  Pages', 'Over ' || regexp_extract(url, '^[a-z]+')])) AS t FROM pages),
            k AS (SELECT DISTINCT url, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS block_key FROM b), n AS (SELECT count(DISTINCT url) AS n FROM b)
            SELECT 'site' AS library_id, block_key, count(*) AS pages FROM k, n WHERE length(block_key) BETWEEN 1 AND 200 GROUP BY block_key, n HAVING n >= 5 AND count(*) >= greatest(5, floor(n * 0.5))""",
        "soft404_resemblance": r"""WITH a AS (SELECT k, token, count(*) AS n FROM (SELECT doc_id AS k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1, 2),
            b AS (SELECT k, token, count(*) AS n FROM (SELECT item_id AS k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
            s AS (SELECT a.k AS doc_id, b.k AS item_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (token) GROUP BY 1, 2)
            SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, round(shared / greatest(x.n, y.n), 6) AS resembles FROM s
            JOIN (SELECT k, sum(n) AS n FROM a GROUP BY 1) x ON x.k = doc_id JOIN (SELECT k, sum(n) AS n FROM b GROUP BY 1) y ON y.k = item_id""",
        "digest_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS holder, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "text_blocks": r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
            e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM p),
            o AS (SELECT doc_id, t, n, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM e)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS block_no, "offset", length(t) AS chars FROM o WHERE regexp_matches(t, '[^\s]')""",
        "recall_at_k": """WITH h AS (SELECT doc_id % 7 AS doc_id, 'c' || quality AS category, toxic = 1 AS blind, CASE WHEN doc_id % 30 < 20 THEN doc_id % 30 + 1 END AS rank FROM labels WHERE doc_id IS NOT NULL),
            g AS (SELECT 'all' AS grouping, '' AS value, rank FROM h UNION ALL SELECT 'blind', '', rank FROM h WHERE blind UNION ALL SELECT 'category', category, rank FROM h UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), rank FROM h)
            SELECT grouping, value, count(*) AS queries, """
        + ", ".join(f"round(avg(CASE WHEN rank <= {d} THEN 1.0 ELSE 0.0 END), 6) AS recall_{d}" for d in (1, 3, 8, 20))
        + " FROM g GROUP BY 1, 2",
        "self_label": rf"""WITH {_CHUNKS}, s AS (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS INTEGER) AS place, string_split(heading_path, ' > ')[-1] AS leaf, text FROM chunks),
            w AS (SELECT chunk_id, place, leaf, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS body, regexp_extract_all(lower(leaf), '[\p{{L}}\p{{N}}_]+') AS head FROM s WHERE place % 9 = 0),
            x AS (SELECT chunk_id, head, unnest(body) AS t, generate_subscripts(body, 1) AS n FROM w),
            f AS (SELECT chunk_id, t, min(n) AS n FROM x WHERE strlen(t) >= 5 AND NOT list_contains(head, t) GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY strlen(t) DESC, n) AS k FROM f),
            j AS (SELECT chunk_id, string_agg(t, ' ' ORDER BY k) AS q FROM r WHERE k <= 4 GROUP BY 1)
            SELECT w.chunk_id, w.place, trim(concat(w.leaf, ' ', coalesce(j.q, ''))) AS query FROM w LEFT JOIN j USING (chunk_id)""",
        "index_share": f"""WITH {_CHUNKS}, p AS (SELECT library_id, doc_id, count(*) AS n FROM chunks GROUP BY 1, 2)
            SELECT library_id, doc_id, round(n / sum(n) OVER (PARTITION BY library_id), 9) AS share FROM p""",
    }
    # the same over whole tables
    top = out["top_headings"].removeprefix(f"WITH {_CHUNKS}, ")
    out["list_documents"] = f"""WITH {_CHUNKS}, top AS (WITH {top}), h AS (SELECT doc_id, string_agg(heading, '; ' ORDER BY place) AS headings FROM top GROUP BY 1)
        SELECT p.library_id, p.doc_id, source || '/' || p.doc_id AS title, chunk_count, coalesce(headings, '') AS headings
        FROM docs JOIN pieces p USING (doc_id) LEFT JOIN h ON h.doc_id = p.doc_id WHERE status = 'ready'"""
    part = lambda name, prefix: out[name].removeprefix(f"WITH {prefix}").lstrip(", ")
    sub = lambda name, prefix: (lambda q: f"(WITH {q})" if not q.lstrip().upper().startswith("SELECT") else f"({q})")(part(name, prefix))
    counts = "".join(
        f" LEFT JOIN (SELECT doc_id, count(*) AS {alias} FROM {sub(name, _CHUNKS)} GROUP BY 1) {alias}_t USING (doc_id)"
        for name, alias in (("scattered_sections", "scattered"), ("uncovered_pages", "uncovered_pages"), ("unjoinable_sections", "unjoinable"))
    )
    out["verify"] = f"""WITH {_FINDINGS}, spread AS {sub("token_spread", _SIZED)}, judged AS {sub("verdict", _FINDINGS)}
        SELECT doc_id, status, chunk_count, token_median, token_p95, token_mean, CAST(0 AS BIGINT) AS ordinal_gaps, coalesce(scattered, 0) AS scattered,
          coalesce(uncovered_pages, 0) AS uncovered_pages, coalesce(unjoinable, 0) AS unjoinable, coalesce(found_n, 0) AS findings, verdict
        FROM docs LEFT JOIN spread USING (doc_id){counts} LEFT JOIN (SELECT doc_id, count(*) AS found_n FROM findings GROUP BY 1) f USING (doc_id) JOIN judged USING (doc_id)"""
    out["grouped_results"] = f"""SELECT library_id, doc_id, min(rank) AS best, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids
        FROM ({_search(WORDS, 40)}) GROUP BY 1, 2"""
    for name, code in (("oversized", "oversized"), ("fragmented", "fragmented"), ("flat", "flat_hierarchy"), ("figure", "figure_dominated"), ("unaddressable", "unaddressable")):
        out[f"grade_{name}"] = f"WITH {_ENLARGED if name == 'oversized' else _FINDINGS} SELECT * FROM findings WHERE code = '{code}'"
    return out

"""DuckDB SQL for the catalogue's queries, written apart from the operators."""

from __future__ import annotations

from ..functions.text import ERROR_KEYWORDS, MARKER, MEDIUM_KEYWORDS

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_QUERY = "the and of tion with the reading"
_RATIONAL = "((x*x*x + 6*x + 12) / (x*x*x + 12*x + 48))"


def _corpus(table: str, key: str) -> str:
    """p (doc, term, tf), d (doc, dl), c (n, average), t (term statistics) and the largest weight m."""
    words = _WORDS.format("coalesce(text, '')")
    return f"""
w AS (SELECT {key} AS doc, unnest({words}) AS term FROM {table}),
p AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT {key} AS doc, CAST(len({words}) AS BIGINT) AS dl FROM {table}),
c AS (SELECT count(*) AS n, avg(dl) AS average FROM d),
x AS (SELECT term, tf, least(8.0, tf)::DOUBLE AS x FROM p),
y AS (SELECT term, tf, {_RATIONAL} AS m FROM x),
g AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, var_pop(tf) AS v, sum(m) AS s FROM y GROUP BY term),
e AS (SELECT y.term, -sum((m / s) * ln(m / s)) AS h FROM y JOIN g USING (term) GROUP BY y.term),
i AS (SELECT g.term, df, cf, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf,
      CASE WHEN df < 2 THEN 1.0 WHEN v / (v + 1) < 0.001 THEN 1 - df / n::DOUBLE
           ELSE v / (v + 1) * greatest(0.0, 1 - least(h / ln(df), 1.0)) + (1 - v / (v + 1)) * (1 - df / n::DOUBLE) END AS info
      FROM g JOIN e USING (term), c),
t AS (SELECT term, df, cf, idf, info, idf / max(idf) OVER () AS gamma, idf * (1 + idf / max(idf) OVER () * info) AS eidf FROM i)
"""


_SAT = "(2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / average)))"


def _search(queries: str, normalize: bool = False) -> str:
    words = _WORDS.format("t")
    score = "score / max(score) OVER (PARTITION BY query)" if normalize else "score"
    return f"""
WITH {_corpus('documents', 'doc_id')},
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({words}) AS term FROM ({queries})) GROUP BY ALL),
z AS (SELECT query, count(*) AS m FROM q GROUP BY query),
h AS (SELECT query, doc, eidf * {_SAT} * qtf AS part, gamma * info * qtf AS know FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (doc), c),
s AS (SELECT query, doc, sum(part) AS base, sum(tanh(part)) AS cover, sum(know) AS know FROM h GROUP BY ALL),
f AS (SELECT query, doc, base + cover / m * know AS score FROM s JOIN z USING (query)),
r AS (SELECT query, doc, {score} AS score FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM r)
SELECT query, doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 10
"""


_ONE = f"SELECT 0 AS query, '{_QUERY}' AS t"

# The graph over the benchmark: up to a thousand texts, so terms in 2 to max(n // 2, 10) texts.
_GRAPH = f"""
WITH {_corpus('benchmark', 'item_id')},
a AS (SELECT doc, term, df, eidf, eidf * {_SAT} AS w FROM p JOIN t USING (term) JOIN d USING (doc), c),
n AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM a GROUP BY doc),
u AS (SELECT * FROM a, c WHERE df BETWEEN 2 AND greatest(c.n // 2, 10) AND eidf >= 0.005 * (SELECT max(eidf) FROM t)),
b AS (SELECT l.doc AS i, r.doc AS j, sum(l.w * r.w) AS raw FROM u l JOIN u r ON l.term = r.term AND l.doc < r.doc GROUP BY ALL),
k AS (SELECT i, j, raw / (ni.norm * nj.norm) AS sim FROM b JOIN n ni ON ni.doc = i JOIN n nj ON nj.doc = j),
s AS (SELECT * FROM k WHERE sim > 0 AND sim >= 0.01 * (SELECT max(sim) FROM k)),
s2 AS (SELECT i, j, sim FROM s UNION ALL SELECT j, i, sim FROM s),
dg AS (SELECT d.doc, coalesce(sum(sim), 0) AS degree FROM d LEFT JOIN s2 ON s2.i = d.doc GROUP BY d.doc),
ld AS (SELECT sum(CASE WHEN doc < greatest(3, c.n // 10) THEN degree ELSE 0 END) / greatest(3, max(c.n) // 10) / avg(degree) AS ratio FROM dg, c),
pr AS (SELECT doc, 1 + greatest(0, least(1, (ratio - 1) * 2.5)) * exp(-doc / greatest(0.1 * c.n, 1)) + 0.3 * exp(-(c.n - 1 - doc) / greatest(0.05 * c.n, 1)) AS prior FROM dg, ld, c)
"""


def _pagerank(rounds: int) -> str:
    out = _GRAPH + """,
p0 AS (SELECT doc, prior / sum(prior) OVER () AS p FROM pr),
st AS (SELECT s2.i, s2.j, sim / sum(sim) OVER (PARTITION BY s2.i) AS w FROM s2),
lo AS (SELECT doc FROM d WHERE doc NOT IN (SELECT i FROM s2)),
r0 AS (SELECT doc, p AS r FROM p0)"""
    for k in range(1, rounds + 1):
        out += f""",
r{k} AS (SELECT p0.doc, 0.15 * p + 0.85 * p * coalesce((SELECT sum(r) FROM r{k - 1} WHERE doc IN (SELECT doc FROM lo)), 0) + 0.85 * coalesce(got, 0) AS r
  FROM p0 LEFT JOIN (SELECT j AS doc, sum(r * w) AS got FROM st JOIN r{k - 1} ON r{k - 1}.doc = st.i GROUP BY j) USING (doc))"""
    return out + f" SELECT doc, round(r / max(r) OVER (), 6) AS rank FROM r{rounds}"


_SCORED = "SELECT doc_id, n_chars / 100000.0::DOUBLE AS own, (doc_id * 37 % 101) / 101.0::DOUBLE AS relevance, length(text) AS chars FROM documents"


def _masked(column: str) -> str:
    """Volatile parts masked; word borders of any script are spelled out, and done twice as neighbours share one."""
    left, right = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    parts = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"), (r"(?:\d{1,3}\.){3}\d{1,3}", "<IP>"), (r"\d{10,}", "<NUM>"), (r"[A-Za-z0-9+/]{19,}[A-Za-z0-9]", "<B64>")
    out = rf"regexp_replace({column}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?', '<TS>', 'g')"
    for pattern, token in parts:
        for _ in range(2):
            out = rf"regexp_replace({out}, '{left}{pattern}{right}', '\1{token}\2', 'g')"
    return out


_STATUS = f"""
WITH a AS (SELECT doc_id, text, {_masked('text')} AS z FROM documents),
b AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY text) AS first FROM a),
e AS (SELECT *, CASE WHEN first THEN doc_id = min(CASE WHEN first THEN doc_id END) OVER (PARTITION BY z) END AS own FROM b),
s AS (SELECT doc_id, CASE WHEN NOT first THEN 'exact' WHEN NOT own THEN 'near' ELSE 'unique' END AS status FROM e)
"""

_FIELDS = """
WITH r AS (SELECT doc_id AS idx, CASE WHEN doc_id % 3 = 0 THEN 'doc_id,quality' ELSE 'doc_id,quality,toxic' END AS schema, quality, toxic, doc_id FROM labels),
f AS (SELECT idx, schema, 'doc_id' AS k, CAST(doc_id AS VARCHAR) AS v FROM r UNION ALL SELECT idx, schema, 'quality', CAST(quality AS VARCHAR) FROM r
      UNION ALL SELECT idx, schema, 'toxic', CAST(toxic AS VARCHAR) FROM r WHERE schema LIKE '%toxic'),
g AS (SELECT schema, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, len(string_split(schema, ',')) AS keys FROM r GROUP BY schema HAVING count(*) >= 3),
v AS (SELECT schema, k, v, count(*) AS c FROM f GROUP BY ALL),
b AS (SELECT schema, k, max(c) AS c, arg_max(v, c) AS v FROM v GROUP BY schema, k),
s AS (SELECT schema, n, first_idx, last_idx, keys, string_agg(k || '=' || v, ';' ORDER BY k || '=' || v) AS static, count(*) AS m FROM b JOIN g USING (schema) WHERE c > 0.8 * n GROUP BY ALL),
o AS (SELECT schema, static, n AS count, first_idx, last_idx FROM s WHERE m > 0.3 * keys QUALIFY row_number() OVER (PARTITION BY static ORDER BY first_idx DESC) = 1)
"""

_ERRORS, _MEDIUM = "|".join(ERROR_KEYWORDS), "|".join(MEDIUM_KEYWORDS)
_LINES = """
WITH l AS (SELECT user_id AS log, event_id AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || ['INFO request done', 'WARN request timeout', 'ERROR request failed', 'INFO cache hit'][event_id % 4 + 1] || ' ' || event_type AS line FROM events)
"""
_TS = r"regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?', '<TS>', 'g')"
_CLASS = f"CASE WHEN regexp_matches(lower(line), '{_ERRORS}') THEN 0 WHEN regexp_matches(line, '(?i)\\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\\b') AND regexp_matches(lower(line), '{_MEDIUM}') THEN 1 ELSE 2 END"
_LOG_COMPRESS = _LINES + f""",
f AS (SELECT *, {_TS} AS form, {_CLASS} AS class FROM l),
o AS (SELECT *, count(*) OVER (PARTITION BY log, form) AS times, row_number() OVER (PARTITION BY log, form ORDER BY n) AS seen FROM f),
k AS (SELECT *, length(line) + 1 AS size FROM o WHERE seen <= 2),
r AS (SELECT *, sum(size) OVER (PARTITION BY log, class ORDER BY n) AS run FROM k),
k0 AS (SELECT * FROM r WHERE class = 0 AND run <= 300),
u0 AS (SELECT log, sum(size) AS used FROM k0 GROUP BY log),
k1 AS (SELECT r.* FROM r LEFT JOIN u0 USING (log) WHERE class = 1 AND run <= 300 - coalesce(used, 0)),
u1 AS (SELECT log, sum(size) AS used FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1) GROUP BY log),
k2 AS (SELECT r.* FROM r LEFT JOIN u1 USING (log) WHERE class = 2 AND run <= 300 - coalesce(used, 0)),
a AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
b AS (SELECT log, count(*) AS kept, string_agg(line || CASE WHEN times > 2 THEN '  [repeated ' || times || ' times]' ELSE '' END, chr(10) ORDER BY n) AS body FROM a GROUP BY log),
w AS (SELECT log, count(*) AS total FROM l GROUP BY log)
SELECT log, coalesce(body, '') || CASE WHEN total > coalesce(kept, 0) THEN chr(10) || '... [' || (total - coalesce(kept, 0)) || ' log lines omitted]' ELSE '' END AS compressed FROM w LEFT JOIN b USING (log)
"""

_DEF = (
    r"^(?:(?:async\s+)?def\s+\w+|class\s+\w+|(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+\w+|(?:export\s+)?class\s+\w+"
    r"|(?:export\s+)?(?:interface|type|enum)\s+\w+|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:function|\())"
)
# split into at most 51 (21) pieces: the last holds the rest.
_PIECES = "CASE WHEN len(string_split({0}, chr(10))) > {1} THEN list_append(string_split({0}, chr(10))[1:{1}], array_to_string(string_split({0}, chr(10))[{1} + 1:], chr(10))) ELSE string_split({0}, chr(10)) END"
_POINTS = f"""list_sum(list_transform({_PIECES.format('text', 50)}, lambda l:
  CASE WHEN trim(l) = '' OR trim(l) LIKE '#%' THEN 0 WHEN trim(l) LIKE 'import %' OR trim(l) LIKE 'from %' THEN 2 WHEN regexp_matches(trim(l), '{_DEF}') THEN 3
  WHEN trim(l) LIKE 'export %' OR trim(l) LIKE 'require(%' THEN 2 WHEN trim(l) LIKE 'const %' OR trim(l) LIKE 'let %' OR trim(l) LIKE 'var %' OR trim(l) LIKE '\"\"\"%' OR trim(l) LIKE '''''''%' THEN 1 ELSE 0 END))"""
_KIND = f"""
WITH a AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)
SELECT id, CASE WHEN {_POINTS} >= 5 THEN 'source'
  WHEN regexp_matches(substr(text, 1, 2000), '(?m)(Traceback|Exception|Error|Caused by:|^\\s+at\\s+|^\\s+File\\s+")') THEN 'stack'
  WHEN (trim(text) LIKE '{{%' OR trim(text) LIKE '[%') AND length(trim(text)) > 2 AND json_valid(text) THEN 'json'
  WHEN len(list_filter({_PIECES.format('text', 20)}, lambda l: regexp_matches(l, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}[T ]\\d{{2}}:\\d{{2}}'))) >= 3
    OR len(list_filter({_PIECES.format('text', 20)}, lambda l: regexp_matches(l, '(?i)\\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\\b'))) >= 3 THEN 'log' ELSE 'text' END AS kind FROM a
"""

_TRUNCATED = f"""
WITH a AS (SELECT page_id, html, length(html) AS n, 400 - {len(MARKER)} AS usable, lower(substr(html, CAST(floor(length(html) * 0.8::DOUBLE) AS BIGINT) + 1)) AS ending, substr(html, 1, greatest(1, CAST(floor(length(html) / 10.0) AS BIGINT))) AS start FROM pages),
b AS (SELECT *, CAST(floor(usable * CASE WHEN regexp_matches(ending, '{_ERRORS}') THEN 0.4 WHEN length(start) - length(replace(start, chr(10), '')) < 3 AND contains(start, ':') THEN 0.8 ELSE 0.5 END) AS BIGINT) AS head FROM a)
SELECT page_id, CASE WHEN n <= 400 THEN html ELSE substr(html, 1, head) || chr(10) || '...[content truncated]...' || chr(10) || substr(html, n - (usable - head) + 1) END AS cut FROM b
"""

_KNEE = """
WITH a AS (SELECT value::DOUBLE AS v, row_number() OVER (ORDER BY value DESC) - 1 AS i, count(*) OVER () AS n, max(value) OVER () AS high, min(value) OVER () AS low FROM events),
d AS (SELECT i, n, high - low AS spread, (v - low) / (high - low) - (1 - i / (n - 1)::DOUBLE) AS d FROM a),
b AS (SELECT i, d FROM d WHERE i <= n - 2 ORDER BY d DESC, i LIMIT 1)
SELECT CAST(coalesce((SELECT min(d.i) FROM d, b WHERE d.i > b.i AND d.d < b.d - spread / n), (SELECT i FROM b)) AS BIGINT) AS knee
"""

_MEDIAN = "WITH a AS (SELECT value::DOUBLE AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), m AS (SELECT v AS median FROM a WHERE i = n // 2), e AS (SELECT abs(v - median) AS x, row_number() OVER (ORDER BY abs(v - median)) - 1 AS i, n FROM a, m), z AS (SELECT x * 1.4826 AS mad FROM e WHERE i = n // 2)"
_CUTS = "p AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.75) AS BIGINT) THEN v END) AS p75, max(CASE WHEN i = CAST(floor(n * 0.25) AS BIGINT) THEN v END) AS p25 FROM o)"


def _tiers(score: str) -> str:
    return f"a AS ({_SCORED}), o AS (SELECT {score} AS v, row_number() OVER (ORDER BY {score}) - 1 AS i, count(*) OVER () AS n FROM a), {_CUTS}, t AS (SELECT a.*, CASE WHEN {score} >= p75 THEN 'high' WHEN {score} >= p25 THEN 'medium' WHEN {score} > 0 THEN 'low' ELSE 'cut' END AS tier FROM a, p)"


_CORE = f"""
WITH a AS ({_SCORED}), k AS (SELECT doc_id, own, row_number() OVER (ORDER BY own DESC, doc_id) AS core_rank, count(*) OVER () AS n, max(own) OVER () AS high, min(own) OVER () AS low FROM a),
d AS (SELECT core_rank - 1 AS i, n, high - low AS spread, (own - low) / (high - low) - (1 - (core_rank - 1) / (n - 1)::DOUBLE) AS d FROM k),
b AS (SELECT i, d FROM d WHERE i <= n - 2 ORDER BY d DESC, i LIMIT 1),
e AS (SELECT coalesce((SELECT min(d.i) FROM d, b WHERE d.i > b.i AND d.d < b.d - spread / n), (SELECT i FROM b)) AS knee)
SELECT doc_id, core_rank, core_rank <= greatest(1, least(knee + 1, n // 2), greatest(1, n // 20)) AS is_core FROM k, e
"""

_ALLOCATE = f"""
WITH {_tiers('relevance')},
s AS (SELECT doc_id, greatest(1, chars // 4) AS tokens, relevance AS score, CASE WHEN doc_id % 50 = 0 THEN 'preserve' ELSE tier END AS tier FROM t),
u AS (SELECT greatest(0, 475000 - coalesce(sum(CASE WHEN tier = 'preserve' THEN tokens END), 0)) AS rest FROM s),
g AS (SELECT tier, sum(greatest(score, 1e-10)) AS total FROM s GROUP BY tier),
b AS (SELECT s.*, total, CAST(floor(rest * CASE tier WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.3 WHEN 'low' THEN 0.1 ELSE 0 END) AS BIGINT) AS tier_budget FROM s JOIN g USING (tier), u)
SELECT doc_id, tier, tier_budget, CAST(CASE WHEN tier = 'preserve' THEN tokens WHEN tier = 'cut' THEN 0 ELSE greatest(10, floor(tier_budget * greatest(score, 1e-10) / total)) END AS BIGINT) AS entry_budget FROM b
"""


def _route(preset: str) -> str:
    return {
        "generic": "CASE WHEN length(html) >= 500 THEN 'truncate' ELSE 'passthrough' END",
        "mcp_responses": "CASE WHEN length(html) >= 1000 THEN 'truncate' ELSE 'passthrough' END",
        "aggressive": "CASE WHEN length(html) >= 200 THEN 'truncate' ELSE 'passthrough' END",
        "codex_logs": "'passthrough'",
    }[preset]


# Files of three languages: each event's definition stands at a line that follows from its number in its user's file.
_SOURCES = """
WITH e AS (SELECT user_id AS u, user_id % 3 AS kind, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT u, kind, count(*) AS n, 'u' || u || ['.py', '.js', '.md'][kind + 1] AS path FROM e GROUP BY u, kind)
"""
_HEAD = "['User' || u, 'User' || u, 'User ' || u][kind + 1]"

# A sentence of fewer than ten characters takes the next one in. Parts are joined by one control character, sentences by another.
_SENTENCES = r"""
WITH a AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS lines FROM documents),
b AS (SELECT doc, flatten(list_transform(lines, lambda l: string_split(regexp_replace(l, '([.!?])\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS parts FROM a),
c AS (SELECT doc, list_reduce(parts, lambda done, x: done || CASE WHEN length(string_split(done, chr(2))[-1]) < 10 THEN ' ' ELSE chr(2) END || x) AS done FROM b WHERE len(parts) > 0),
d AS (SELECT doc, string_split(done, chr(2)) AS s FROM c)
SELECT doc, CAST(i - 1 AS INTEGER) AS idx, s[i] AS sentence FROM (SELECT doc, s, unnest(range(1, len(s) + 1)) AS i FROM d)
"""

ORACLE_SQL = {
    "token_estimate": r"""SELECT doc_id, CAST(greatest(1, CASE WHEN text LIKE '{%' OR text LIKE '[%' THEN length(text) // 2 ELSE length(text) // 4 END) AS BIGINT) AS tokens,
      CAST(greatest(1, (length(text) + 2 + length(regexp_replace(text, '[^"\\\n\r\t\x08\x0c]', '', 'g')) + 5 * length(regexp_replace(text, '[^\x00-\x07\x0b\x0e-\x1f]', '', 'g'))
        + 5 * length(regexp_replace(text, '[\x00-\x7e]', '', 'g')) + 6 * length(regexp_replace(text, '[\x{0}-\x{ffff}]', '', 'g'))) // 4) AS BIGINT) AS json_tokens FROM documents""",
    "dedup_status": _STATUS + "SELECT doc_id, status FROM s",
    "dedup_stats": _STATUS + "SELECT count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'near') AS near, CAST(0 AS BIGINT) AS template, count(*) FILTER (status IN ('exact', 'near')) AS total_removed FROM s",
    "near_dedup_records": """WITH a AS (SELECT event_id, event_id = min(event_id) OVER (PARTITION BY ts, user_id, event_type, value, props) AS first, event_type, props FROM events),
      b AS (SELECT *, CASE WHEN first THEN event_id = min(CASE WHEN first THEN event_id END) OVER (PARTITION BY event_type, props) END AS own FROM a)
      SELECT event_id, CASE WHEN NOT first THEN 'exact' WHEN NOT own THEN 'near' ELSE 'unique' END AS status FROM b""",
    "schema_groups": _FIELDS + "SELECT schema, count(*) AS n FROM r GROUP BY schema",
    "template_detect": _FIELDS + "SELECT * FROM o",
    "template_collapse": _FIELDS + ", x AS (SELECT DISTINCT r.idx FROM r JOIN o ON first_idx < r.idx AND r.idx < last_idx) SELECT r.idx, x.idx IS NOT NULL AS removed, o.count AS template_count FROM r LEFT JOIN x ON x.idx = r.idx LEFT JOIN o ON o.first_idx = r.idx",
    "postings_tf": f"WITH w AS (SELECT doc_id AS doc, unnest({_WORDS.format('text')}) AS term FROM documents) SELECT doc, term, count(*) AS tf FROM w GROUP BY ALL",
    "term_stats": f"WITH {_corpus('documents', 'doc_id')} SELECT term, df, cf, round(idf, 6) AS idf, round(info, 6) AS info, round(gamma, 6) AS gamma, round(eidf, 6) AS eidf FROM t",
    "index_stats": f"WITH {_corpus('documents', 'doc_id')} SELECT n AS document_count, (SELECT count(*) FROM t) AS vocabulary_size, round(average, 4) AS average_length FROM c",
    "search_topk": f"SELECT doc, rank, score FROM ({_search(_ONE)})",
    "search_normalized": f"SELECT doc, rank, score FROM ({_search(_ONE, True)})",
    "search_batch": _search("SELECT item_id AS query, text AS t FROM benchmark"),
    "keywords": f"WITH {_corpus('documents', 'doc_id')}, k AS (SELECT term, eidf * sqrt(df) AS weight FROM t ORDER BY weight DESC, term LIMIT 10) SELECT term, round(weight, 6) AS weight FROM k",
    "sim_edges": _GRAPH + "SELECT i, j, round(sim, 6) AS sim FROM s",
    "degree_centrality": _GRAPH + "SELECT doc, round(degree, 6) AS degree FROM dg",
    "position_prior": _GRAPH + "SELECT doc, round(prior, 6) AS prior FROM pr",
    "query_biased_prior": _GRAPH + f""", q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_WORDS.format(repr(_QUERY))}) AS term) GROUP BY term),
      h AS (SELECT doc, sum(eidf * {_SAT} * qtf) AS score FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (doc), c GROUP BY doc)
      SELECT pr.doc, round(prior * (coalesce(score, 0) + 0.01), 6) AS prior FROM pr LEFT JOIN h USING (doc)""",
    "pagerank_fixed": _pagerank(12),
    "gini": "WITH a AS (SELECT value::DOUBLE AS v, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events) SELECT round(1 - 2 * sum((n - k + 1) * v) / (max(n) * sum(v)) + 1.0 / max(n), 6) AS gini FROM a",
    "pearson": "SELECT round(corr(value, user_id), 6) AS r FROM events",
    "upper_median_mad": _MEDIAN + " SELECT round(median, 6) AS median, round(mad, 6) AS mad FROM m, z",
    "hub_capped": _MEDIAN + " SELECT event_id, round(CASE WHEN mad > 0 AND (value - median) / mad > 3 THEN median + 2 * mad ELSE value END, 6) AS capped FROM events, m, z",
    "kneedle": _KNEE,
    "tier_cuts": f"WITH o AS (SELECT value::DOUBLE AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), {_CUTS} SELECT round(p75, 6) AS p75, round(p25, 6) AS p25 FROM p",
    "core_select": _CORE,
    "blended_scores": f"WITH a AS ({_SCORED}), r AS (SELECT corr(own, relevance) AS r FROM a), m AS (SELECT doc_id, CASE WHEN r > 0.95 THEN own ELSE 0.4 * own + 0.6 * relevance END AS v FROM a, r) SELECT doc_id, round(v / max(v) OVER (), 6) AS final FROM m",
    "tier_assign": f"WITH {_tiers('own')} SELECT doc_id, tier FROM t",
    "budget_allocate": _ALLOCATE,
    "auto_budget": "SELECT CAST(greatest(100, sum(greatest(1, CASE WHEN text LIKE '{%' OR text LIKE '[%' THEN length(text) // 2 ELSE length(text) // 4 END)) // 2) AS BIGINT) AS budget FROM documents",
    "truncate_adaptive": _TRUNCATED,
    "content_type": _KIND,
    "log_template_counts": _LINES + f"SELECT log, {_TS} AS form, count(*) AS times FROM l GROUP BY ALL HAVING count(*) >= 3",
    "log_severity": _LINES + f"SELECT CAST({_CLASS} AS INTEGER) AS severity, count(*) AS lines FROM l GROUP BY 1",
    "log_compress": _LOG_COMPRESS,
    "fold_arrays": "SELECT l_orderkey, count(*) AS count, list(l_partkey ORDER BY l_linenumber, l_partkey)[1:3] AS sample FROM lineitem GROUP BY l_orderkey HAVING count(*) > 4",
    "route_fields": """SELECT event_id, path, action FROM events CROSS JOIN (VALUES ('payload.output', 'truncate'), ('payload.status', 'passthrough'), ('reasoning', 'preserve'), ('log.stderr', 'truncate')) f(path, action)""",
    "preset_actions": f"SELECT page_id, {_route('aggressive')} AS aggressive, {_route('codex_logs')} AS codex_logs, {_route('generic')} AS generic, {_route('mcp_responses')} AS mcp_responses FROM pages",
    "language_map": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' END AS language FROM pages",
    "symbols_defs": _SOURCES + f"""SELECT path, {_HEAD} AS name, ['class', 'class', 'heading'][kind + 1] AS type, CAST([4, 1, 1][kind + 1] AS BIGINT) AS line FROM f
      UNION ALL SELECT path, CASE kind WHEN 2 THEN '' ELSE 'e' END || event_id, ['method', 'function', 'heading'][kind + 1], CAST([2 + 3 * i, 3 * i - 1, 4 * i - 2][kind + 1] AS BIGINT) FROM e JOIN f USING (u, kind)
      UNION ALL SELECT path, 'main', 'function', 7 + 3 * n FROM f WHERE kind = 0""",
    "symbol_summary": _SOURCES + "SELECT path, ['1 class, 1 function, ' || n || ' method', '1 class, ' || n || ' function', (n + 1) || ' heading'][kind + 1] || CASE WHEN n = 1 AND kind < 2 THEN '' ELSE 's' END AS summary FROM f",
    "scope_bindings": _SOURCES + """, p AS (SELECT * FROM f WHERE kind = 0)
      SELECT path, CAST(1 AS BIGINT) AS line, 'os' AS name, 'module' AS scope, '' AS scope_name FROM p UNION ALL SELECT path, 4, 'User' || u, 'class', 'User' || u FROM p
      UNION ALL SELECT path, 2 + 3 * i, 'e' || event_id, 'function', 'e' || event_id FROM e JOIN p USING (u)
      UNION ALL SELECT path, 7 + 3 * n, 'main', 'function', 'main' FROM p UNION ALL SELECT path, 8 + 3 * n, 'User' || u, 'function', 'main' FROM p
      UNION ALL SELECT path, 1, 'User' || u, 'module', '' FROM f WHERE kind = 1 UNION ALL SELECT path, 3 * i - 1, 'e' || event_id, 'function', 'e' || event_id FROM e JOIN f USING (u, kind) WHERE kind = 1""",
    "code_injections": _SOURCES + "SELECT path, 'python' AS embedded, CAST(4 * i AS BIGINT) AS startLine, CAST(4 * i + 1 AS BIGINT) AS endLine FROM e JOIN f USING (u, kind) WHERE kind = 2",
    "syntax_check": _SOURCES + "SELECT path, CAST(9 + 3 * n AS BIGINT) AS line FROM f WHERE kind = 0 AND n % 2 = 0",
    "sentence_segments": _SENTENCES,
    "index_update": f"""WITH {_corpus("(SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT -1 - item_id, text FROM benchmark)", 'doc_id')}
      SELECT term, df, cf, round(idf, 6) AS idf, round(info, 6) AS info, round(eidf, 6) AS eidf FROM t""",
    "stream_dedup": "SELECT DISTINCT conv_id, text FROM conversations",
    "event_rollup": "WITH a AS (SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY user_id) SELECT user_id, events, total, row_number() OVER (ORDER BY events DESC, user_id) AS rank FROM a",
}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import MAX_COVERAGE, MAX_LINE_CHARS, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PER_WORD, MIN_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM spot),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM seen WHERE nth > 1)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM r
"""

_REST = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format(x=f"regexp_extract({_REST}, '^[^/?#]*')")
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_ROOT = "regexp_extract({u}, '^.*?://[^/?#]*', 0, 's')"
_NODE = "CASE WHEN instr({u}, '://') > 0 THEN concat(" + _LOWER.format(x=_ROOT) + ", regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's')) END"


def _rule(kind: str) -> str:
    from .url_filter import RULES

    out = ""
    for action, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        said = f"{host}{path}" if kind == "rule" else action
        out += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{said}'"
    return f"CASE{out} END"


URLS = f"""
WITH RECURSIVE
href AS (
  SELECT url, regexp_extract(regexp_extract(coalesce(html, ''), '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') AS h FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(coalesce(html, ''), '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') FROM pages
),
target AS (
  SELECT url, CASE
    WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h
    WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(h, '//') THEN concat(split_part(url, '://', 1), ':', h)
    WHEN starts_with(h, '/') THEN concat({_ROOT.format(u="url")}, h)
    ELSE concat({_ROOT.format(u="url")}, coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*((?:/[^/?#]*)*/)?', 1, 's'), ''), '/'), h) END AS t
  FROM href WHERE h != '' AND instr(url, '://') > 0
),
edge AS (SELECT {_NODE.format(u="url")} AS a, {_NODE.format(u="t")} AS b FROM target WHERE t IS NOT NULL),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
blocked AS (
  SELECT DISTINCT a AS node FROM (SELECT a, {_HOST.format(u="b")} AS host, {_PATH.format(u="b")} AS path FROM reach) WHERE {_rule("action")} = 'block'
),
own AS (SELECT page_id, {_HOST.format(u="coalesce(url, '')")} AS host, {_PATH.format(u="coalesce(url, '')")} AS path, {_NODE.format(u="url")} AS node FROM pages)
SELECT page_id, host, path, {_rule("rule")} AS rule, coalesce({_rule("action")}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM own
"""


def _coverage(n: int) -> str:
    """Words of each document inside n-word windows that it has twice or more, as (doc_id, p)."""
    return f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {n - 1}], ' ')) AS times
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})),
c{n} AS (SELECT doc_id, count(*) AS n_words, sum(length(ws[p])) AS chars
  FROM (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, {n})) AS k FROM g{n} WHERE times > 1)) JOIN w USING (doc_id) GROUP BY doc_id)"""


QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
{",".join(map(_coverage, MAX_COVERAGE))},
line AS (SELECT doc_id, l, i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
copies AS (SELECT doc_id, count(*) AS n, sum(length(l)) AS chars
  FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS nth FROM line) WHERE nth > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(copies.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c5.n_words, 0) AS BIGINT) AS n_repeat_words, coalesce(copies.chars, 0) AS line_chars,
  {" OR ".join(f"coalesce(c{n}.chars, 0) / greatest(length(array_to_string(ws, '')), 1) > CAST({most} AS DOUBLE)" for n, most in MAX_COVERAGE.items())} AS repeats
  FROM w LEFT JOIN copies USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in MAX_COVERAGE)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR repeats OR line_chars > CAST({MAX_LINE_CHARS} AS DOUBLE) * greatest(word_chars, 1) OR n_symbols > CAST({MAX_SYMBOLS_PER_WORD} AS DOUBLE) * n_words) AS kept
FROM b
"""

ORACLES = {"op4_substring_dedup": SUBSTRINGS, "op6_warc": WARC, "op9_url_filter": URLS, "op10_quality_rules": QUALITY}

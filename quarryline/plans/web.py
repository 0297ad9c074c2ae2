"""URLs, pages, link graphs, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonfix as J
from ..functions import urls as U
from ..functions.constants import GENERIC_ANCHORS, MEDIA_EXTENSIONS, NEGATIVE_SEGMENTS, RICH_EXTENSIONS, TECHNICAL_KEYWORDS
from ..functions.documents import document
from ..functions.hashing import ring_node, shard_of
from ..functions.numbers import half_away, half_away_sql
from ..operators import crawl as C
from ..operators import graph as G
from ..sources import crawl_files
from .registry import RING_SQL, query, table

quoted = lambda values: ", ".join(f"'{v}'" for v in values)
HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1))"
PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SEGMENTS = f"list_filter(string_split({PATH.format(u='url')}, '/'), lambda s: s <> '')"
LOWER_SEGMENTS = f"list_transform({SEGMENTS}, lambda s: lower(s))"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([Hh][Tt][Tt][Pp][Ss]?)://', 1) AS s, regexp_extract(url, '^[^:]*://([^/?#]+)', 1) AS h,
      regexp_extract(url, '^[^:]*://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '^[^:]*://[^/?#]+[^?#]*(\\?[^#]*)', 1) AS q FROM pages)
    SELECT page_id, CASE WHEN s <> '' AND h <> '' THEN concat(lower(s), '://', lower(h), CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END, q) END AS normal FROM p"""
)
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.normalize(F.col("url")).alias("normal"))


@query(f"SELECT page_id, nullif({HOST.format(u='url')}, '') AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"))


@query("SELECT page_id, sha256(url) AS key FROM pages")
def url_sha256(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.url_key(F.col("url")).alias("key"))


@query("SELECT page_id, regexp_replace(md5(url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM pages")
def doc_uuid_md5(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.uuid_of(F.col("url")).alias("uuid"))


@query(f"WITH s AS (SELECT page_id, {LOWER_SEGMENTS} AS s FROM pages) SELECT page_id, CASE WHEN len(s) = 0 THEN '/' ELSE concat('/', array_to_string(s[1:2], '/'), '/') END AS subtree FROM s")
def url_subtree(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.subtree(F.col("url")).alias("subtree"))


#: Page URLs with a technical or junk segment, and files, by turns; so that all rules are met.
VARIED = "concat(regexp_replace(url, '[?#].*$', ''), list_extract(['/docs/start.html', '/login', '/a/b/c/d/e/f', '/logo.PNG/', '/api/v1.json', ''], CAST(page_id % 6 + 1 AS INTEGER)))"


def varied(spark: SparkSession, d: str) -> DataFrame:
    tails = F.array(*map(F.lit, ("/docs/start.html", "/login", "/a/b/c/d/e/f", "/logo.PNG/", "/api/v1.json", "")))
    return pages(spark, d).select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.get(tails, F.col("page_id") % 6)).alias("url"))


EXT = "regexp_extract(lower({p}), '(\\.[^./]*)$', 1)"
MEDIA = EXT.format(p=f"regexp_replace(split_part({PATH.format(u='url')}, ';', 1), '/+$', '')") + f" IN ({quoted(MEDIA_EXTENSIONS)})"
NEGATIVE = f"list_has_any({LOWER_SEGMENTS}, [{quoted(NEGATIVE_SEGMENTS)}])"
TECHNICAL = f"list_has_any({LOWER_SEGMENTS}, [{quoted(TECHNICAL_KEYWORDS)}])"
RICH = EXT.format(p=f"regexp_replace({PATH.format(u='url')}, '/+$', '')") + f" IN ({quoted(RICH_EXTENSIONS)})"
SCORE = f"""CASE WHEN len({SEGMENTS}) = 0 THEN CAST(0.40 AS DOUBLE) ELSE greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.30 AS DOUBLE) + CASE WHEN {TECHNICAL} THEN CAST(0.40 AS DOUBLE) ELSE 0 END
  + CASE WHEN {RICH} THEN CAST(0.15 AS DOUBLE) ELSE 0 END - CASE WHEN len({SEGMENTS}) > 5 AND NOT {TECHNICAL} THEN CAST(0.05 AS DOUBLE) * (len({SEGMENTS}) - 5) ELSE 0 END)) END"""


@query(f"WITH v AS (SELECT page_id, {VARIED} AS url FROM pages) SELECT page_id, url FROM v WHERE NOT ({MEDIA})")
def url_media_filter(spark: SparkSession, d: str) -> DataFrame:
    return varied(spark, d).where(~U.is_media(F.col("url")))


@query(
    f"""WITH v AS (SELECT page_id, {VARIED} AS url, CAST(page_id % 4 AS INTEGER) AS depth FROM pages),
    s AS (SELECT page_id, {NEGATIVE} AS negative, {half_away_sql(f"({SCORE})", 4)} AS path_score,
      {half_away_sql(f"greatest(0.05, least(1, (CAST(0.45 AS DOUBLE) * ({SCORE}) + CAST(0.35 AS DOUBLE) * CAST(0.05 AS DOUBLE) + CAST(0.20 AS DOUBLE) * (1 / (1 + CAST(0.35 AS DOUBLE) * depth))) * CASE WHEN {NEGATIVE} THEN CAST(0.15 AS DOUBLE) ELSE 1 END))", 4)} AS priority FROM v)
    SELECT * FROM s"""
)
def url_priority(spark: SparkSession, d: str) -> DataFrame:
    """Priorities of links with a generic anchor at depths 0 to 3."""
    url, depth = F.col("url"), (F.col("page_id") % 4).cast("int")
    return varied(spark, d).select(
        "page_id", U.is_negative(url).alias("negative"), half_away(U.path_score(url), 4).alias("path_score"), U.priority(url, F.lit("Click here"), depth).alias("priority")
    )


@query(
    """WITH c AS (SELECT page_id, unnest(string_split(regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\s+', '', 'g'), '')) AS ch FROM pages),
    n AS (SELECT page_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY page_id, ch), t AS (SELECT page_id, sum(k) AS total, count(*) AS kinds FROM n GROUP BY page_id)
    SELECT page_id, """
    + half_away_sql("(-sum(k / total * log2(k / total)) / greatest(1e-300, any_value(CASE WHEN log2(least(kinds, 16)) <= 0 THEN 1 ELSE log2(least(kinds, 16)) END)))", 4)
    + """ AS entropy FROM n JOIN t USING (page_id) WHERE kinds > 1 GROUP BY page_id"""
)
def title_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Normalized character entropy of page titles, before its length scale and bounds."""
    title = F.regexp_replace(F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), r"\s+", "")
    own = pages(spark, d).select("page_id", F.explode(F.split(title, "")).alias("ch")).where("ch != ''")
    counts = own.groupBy("page_id", "ch").agg(F.count("*").alias("k"))
    total = counts.groupBy("page_id").agg(F.sum("k").alias("total"), F.count("*").alias("kinds"), F.collect_list("k").alias("ks")).where("kinds > 1")
    share = F.aggregate(F.array_sort("ks"), F.lit(0.0), lambda s, k: s - k / F.col("total") * F.log2(k / F.col("total")))
    most = F.log2(F.least("kinds", F.lit(16)).cast("double"))
    return total.select("page_id", half_away(share / F.when(most <= 0, 1.0).otherwise(most), 4).alias("entropy"))


@query(
    rf"""WITH p AS (SELECT page_id, regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '^\s+|\s+$', '', 'g') AS bare FROM pages),
    c AS (SELECT page_id, bare, list_filter(string_split(regexp_replace(bare, '\s+', '', 'g'), ''), lambda c: c <> '') AS chars, list_transform(regexp_split_to_array(lower(bare), '\s+'), lambda w: trim(w, '.,!?:;"''()[]{{}}<>-')) AS words FROM p),
    n AS (SELECT page_id, char, count(*) AS n FROM (SELECT page_id, unnest(chars) AS char FROM c) GROUP BY ALL),
    e AS (SELECT page_id, -sum(n / len(chars) * log2(n / len(chars))) AS entropy, log2(least(count(*), 16)) AS most FROM n JOIN c USING (page_id) GROUP BY page_id),
    s AS (SELECT page_id, bare, entropy / CASE WHEN most <= 0 THEN 1 ELSE most END * least(1, length(bare) / 6) + CASE WHEN list_has_any(words, [{quoted(TECHNICAL_KEYWORDS)}]) THEN 0.25 ELSE 0 END AS score FROM c LEFT JOIN e USING (page_id))
    SELECT page_id, CAST(round(CASE WHEN bare = '' OR lower(bare) IN ({quoted(GENERIC_ANCHORS)}) THEN 0.05 ELSE greatest(0.05, least(1, score)) END, 6) AS DOUBLE) AS score FROM s"""
)
def anchor_entropy(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.round(U.anchor_score(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), 6).alias("score"))


@query(None)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.canonicalize(F.col("url")).alias("canonical"))


@query(f"WITH v AS (SELECT {HOST.format(u='url')} AS host, page_id, url FROM pages) SELECT host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM v GROUP BY host")
def seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each host, in order of discovery."""
    own = pages(spark, d).select(U.host(F.col("url")).alias("host"), "page_id", "url")
    return C.first_seen(own, key="host", order="page_id")


@query(
    """SELECT page_id FROM pages WHERE regexp_matches(url, '^https://.*\\.example\\.(com|org)') AND NOT regexp_matches(url, '.*/es/.*')"""
)
def url_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(U.matches(F.col("url"), (r"^https://.*\.example\.(com|org)",), ("*/es/*",))).select("page_id")


# --- graphs: hosts link by page order, for pages' own links lead nowhere ----------------

EDGES = f"""h AS (SELECT page_id, {HOST.format(u='url')} AS host FROM pages),
e AS (SELECT DISTINCT a.host AS src, b.host AS dst FROM h a JOIN h b ON b.page_id = a.page_id + 1 WHERE a.page_id % 3 <> 0 AND a.host <> b.host)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    own = pages(spark, d).select("page_id", U.host(F.col("url")).alias("src"))
    after = own.select((F.col("page_id") - 1).alias("page_id"), F.col("src").alias("dst"))
    return own.where("page_id % 3 != 0").join(after, "page_id").where("src != dst").select("src", "dst").distinct()


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT node, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM n) AS rank FROM n)"
    for i in range(1, rounds + 1):
        out += f""", r{i} AS (SELECT n.node, CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM n) + CAST(0.85 AS DOUBLE) * (coalesce(g.got, 0)
          + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS rank
          FROM n LEFT JOIN (SELECT e.dst, sum(r.rank / o.k) AS got FROM e JOIN r{i - 1} r ON r.node = e.src JOIN o USING (src) GROUP BY e.dst) g ON g.dst = n.node)"""
    return out + f" SELECT node, {half_away_sql('rank', 8)} AS rank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_k(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(edges(spark, d), 0.85, 5).select("node", half_away(F.col("rank"), 8).alias("rank"))


@query(
    f"""WITH RECURSIVE {EDGES}, s AS (SELECT {HOST.format(u='url')} AS node FROM pages WHERE page_id = 1),
    w AS (SELECT node, 0 AS depth FROM s UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node"""
)
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    seeds = pages(spark, d).where("page_id = 1").select(U.host(F.col("url")).alias("node"))
    return G.levels(edges(spark, d), seeds, 3)


@query(
    f"""WITH RECURSIVE {EDGES}, walk AS (SELECT host AS url, 0 AS depth FROM h WHERE page_id = 1 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url WHERE w.depth < (SELECT count(DISTINCT host) FROM h))
    SELECT url, min(depth) AS depth FROM walk GROUP BY url"""
)
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    hosts = edges(spark, d)
    every = pages(spark, d).select(U.host(F.col("url")).alias("url")).distinct()
    seeds = pages(spark, d).where("page_id = 1").select(U.host(F.col("url")).alias("url"))
    n = every.count()  # budgets that cover the table
    return C.crawl(every, hosts, seeds, max_depth=n, max_pages=n)


@query(
    """WITH RECURSIVE a AS (SELECT o_orderkey AS alias, o_orderkey - 1 AS canonical FROM orders WHERE o_orderkey % 8 <> 0 UNION ALL SELECT -1, -2 UNION ALL SELECT -2, -1 UNION ALL SELECT -3, -1),
    walk AS (SELECT alias AS key, canonical AS spot, 1 AS n FROM a UNION ALL SELECT w.key, a.canonical, w.n + 1 FROM walk w JOIN a ON a.alias = w.spot WHERE w.n < 12),
    ends AS (SELECT key, arg_max(spot, n) AS last, max(n) AS n FROM walk GROUP BY key)
    SELECT key, CASE WHEN last IN (SELECT alias FROM a) THEN key ELSE last END AS canonical FROM ends"""
)
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Chains of order keys down to a multiple of 8, a cycle of two and a key that leads into it."""
    chain = table(spark, d, "orders").where("o_orderkey % 8 != 0").select(F.col("o_orderkey").cast("long").alias("alias"), (F.col("o_orderkey") - 1).cast("long").alias("canonical"))
    loop = spark.createDataFrame([(-1, -2), (-2, -1), (-3, -1)], "alias long, canonical long")
    return G.resolve_aliases(chain.union(loop))


@query(
    f"""WITH l AS (SELECT page_id AS seq, url, CASE WHEN page_id % 5 < 4 THEN 0.005 ELSE 0.5 END AS y, page_id % 9 AS links, page_id % 4 + 1 AS depth FROM pages),
    o AS (SELECT seq, y, depth, CASE WHEN len({LOWER_SEGMENTS}) = 0 THEN '/' ELSE concat('/', array_to_string(({LOWER_SEGMENTS})[1:1], '/'), '/') END AS prefix FROM l WHERE links < 8 AND depth > 1),
    g AS (SELECT *, sum(CASE WHEN y >= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY prefix ORDER BY seq) AS good FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY prefix, good ORDER BY seq) AS run FROM g WHERE y < 0.02)
    SELECT prefix, CAST(arg_max(depth, seq) AS BIGINT) AS max_depth FROM r WHERE run >= 3 GROUP BY prefix"""
)
def consecutive_low_yield(spark: SparkSession, d: str) -> DataFrame:
    """Subtrees that a made-up crawl log prunes; urls are cut to one segment so that runs come up."""
    low = F.when(F.col("page_id") % 5 < 4, 0.005).otherwise(0.5)
    url = F.regexp_replace("url", r"^([^:]*://[^/?#]*/[^/?#]*).*$", "$1")
    log = pages(spark, d).select(F.col("page_id").alias("seq"), url.alias("url"), low.alias("yield"), (F.col("page_id") % 9).alias("links"), (F.col("page_id") % 4 + 1).alias("depth"))
    return C.pruned_subtrees(log)


# --- pages -----------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT page_id, html, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS md FROM pages),
    c AS (SELECT page_id, octet_length(encode(md)) AS m, octet_length(encode(regexp_replace(html, '<(script|style|svg)[^>]*>.*?</(script|style|svg)>', '', 'gis'))) AS h, octet_length(encode(html)) AS all_bytes FROM t)
    SELECT page_id, """
    + half_away_sql("least(1.0, m / CASE WHEN h = 0 THEN all_bytes ELSE h END)", 6)
    + """ AS yield_ratio FROM c"""
)
def yield_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The share of an article's markup in its page."""
    md = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    return pages(spark, d).select("page_id", half_away(C.clean_yield(md, F.col("html")), 6).alias("yield_ratio"))


@query(
    """WITH t AS (SELECT page_id, len(list_filter(regexp_split_to_array(html, '\\s+'), lambda w: w <> '')) AS raw,
      len(list_filter(regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '\\s+'), lambda w: w <> '')) AS clean FROM pages)
    SELECT page_id, CASE WHEN raw > 0 THEN """
    + half_away_sql("greatest(0.0, (raw - clean) / raw * 100)", 1)
    + """ ELSE 0.0 END AS savings FROM t"""
)
def token_savings(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    article = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    return pages(spark, d).select("page_id", C.token_savings(count(F.col("html")), count(article)).alias("savings"))


@query(
    """WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages)
    SELECT page_id FROM t WHERE len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) >= 15
      AND NOT regexp_matches(lower(concat(title, chr(10), body)), '404 not found|page not found|page cannot be found')"""
)
def soft404_filter(spark: SparkSession, d: str) -> DataFrame:
    own = pages(spark, d).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    return C.soft_404(own).select("page_id")


@query(None)
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", H.markdown(F.col("html"), F.col("url")).alias("m")).select("page_id", "m.markdown", "m.tokens", "m.title")


@query(None)
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    own = pages(spark, d).select("page_id", H.cleaned(F.col("html"), F.col("url")).alias("c"))
    return own.select("page_id", "c.title", "c.body", "c.language", F.size("c.links").alias("n_links"))


@query(None)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    own = pages(spark, d).select("page_id", F.posexplode(H.anchor_links(F.col("html"), F.col("url"))).alias("pos", "l"))
    return own.select("page_id", "pos", "l.link", "l.anchor")


@query(None)
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Links of all pages, canonical, scored, without pages that are stored."""
    own = pages(spark, d).select(F.explode(H.anchor_links(F.col("html"), F.col("url"))).alias("l"))
    links = own.select(U.canonicalize(F.col("l.link")).alias("url"), F.col("l.anchor").alias("anchor"), F.lit(1).alias("depth")).where("url is not null")
    return C.frontier(links, pages(spark, d).select(U.canonicalize(F.col("url")).alias("url")))


@query(None)
def document_router(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several declared types through the router."""
    kinds = F.array(*map(F.lit, ("text/plain", "text/html; charset=utf-8", "application/json", "application/xml", "image/png")))
    own = table(spark, d, "documents").select("doc_id", F.get(kinds, F.col("doc_id") % 5).alias("kind"), F.col("text").cast("binary").alias("data"))
    out = own.select("doc_id", document(F.lit(""), F.col("kind"), F.col("data")).alias("x"))
    return out.select("doc_id", "x.title", "x.tokens", "x.error")


@query(f"SELECT page_id, url FROM pages WHERE NOT starts_with(coalesce({PATH.format(u='url')}, ''), '/de/')")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    hosts = pages(spark, d).select(U.host(F.col("url")).alias("domain")).distinct()
    body = "User-agent: *\nDisallow: /en/\nDisallow: /fr/\n\nUser-agent: quarry\nUser-agent: other\nDisallow: /de/\n"
    rules = crawl_files.read_robots(hosts.withColumn("body", F.lit(body)))
    return C.robots_allowed(pages(spark, d).select("page_id", "url"), rules, "QuarryBot/1.0")


@query(f"SELECT {HOST.format(u='url')} || '/' || CAST(page_id // 1000 AS VARCHAR) AS source, 'urlset' AS kind, url, CAST(NULL AS VARCHAR) AS error FROM pages WHERE regexp_matches(url, '^https?://[^/?#]')")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps of a host: one for each 1000 page numbers, so that no file grows with the host."""
    entry = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc></url>"))
    name = F.concat_ws("/", U.host(F.col("url")), F.floor(F.col("page_id") / 1000))
    per_host = pages(spark, d).groupBy(name.alias("source")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("x"))
    files = per_host.select("source", F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).cast("binary").alias("data"))
    return crawl_files.read_sitemaps(files)


@query(
    """SELECT conv_id, turn AS at, '{"role": "' || role || '", "turn": ' || CAST(turn AS VARCHAR) || '}' AS json, CAST(NULL AS VARCHAR) AS error FROM conversations WHERE role IN ('user', 'assistant', 'system') AND turn >= 0"""
)
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Answers wrapped in fences with a trailing comma, held against a schema."""
    raw = F.concat(F.lit('Here it is:\n```json\n{"role": "'), "role", F.lit('", "turn": '), F.col("turn").cast("string"), F.lit(",}\n```\n"))
    schema = {"type": "object", "required": ["role", "turn"], "properties": {"role": {"enum": ["user", "assistant", "system"]}, "turn": {"type": "integer", "minimum": 0}}}
    own = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("at"), J.repaired(raw, schema).alias("r"))
    return own.select("conv_id", "at", "r.json", "r.error")


@query(
    f"""WITH t AS (SELECT node, node || '#' || CAST(i AS VARCHAR) AS key FROM (SELECT unnest(['node-a', 'node-b', 'node-c']) AS node), range(128) r(i)),
    keys AS (SELECT key FROM t UNION SELECT coalesce(url, '') FROM pages), {RING_SQL},
    tokens AS (SELECT node, h FROM t JOIN hashed USING (key)), own AS (SELECT page_id, h, CAST(h32 % 64 AS INTEGER) AS shard FROM pages JOIN hashed ON key = coalesce(url, '')),
    near AS (SELECT page_id, shard, node, min((tokens.h + CAST(18446744073709551616 AS UHUGEINT) - own.h) % CAST(18446744073709551616 AS UHUGEINT)) AS behind FROM own, tokens GROUP BY ALL)
    SELECT page_id, shard, array_to_string((list(node ORDER BY behind))[1:2], ' ') AS nodes FROM near GROUP BY page_id, shard"""
)
def shard_placement(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    nodes = ring_node(url, ["node-a", "node-b", "node-c"], replicas=2)
    return pages(spark, d).select("page_id", shard_of(url).alias("shard"), F.array_join(nodes, " ").alias("nodes"))

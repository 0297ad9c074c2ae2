"""Crawl analytics over stored pages: frontier, pruning, yields, robots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.constants import HUB_LINKS, LOW_YIELD, LOW_YIELD_RUN
from ..functions.numbers import half_away
from .graph import cut


def frontier(links: DataFrame, seen: DataFrame, least: float = 0.10, capacity: int | None = 50_000) -> DataFrame:
    """(url, depth, priority) of ``links`` (url, anchor, depth) worth a crawl:
    not in ``seen`` (url), priority at least ``least``, the best of each url,
    the ``capacity`` best in all (None: all)."""
    scored = links.withColumn("priority", U.priority(F.col("url"), F.col("anchor"), F.col("depth"))).where(F.col("priority") >= least)
    best = scored.groupBy("url").agg(F.max(F.struct("priority", (-F.col("depth")).alias("neg"))).alias("b"))
    new = best.join(seen.select("url").distinct(), "url", "left_anti")
    own = new.select("url", (-F.col("b.neg")).alias("depth"), F.col("b.priority").alias("priority"))
    return own if capacity is None else own.orderBy(F.col("priority").desc(), "url").limit(capacity)


def first_seen(items: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """Of each key the first row in order of discovery."""
    own = items.groupBy(key).agg(F.min(F.struct(order, *[c for c in items.columns if c not in (key, order)])).alias("r"))
    return own.select(key, "r.*")


def clean_yield(markdown: Column, html: Column) -> Column:
    """Bytes of Markdown per byte of HTML without scripts, styles and drawings; at most 1."""
    bare = F.octet_length(F.regexp_replace(html, r"(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>", ""))
    ratio = F.octet_length(markdown) / F.when(bare == 0, F.octet_length(html)).otherwise(bare)
    return F.when(F.octet_length(html) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), ratio))


def token_savings(raw: Column, clean: Column) -> Column:
    """Per cent of tokens saved, 1 digit, never below 0."""
    return F.when(raw > 0, half_away(F.greatest(F.lit(0.0), (raw - clean) / raw * 100), 1)).otherwise(F.lit(0.0))


def pruned_subtrees(log: DataFrame) -> DataFrame:
    """(prefix, max_depth) of subtrees that a crawl log (seq, url, yield, links,
    depth) prunes: low yields in a row; deeper pages than at the last such page
    go. Hubs and pages of depth 0 or 1 don't count; a good page starts the run
    anew but frees nothing."""
    own = log.where((F.col("links") < HUB_LINKS) & (F.col("depth") > 1)).withColumn("prefix", U.subtree(F.col("url")))
    order = Window.partitionBy("prefix").orderBy("seq")
    island = own.withColumn("good", F.sum(F.when(F.col("yield") >= LOW_YIELD, 1).otherwise(0)).over(order)).where(F.col("yield") < LOW_YIELD)
    runs = island.withColumn("run", F.row_number().over(Window.partitionBy("prefix", "good").orderBy("seq")))
    return runs.where(F.col("run") >= LOW_YIELD_RUN).groupBy("prefix").agg(F.max_by("depth", "seq").alias("max_depth"))


def unpruned(pages: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows of ``pages`` (url, depth) that no pruned subtree holds too deep."""
    own = pages.withColumn("prefix", U.subtree(F.col("url")))
    return own.join(pruned, "prefix", "left").where(F.col("max_depth").isNull() | (F.col("depth") <= F.col("max_depth"))).drop("prefix", "max_depth")


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Rows of ``pages`` (url) that robots ``rules`` (domain, grp, agent,
    disallow) leave. Of the groups that name a part of ``agent`` that with the
    longest name counts, else the first for ``*``; its prefixes forbid."""
    lower = agent.lower()
    named = rules.withColumn("agent", F.lower("agent")).where((F.col("agent") == "*") | F.contains(F.lit(lower), F.col("agent")))
    size = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = named.groupBy("domain").agg(F.max_by("grp", F.struct(size, -F.col("grp"))).alias("grp"))
    own = rules.join(best, ["domain", "grp"], "left_semi").where("disallow != ''").select("domain", "disallow").distinct()
    page = pages.withColumn("domain", U.host(F.col("url"))).withColumn("path", F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url"))))
    return page.join(own, (page.domain == own.domain) & F.startswith(page.path, own.disallow), "left_anti").drop("domain", "path")


def soft_404(pages: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Rows that are no error pages in disguise: 15 words or more, no such phrase in title or body."""
    phrases = ("404 not found", "page not found", "page cannot be found")
    words = F.size(F.filter(F.split(F.col(body), r"\s+"), lambda w: w != ""))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(F.lower(title), F.lit(p)) | F.contains(F.lower(body), F.lit(p))
    return pages.where((words >= 15) & ~F.coalesce(hit, F.lit(False)))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 1000, host: str = "", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth): a breadth-first crawl over stored ``pages`` (url) and
    ``links`` (src, dst). One level is one join; a level is cut to the pages
    that are left of ``max_pages``, in order of their URLs."""
    ok = U.allowed_host(F.col("url"), host) & U.matches(F.col("url"), include, exclude)
    front = cut(seeds.select("url").where(ok).distinct().join(pages.select("url").distinct(), "url", "left_semi").orderBy("url").limit(max_pages))
    seen = cut(front.withColumn("depth", F.lit(0)))
    left = max_pages - seen.count()
    for depth in range(1, max_depth + 1):
        if left <= 0:
            break
        found = links.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).where(ok).distinct()
        front = cut(found.join(seen, "url", "left_anti").join(pages.select("url").distinct(), "url", "left_semi").orderBy("url").limit(left))
        n = front.count()
        if not n:
            break
        left -= n
        seen = seen.union(front.withColumn("depth", F.lit(depth)))
    return seen


def within_size(pages: DataFrame, most: int = 2 << 20, html: str = "html") -> DataFrame:
    """Pages of at most ``most`` bytes."""
    return pages.where(F.octet_length(html) <= most)


def is_shell(html: Column) -> Column:
    """Whether a page waits for scripts to fill it: next to no text, or an empty root element."""
    bare = F.lower(F.coalesce(html, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(bare, r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", ""), "<[^>]*>", "")
    return (F.length(F.trim(text)) < 20) | bare.rlike(r"""<div[^>]*\bid=["']?(root|app|__next)["']?[^>]*>\s*</div>""")


def adaptive_crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 1000, least: float = 0.10) -> DataFrame:
    """(url, depth, priority): a crawl over stored ``pages`` (url, yield, links)
    and ``links`` (src, dst, anchor) that takes the best links first and leaves
    subtrees that yield little. One level is one join. Pages are crawled level by
    level, each level by priority and then address; low yields in a row are in that order."""
    known = pages.select("url", F.col("yield"), F.col("links").alias("n_links"))
    front = cut(seeds.select("url").distinct().join(known.select("url"), "url", "left_semi").select("url", F.lit(0).alias("depth"), F.lit(1.0).alias("priority")).orderBy("url").limit(max_pages))
    seen, left = front, max_pages - front.count()
    for depth in range(1, max_depth + 1):
        order = F.struct("depth", -F.col("priority"), "url")
        log = seen.join(known, "url").select(order.alias("seq"), "url", "yield", F.col("n_links").alias("links"), "depth")
        found = links.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url"), "anchor", F.lit(depth).alias("depth"))
        ranked = unpruned(frontier(found, seen, least), pruned_subtrees(log)).join(known.select("url"), "url", "left_semi")
        front = cut(ranked.orderBy(F.col("priority").desc(), "url").limit(max(0, left)))
        n = front.count()
        if not n:
            break
        left -= n
        seen = cut(seen.unionByName(front))
    return seen

"""URL filters with redirect equivalence.

Rules (action, host, path) judge a URL; a rule fits its host and all
subdomains if the path starts with its own, and the longest fitting rule wins.
Redirects and canonical links make URLs equivalent: over those edges
distributed connected components are found, and a component with a blocked URL
blocks its other URLs, except those that a rule allows explicitly.

All of it is DataFrame expressions; components are found by
:mod:`.components`.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and has no edges; null pages' html has no edges; repeated rows
each get their row; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: The rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def rest_of(url: Column) -> Column:
    """What follows the first ``://`` (none: empty)."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(action, rule) of the longest rule that fits, or null."""
    longest_first = sorted(rules, key=lambda r: len(r[1] + r[2]))
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in longest_first:  # the last one tested first is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host lower-cased, no fragment; null without ``://``."""

    def of(url: Column) -> Column:
        head = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*", 0)
        tail = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
        return F.when(F.instr(url, "://") > 0, F.concat(F.translate(head, ascii_uppercase, ascii_lowercase), tail))

    return let(url, of)


def absolute(base: Column, href: Column) -> Column:
    """``href`` as it stands in the page at ``base``; null if there is none."""
    root = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*((?:/[^/?#]*)*/)?", 1)

    def of(href: Column) -> Column:
        return (
            F.when((href == "") | (root == ""), F.lit(None).cast("string"))
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(href.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
        )

    return let(href, of)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) from each page to its canonical link and its refresh target."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    hrefs = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1))
    # Most pages have neither; a plain search is cheaper than the expressions.
    hits = pages.where(html.rlike("(?i)canonical|refresh"))
    targets = F.transform(hrefs, lambda href: node_of(absolute(url, href)))
    edges = hits.select(node_of(url).alias("src"), F.explode(targets).alias("dst"))
    return edges.where("src is not null and dst is not null and src != dst")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    default: str = "allow",
) -> DataFrame:
    """One row per page: host, path, rule, verdict and whether an alias decided
    it. ``redirects`` (src, dst) adds known redirects to those of the pages."""
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    found = connected_components(edges)
    action = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    spread = found.groupBy("component").agg(F.max(F.coalesce(action == "block", F.lit(False))).alias("blocked")).where("blocked")
    blocked = found.join(spread, "component", "left_semi").select("node")

    url = F.col(url_col)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).join(blocked.withColumn("by_alias", F.lit(True)), "node", "left")
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("by_alias"), F.lit("block")), F.lit(default))
    return own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), (F.col("fit").isNull() & F.coalesce("by_alias", F.lit(False))).alias("by_alias"))

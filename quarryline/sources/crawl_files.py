"""Rows out of crawl files: robots.txt, sitemaps, result pages."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MEDIA_EXTENSIONS
from ..functions.html import Node, tree

#: Bytes of a sitemap that are read, and sitemap pages of a root that are kept; None takes all.
MAX_SITEMAP_BYTES: int | None = 25 << 20
#: The same for sitemaps by the protocol's own limit.
PROTOCOL_SITEMAP_BYTES = 50 << 20
#: Fixed value: the parameter in which the result pages' redirects carry their address.
REDIRECT_PARAMETER = "uddg"


def robots_rules(text: str) -> list[tuple[int, str, str]]:
    """(group, agent, disallowed prefix or '') of a robots.txt. Agents named in a
    row share a group; only Disallow counts, and empty ones do not."""
    out: list[tuple[int, list[str], list[str]]] = []
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not out or out[-1][2]:
                out.append((len(out), [], []))
            out[-1][1].append(value.lower())
        elif key == "disallow" and out and value:
            out[-1][2].append(value)
    return [(g, a, d) for g, agents, rules in out for a in agents for d in rules or [""]]


def read_robots(files: DataFrame) -> DataFrame:
    """(domain, grp, agent, disallow) of ``files`` (domain, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *r) for d, body in zip(batch["domain"], batch["body"], strict=True) for r in robots_rules(body or "")]
            yield pd.DataFrame(rows, columns=["domain", "grp", "agent", "disallow"])

    return files.select("domain", "body").mapInPandas(run, "domain string, grp int, agent string, disallow string")


def sitemap_urls(data: bytes, most: int | None = MAX_SITEMAP_BYTES) -> tuple[str, list[str]]:
    """(urlset or sitemapindex, its http(s) addresses); gzip is seen by its magic. ValueError for anything else,
    and for one of more than ``most`` bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        if most is not None and len(data) > most:
            raise ValueError(f"no sitemap: it has more than {most} bytes")
        root = ElementTree.fromstring(data)
    except (ElementTree.ParseError, EOFError) as e:
        raise ValueError(f"no sitemap: {e}") from e
    local = lambda e: e.tag.rpartition("}")[2].lower()
    kind = local(root)
    if kind not in ("urlset", "sitemapindex"):
        raise ValueError(f"no sitemap: its root is {kind}")
    inner = "url" if kind == "urlset" else "sitemap"
    found = [(loc.text or "").strip() for e in root if local(e) == inner for loc in e if local(loc) == "loc"]
    return kind, [u for u in found if urlsplit(u).scheme in ("http", "https") and urlsplit(u).netloc]


def read_sitemaps(files: DataFrame, most: int | None = MAX_SITEMAP_BYTES) -> DataFrame:
    """(source, kind, url, error) of ``files`` (source, data binary); a file that is no sitemap gives a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for source, data in zip(batch["source"], batch["data"], strict=True):
                try:
                    kind, urls = sitemap_urls(bytes(data or b""), most)
                    rows += [(source, kind, u, None) for u in urls]
                except (ValueError, OSError) as e:
                    rows.append((source, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "kind", "url", "error"], dtype=object)

    return files.select("source", "data").mapInPandas(run, "source string, kind string, url string, error string")


def sitemap_pages(files: DataFrame, roots: DataFrame, most: int | None = 50_000, nested: int = 2) -> DataFrame:
    """(root, url) of pages under ``roots`` (root), whose index files are followed ``nested`` levels down among
    ``files``; of each root the first ``most`` in order of addresses (None: all)."""
    rows = read_sitemaps(files).where("error is null").select("source", "kind", "url").cache()
    front = roots.select("root").withColumn("source", roots["root"])
    pages = None
    for _ in range(nested + 1):
        hits = front.join(rows, "source")
        found = hits.where("kind = 'urlset'").select("root", "url")
        pages = found if pages is None else pages.union(found)
        front = hits.where("kind = 'sitemapindex'").select("root", hits["url"].alias("source"))
    if most is None:
        return pages.distinct()
    rank = F.row_number().over(Window.partitionBy("root").orderBy("url"))
    return pages.distinct().withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def _classes(node: Node) -> set[str]:
    return set(node.attr("class").split())


def redirect_target(href: str, engine: str, parameter: str = REDIRECT_PARAMETER) -> str | None:
    """The address that a result link leads to: its redirect ``parameter``, or itself if it is not the engine's own."""
    href = href.strip()
    href = "https:" + href if href.startswith("//") else f"https://{engine}{href}" if href.startswith("/") else href
    try:
        part = urlsplit(href)
        target = parse_qs(part.query).get(parameter, [href])[0]
        own = urlsplit(target)
    except ValueError:
        return None
    if own.scheme not in ("http", "https") or own.netloc.lower().endswith(engine):
        return None
    return None if re.search(r"(\.[^./]*)/*$", own.path.lower() or "/") and re.search(r"(\.[^./]*)/*$", own.path.lower())[1] in MEDIA_EXTENSIONS else target


def result_rows(html: str, engine: str) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of a result page, each url once, in order; all links if nothing is marked as a result."""
    root, seen, out = tree(html), set(), []

    def add(link: Node, snippet: str) -> None:
        url = redirect_target(link.attr("href"), engine)
        if url and url not in seen:
            seen.add(url)
            out.append((link.text().strip() or url, url, snippet))

    for box in root.walk():
        if _classes(box) & {"result", "web-result", "links_main", "result__body"}:
            link = next((n for n in box.walk() if n.tag == "a" and (_classes(n) & {"result__a", "result__url"} or n.parent is not None and n.parent.tag == "h2")), None)
            text = next((n.text().strip() for n in box.walk() if _classes(n) & {"result__snippet", "links_snippet"}), "")
            if link is not None:
                add(link, text)
    if not out:
        for n in root.walk():
            if n.tag == "a" and n.attr("href"):
                add(n, "")
    return out


def read_results(pages: DataFrame, engine: str) -> DataFrame:
    """(query_id, pos, title, url, snippet) of result ``pages`` (query_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, i, *r) for q, h in zip(batch["query_id"], batch["html"], strict=True) for i, r in enumerate(result_rows(h or "", engine))]
            yield pd.DataFrame(rows, columns=["query_id", "pos", "title", "url", "snippet"])

    return pages.select("query_id", "html").mapInPandas(run, "query_id long, pos int, title string, url string, snippet string")


def read_provider_json(answers: DataFrame, path: str = "results", title: str = "title", url: str = "url", text: str = "content") -> DataFrame:
    """(query_id, pos, title, url, snippet) of search providers' JSON answers (query_id, body), each url once."""
    item = f"array<struct<`{title}`:string,`{url}`:string,`{text}`:string>>"
    rows = answers.select("query_id", F.posexplode(F.from_json(F.get_json_object("body", f"$.{path}"), item)).alias("pos", "r"))
    flat = rows.select("query_id", "pos", F.col(f"r.{title}").alias("title"), F.col(f"r.{url}").alias("url"), F.col(f"r.{text}").alias("snippet")).where("url is not null")
    first = flat.groupBy("query_id", "url").agg(F.min(F.struct("pos", "title", "snippet")).alias("f"))
    return first.select("query_id", "f.pos", "f.title", "url", "f.snippet")

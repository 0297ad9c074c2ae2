"""HTML pages to Markdown, clean text, metadata and links.

The standard library's tokenizer feeds a small tree builder with the rules
that real pages need: void elements, implied ends, raw text. The work per page
is pure Python and runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Elements without content, and elements that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
SKIPPED = frozenset("script style noscript iframe nav footer".split())
SKIPPED_UNLESS_RAW = frozenset("form svg".split())
LANDMARKS = frozenset("main article section".split())
WITH_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table pre blockquote div section article header footer main nav aside".split())
LEAVES = frozenset("div section article span aside".split())
NO_LOOSE_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre a code table th td script style title head".split())
CLEAN_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li article main section".split())


@dataclass(frozen=True)
class Limits:
    """What of a page goes into its Markdown: how deep its body is followed, a table's columns and rows, a cell's
    bytes. None takes all. :func:`to_markdown` says whether anything was left out."""

    depth: int | None = 128
    columns: int | None = 50
    rows: int | None = 500
    cell: int | None = 1000


WHOLE = Limits(None, None, None, None)


@dataclass
class Node:
    tag: str
    parent: Node | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def elements(self):
        return (c for c in self.children if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += c.children[::-1]
        return "".join(out)

    def walk(self):
        """This element and all below it, in order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in node.children[::-1] if isinstance(c, Node)]

    def attr(self, name: str) -> str:
        return self.attrs.get(name, "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        self.depth = 0

    def _close(self, tags: set[str], bounds: set[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest of ``bounds``."""
        node, found = self.at, None
        while node is not self.root and node.tag not in bounds:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrs = {k.lower(): v or "" for k, v in attrs} | self.root.attrs
            return
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k.lower(), v or "")
        node = Node(tag, self.at, own)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            if tag not in ("table", "body", "html") and node.tag in ("td", "th", "table") and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                return  # an end inside a cell does not reach out of it
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _skipped(node: Node, mode: str) -> bool:
    if node.tag == "header":
        up = node.parent
        while up is not None:
            if up.tag in LANDMARKS:
                return False
            up = up.parent
        return True
    return node.tag in SKIPPED or (mode != "raw" and node.tag in SKIPPED_UNLESS_RAW)


def _absolute(base: str, href: str) -> str | None:
    """The http(s) address that ``href`` means, or None."""
    try:
        out = urljoin(base, href.strip()) if base else href
        return out if urlsplit(out).scheme in ("http", "https") else None
    except ValueError:
        return None


def _inline(node: Node, base: str, mode: str) -> str:
    out, todo = [], [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif _skipped(c, mode):
            continue
        elif c.tag == "code":
            code = c.text().strip()
            out.append(f"`{code}`" if code else "")
        elif c.tag == "a":
            label, href = c.text().strip(), c.attr("href")
            plain = not href or not label or (label.startswith("[") and "](" in label) or (mode == "clean_rag" and href.startswith("#"))
            target = None if plain else _absolute(base, href)
            out.append(f"[{label}]({target})" if target else label)
        else:
            todo += c.children[::-1]
    return "".join(out)


_HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "#### ", "h6": "#### "}


def _blocks(root: Node, base: str, mode: str, limits: Limits, cut: list[str]):
    """The Markdown blocks of an element, in order; what is left out is named in ``cut``."""
    todo: list[tuple[Node | str, int]] = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            yield node
            continue
        if _skipped(node, mode) or node.tag == "table":
            continue
        if limits.depth is not None and depth > limits.depth:
            cut.append("depth")
            continue
        if node.tag in _HEADINGS or node.tag in ("p", "blockquote", "pre"):
            text = (_inline(node, base, mode) if node.tag == "p" else node.text()).strip()
            if text:
                yield {"p": text, "blockquote": f"> {text}", "pre": f"```\n{text}\n```"}.get(node.tag) or _HEADINGS[node.tag] + text
            continue
        if node.tag in ("ul", "ol"):
            items = [_inline(c, base, mode).strip() for c in node.elements() if c.tag == "li"]
            yield "\n".join(f"- {x}" for x in items if x)
            continue
        if node.tag in LEAVES and not any(c.tag in WITH_BLOCKS for c in node.elements()):
            text = _inline(node, base, mode).strip()
            if text:
                yield text
                continue
        below: list[tuple[Node | str, int]] = []
        for c in node.children:
            if isinstance(c, Node):
                below.append((c, depth + 1))
            elif c.strip() and node.tag not in NO_LOOSE_TEXT:
                below.append((c.strip(), depth))
        todo += below[::-1]


def _cell(node: Node, limits: Limits, cut: list[str]) -> str:
    text = node.text().strip()
    if limits.cell is None or len(data := text.encode()) <= limits.cell:
        return text
    cut.append("cell")
    return data[: limits.cell].decode(errors="ignore")


def _own_rows(table: Node):
    """Rows and header cells of a table, not of tables inside it."""
    todo = list(table.elements())[::-1]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            continue
        yield node
        todo += list(node.elements())[::-1]


def _table(node: Node, limits: Limits, cut: list[str]) -> str:
    headers, rows = [], []
    for own in _own_rows(node):
        if own.tag == "th":
            if limits.columns is None or len(headers) < limits.columns:
                headers.append(_cell(own, limits, cut))
            else:
                cut.append("columns")
        elif own.tag == "tr":
            cells = [c for c in own.elements() if c.tag == "td"]
            if cells and limits.rows is not None and len(rows) >= limits.rows:
                cut.append("rows")
            elif cells:
                if limits.columns is not None and len(cells) > limits.columns:
                    cut.append("columns")
                rows.append([_cell(c, limits, cut) for c in cells[: limits.columns]])
    if not headers and rows:
        headers = [f"Col {i + 1}" for i in range(len(rows[0]))]
    if not headers:
        return ""
    n = len(headers)
    lines = [headers, ["---"] * n, *((r + [""] * n)[:n] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def title_of(root: Node) -> str:
    for tag in ("title", "h1"):
        for node in root.walk():
            if node.tag == tag and node.text().strip():
                return node.text().strip()
    return ""


def words_of(text: str) -> int:
    """The number of words: the token count where no tokenizer is given."""
    return len(text.split())


def to_markdown(
    html: str, url: str = "", mode: str = "clean_rag", limits: Limits = Limits(), count: Callable[[str], int] = words_of
) -> tuple[str, int, str, str]:
    """(Markdown, tokens by ``count``, title, what ``limits`` left out): the title, all tables, then the body."""
    root = tree(html)
    title, cut = title_of(root) or url, []
    tables = [_table(n, limits, cut) for n in root.walk() if n.tag == "table"]
    parts = [f"# {title}", *filter(None, tables), *filter(None, _blocks(root, url, mode, limits, cut))]
    text = "\n\n".join(parts).strip()
    return text, count(text), title, ",".join(sorted(set(cut)))


def _clean(root: Node) -> list[str]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if _skipped(node, "clean_rag"):
            continue
        if node.tag in CLEAN_BLOCKS:
            text = node.text().strip()
            out += [text] if len(text.encode()) > 3 else []
        else:
            todo += list(node.elements())[::-1]
    return out


def links(root: Node, url: str) -> list[str]:
    """Absolute http(s) links without fragments, in order, repeats kept."""
    found = (_absolute(url, n.attr("href")) for n in root.walk() if n.tag == "a" and "href" in n.attrs)
    return [urldefrag(x)[0] for x in found if x]


def anchors(root: Node, url: str) -> list[tuple[str, str]]:
    """(link, anchor): its text, else an image's alt, else its title, else its label."""
    out = []
    for n in root.walk():
        if n.tag == "a" and (target := _absolute(url, n.attr("href")) if "href" in n.attrs else None):
            alts = [x.attr("alt") for x in n.walk() if x.tag == "img"]
            texts = [n.text().strip(), *alts[:1], n.attr("title"), n.attr("aria-label")]
            out.append((urldefrag(target)[0], next((t.strip() for t in texts if t.strip()), "")))
    return out


def meta(root: Node, *names: str) -> str:
    for name in names:
        for n in root.walk():
            if n.tag == "meta" and n.attr("name").lower() == name and n.attr("content"):
                return n.attr("content")
    return ""


def clean_page(html: str, url: str = "") -> dict:
    """title, body, language, timestamp and links of a page."""
    root = tree(html)
    return {
        "title": title_of(root),
        "body": " ".join(_clean(root)),
        "language": root.attr("lang"),
        "timestamp": meta(root, "pubdate"),
        "links": links(root, url),
    }


#: Pages that are taken apart before their results are handed on.
PAGES = 128

LINKS = pa.list_(pa.struct([("link", pa.string()), ("anchor", pa.string())]))
PAGE = pa.struct([("title", pa.string()), ("body", pa.string()), ("language", pa.string()), ("timestamp", pa.string()), ("links", pa.list_(pa.string()))])
MARKDOWN = pa.struct([("markdown", pa.string()), ("tokens", pa.int64()), ("title", pa.string()), ("cut", pa.string())])


def _of_pages(html: Column, url: Column, kind: pa.DataType, one: Callable[[str, str], object]) -> Column:
    """``one`` of each page and address. What a task holds is a batch as it came and the results of PAGES pages."""

    @F.arrow_udf(from_arrow_type(kind))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in batches:
            for low in range(0, len(pages), PAGES):
                few = zip(pages.slice(low, PAGES).to_pylist(), urls.slice(low, PAGES).to_pylist(), strict=True)
                yield pa.array([one(h or "", u or "") for h, u in few], kind)

    return run(html, url)


def cleaned(html: Column, url: Column) -> Column:
    return _of_pages(html, url, PAGE, clean_page)


def markdown(html: Column, url: Column, mode: str = "clean_rag", limits: Limits = Limits(), count: Callable[[str], int] = words_of) -> Column:
    """struct(markdown, tokens, title, cut): ``cut`` names the limits that left something out, "" if none did."""
    return _of_pages(html, url, MARKDOWN, lambda h, u: dict(zip(MARKDOWN.names, to_markdown(h, u, mode, limits, count), strict=True)))


def anchor_links(html: Column, url: Column) -> Column:
    return _of_pages(html, url, LINKS, lambda h, u: [{"link": a, "anchor": b} for a, b in anchors(tree(h), u)])

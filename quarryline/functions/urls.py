"""URLs as columns: canonical forms, predicates, priorities."""

from __future__ import annotations

import ipaddress
import posixpath
import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import (
    ALLOWED_PORTS,
    GENERIC_ANCHORS,
    MAX_SEGMENT_REPEATS,
    MAX_SEGMENTS,
    MAX_URL,
    MEDIA_EXTENSIONS,
    NEGATIVE_SEGMENTS,
    RICH_EXTENSIONS,
    TECHNICAL_KEYWORDS,
    TRACKING_PARAMS,
    TRACKING_PREFIX,
)
from .numbers import clamp, half_away

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The lower-cased host without its port; null without one."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def uuid_of(doc_id: Column) -> Column:
    """The md5 of an id in UUID form."""
    return F.regexp_replace(F.md5(doc_id), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def normalize(url: Column) -> Column:
    """Loose form: http(s) only, lower-cased scheme and host, no fragment, no
    trailing slashes behind a path; null if rejected."""
    shape = r"^([Hh][Tt][Tt][Pp][Ss]?)://([^/?#]+)([^?#]*)(\?[^#]*)?"
    part = lambda i: F.regexp_extract(url, shape, i)
    tail = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(part(3))
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), tail, part(4)))


def segments(url: Column) -> Column:
    """The path's non-empty segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def subtree(url: Column) -> Column:
    """The first two segments of the path, lower-cased, between slashes."""
    own = F.transform(F.slice(segments(url), 1, 2), F.lower)
    return F.when(F.size(own) > 0, F.concat(F.lit("/"), F.array_join(own, "/"), F.lit("/"))).otherwise(F.lit("/"))


def extension(p: Column) -> Column:
    return F.regexp_extract(F.lower(p), r"(\.[^./]*)$", 1)


def is_media(url: Column) -> Column:
    bare = F.regexp_replace(F.substring_index(path(url), ";", 1), "/+$", "")
    return extension(bare).isin(*MEDIA_EXTENSIONS)


def _lit_array(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def is_negative(url: Column) -> Column:
    """Whether a whole segment is one of the junk words."""
    return F.arrays_overlap(F.transform(segments(url), F.lower), _lit_array(NEGATIVE_SEGMENTS))


def path_score(url: Column) -> Column:
    own = segments(url)
    technical = F.arrays_overlap(F.transform(own, F.lower), _lit_array(TECHNICAL_KEYWORDS))
    score = (
        F.lit(0.30)
        + F.when(technical, 0.40).otherwise(0.0)
        + F.when(extension(F.regexp_replace(path(url), "/+$", "")).isin(*RICH_EXTENSIONS), 0.15).otherwise(0.0)
        - F.when((F.size(own) > 5) & ~technical, 0.05 * (F.size(own) - 5)).otherwise(0.0)
    )
    return F.when(F.size(own) == 0, F.lit(0.40)).otherwise(clamp(score, 0.05, 1.0))


def anchor_score(anchor: Column) -> Column:
    """The normalized entropy of an anchor's characters, scaled by its length, more for technical words."""
    bare = F.regexp_replace(F.coalesce(anchor, F.lit("")), r"(?U)^\s+|\s+$", "")
    chars = F.filter(F.split(F.regexp_replace(bare, r"(?U)\s+", ""), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    most = F.log2(F.least(F.size(F.array_distinct(chars)).cast("double"), F.lit(16.0)))
    words = F.transform(F.split(F.lower(bare), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".,!?:;\"'()[]{}<>-")))
    more = F.when(F.arrays_overlap(words, _lit_array(TECHNICAL_KEYWORDS)), 0.25).otherwise(0.0)
    score = entropy / F.when(most <= 0, 1.0).otherwise(most) * F.least(F.lit(1.0), F.length(bare) / 6.0) + more
    return F.when((bare == "") | F.lower(bare).isin(*GENERIC_ANCHORS), F.lit(0.05)).otherwise(clamp(score, 0.05, 1.0))


def priority(url: Column, anchor: Column, depth: Column) -> Column:
    """How worth a crawl a link is, 0.05 to 1; 4 digits."""
    score = 0.45 * path_score(url) + 0.35 * anchor_score(anchor) + 0.20 * (1.0 / (1.0 + 0.35 * depth))
    return half_away(clamp(score * F.when(is_negative(url), 0.15).otherwise(1.0), 0.05, 1.0), 4)


def allowed_host(url: Column, allowed: str) -> Column:
    """The host itself or a subdomain of it; an empty rule allows all."""
    own = host(url)
    return F.lit(True) if not allowed else (own == allowed.lower()) | own.endswith("." + allowed.lower())


def pattern(text: str) -> str:
    """A glob (``*`` and ``?``) as an unanchored expression; what looks like an expression stays one."""
    text = text.strip()
    if text.startswith("^") or text.endswith("$") or "\\" in text:
        return text
    return re.sub(r"[.+()\[\]{}^$|\\*?]", lambda m: {"*": ".*", "?": "."}.get(m[0], "\\" + m[0]), text)


def matches(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether the URL or its path fits an include pattern (if there are any) and no exclude pattern."""
    hit = lambda p: url.rlike(pattern(p)) | path(url).rlike(pattern(p))
    out = F.lit(True)
    for p in exclude:
        out = out & ~hit(p)
    if include:
        any_of = F.lit(False)
        for p in include:
            any_of = any_of | hit(p)
        out = out & any_of
    return out


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and port (or the scheme's own) agree."""

    def origin(u: Column) -> Column:
        scheme = F.lower(F.substring_index(u, "://", 1))
        port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
        return F.struct(scheme, host(u), F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))

    return (origin(a) == origin(b)) & host(a).isNotNull()


def subnet(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /64 of an IPv6 one; what is no address stays."""

    @F.pandas_udf(T.StringType())
    def of_v6(ips: pd.Series) -> pd.Series:
        return ips.map(_prefix64)

    v4 = ip.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return F.when(v4, F.regexp_replace(ip, r"\.\d+$", ".0/24")).when(F.contains(ip, F.lit(":")), of_v6(ip)).otherwise(ip)


def _prefix64(ip: str | None) -> str | None:
    try:
        own = ipaddress.ip_address((ip or "").strip("[]").partition("%")[0])
    except ValueError:
        return ip
    mapped = own if own.version == 4 else own.ipv4_mapped
    if mapped is not None:
        return str(mapped).rpartition(".")[0] + ".0/24"
    return ":".join(f"{int(own) >> shift & 0xFFFF:x}" for shift in (112, 96, 80, 64)) + "::/64"


def private_ip(ip: str | None) -> bool | None:
    """Private, reserved or otherwise not public (v4, v6, and v4 inside v6); null if it is no address."""
    try:
        own = ipaddress.ip_address(ip or "")
    except ValueError:
        return None
    inner = getattr(own, "ipv4_mapped", None) or getattr(own, "sixtofour", None)
    if inner is None and own in ipaddress.ip_network("64:ff9b::/96" if own.version == 6 else "255.255.255.255/32") and own.version == 6:
        inner = ipaddress.ip_address(int(own) & 0xFFFFFFFF)
    if inner is not None:
        return private_ip(str(inner))
    return not own.is_global or own.is_multicast or own.is_reserved


@F.pandas_udf(T.BooleanType())
def is_private_ip(ips: pd.Series) -> pd.Series:
    return ips.map(private_ip).astype("object")


def canonical(url: str | None, allow_loopback: bool = False) -> str | None:
    """The strict canonical form, or None if the URL is rejected.

    An escape in the path is escaped again (``%`` becomes ``%25``), as stored keys have it."""
    text = (url or "").strip()
    if not text or len(text.encode()) > MAX_URL:
        return None
    try:
        part = urlsplit(text)
        name, port = (part.hostname or "").lower(), str(part.port or "")
    except ValueError:
        return None
    scheme = part.scheme.lower()
    if scheme not in ("http", "https") or not name:
        return None
    if (scheme, port) in (("http", "80"), ("https", "443")):
        port = ""
    if not allow_loopback and (port not in ALLOWED_PORTS or private_ip(name)):
        return None
    own = quote(part.path, safe="/%:@!$&'()*+,;=~-._") or "/"
    if own != "/":
        own = own.rstrip("/")
    pieces = [s for s in own.strip("/").split("/")] if own.strip("/") else []
    named = [s for s in pieces if s]
    if len(pieces) > MAX_SEGMENTS or any(named.count(s) >= MAX_SEGMENT_REPEATS for s in set(named)):
        return None
    own = own.replace("%", "%25")
    kept = [(k, v) for k, v in parse_qsl(part.query, keep_blank_values=True) if not (k.lower().startswith(TRACKING_PREFIX) or k.lower() in TRACKING_PARAMS)]
    query = "&".join(f"{quote_plus(k, safe='-_.~')}={quote_plus(v, safe='-_.~')}" for k, v in sorted(kept))
    shown = f"[{name}]" if ":" in name else name
    out = f"{scheme}://{shown}{':' + port if port else ''}{own}{'?' + query if query else ''}"
    ext = posixpath.splitext(unquote(own).split(";")[0].rstrip("/").lower())[1]
    return None if len(out.encode()) > MAX_URL or ext in MEDIA_EXTENSIONS else out


def canonicalize(url: Column, allow_loopback: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: canonical(u, allow_loopback))

    return run(url)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from the page at ``base``."""

    @F.pandas_udf(T.StringType())
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or h is None else _join(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return run(base, href)


def _join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def readme_url(url: Column) -> Column:
    """A code host's repository page as the address of its raw README; others stay."""
    return F.regexp_replace(url, r"^(?!.*raw\.githubusercontent\.com).*github\.com/([^/]+)/([^/]+)/?$", "https://raw.githubusercontent.com/$1/$2/master/README.md")

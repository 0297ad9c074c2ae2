"""Golden values and properties of column and text functions."""

from __future__ import annotations

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import documents as D
from quarryline.functions import hashing as X
from quarryline.functions import html as H
from quarryline.functions import jsonfix as J
from quarryline.functions import text as T
from quarryline.functions import urls as U
from quarryline.functions.constants import STOPWORDS
from quarryline.functions.numbers import half_away
from quarryline.operators import ranking as R
from quarryline.sources import crawl_files as S


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("running", "run"), ("connects", "connect"), ("connection", "connect"), ("connections", "connect"), ("relational", "relat"),
        ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("hesitanci", "hesit"), ("digitizer", "digit"),
        ("conformably", "conform"), ("radically", "radic"), ("different", "differ"), ("happy", "happi"), ("is", "is"), ("é", "é"),
        ("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("sky", "sky"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"), ("cease", "ceas"),
    ],
)
def test_stems(word, stem):
    assert T.stem(word) == stem


def test_stopwords_are_a_set_of_174():
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 174


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Docs.Docker.Com/engine/install#section-1", "https://docs.docker.com/engine/install"), ("https://example.com:443/page", "https://example.com/page"),
        ("http://example.com:80/page", "http://example.com/page"), ("http://example.com:8080/api", "http://example.com:8080/api"), ("http://example.com:6379/keys", None),
        ("https://example.com/item?z=2&utm_source=twitter&a=1&utm_medium=social&fbclid=xyz", "https://example.com/item?a=1&z=2"), ("https://example.com/docs/", "https://example.com/docs"),
        ("https://example.com/", "https://example.com/"), ("https://example.com/images/hero.png", None), ("https://e.com/" + "/".join(f"s{i}" for i in range(12)), None),
        ("https://e.com/a/b/a/b/a", None), ("https://e.com/" + "x" * 2050, None), ("http://192.168.1.1/admin", None), ("", None), (None, None), ("ftp://e.com/x", None),
    ],
)
def test_canonical_urls(raw, want):
    assert U.canonical(raw) == want


def test_canonical_loopback():
    assert U.canonical("http://127.0.0.1:8080/test", allow_loopback=True) == "http://127.0.0.1:8080/test"


@given(st.lists(st.sampled_from(["a", "b", "docs", "x-y", "Z"]), max_size=6), st.dictionaries(st.sampled_from(["q", "utm_x", "ref", "k"]), st.sampled_from(["1", "two words", "é"]), max_size=3))
@settings(max_examples=60, deadline=None)
def test_canonical_is_idempotent_without_escapes(parts, params):
    url = "https://Example.com/" + "/".join(parts) + ("?" + "&".join(f"{k}={v}" for k, v in params.items()) if params else "")
    once = U.canonical(url)
    assert once is None or U.canonical(once) == once


@pytest.mark.parametrize(
    ("ip", "private"),
    [("10.0.0.1", True), ("172.16.3.4", True), ("169.254.1.1", True), ("127.0.0.1", True), ("8.8.8.8", False), ("::1", True), ("fe80::1", True), ("::ffff:10.0.0.1", True),
     ("64:ff9b::a00:1", True), ("64:ff9b::808:808", False), ("2002:0a00:0001::", True), ("2606:4700::1", False), ("no", None), (None, None)],
)
def test_private_addresses(ip, private):
    assert U.private_ip(ip) is private


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_url_columns(spark):
    raw = ["https://EXAMPLE.com/path/", "http://example.com#fragment", "https://example.com/foo%2Fbar/", "javascript:x", "mailto:a@b", "https://", None]
    assert column(spark, raw, U.normalize) == ["https://example.com/path", "http://example.com", "https://example.com/foo%2Fbar", None, None, None, None]
    assert column(spark, ["http://EXAMPLE.COM:8080/path", "invalid-url", "http://u:p@h.org/"], U.host) == ["example.com", None, "h.org"]
    assert column(spark, ["https://x/docs/archive/v1/page.html", "https://x/docs", "https://x/"], U.subtree) == ["/docs/archive/", "/docs/", "/"]
    assert column(spark, ["https://x/login", "https://x/blog/tag/golang", "https://x/api/cartesian-product"], U.is_negative) == [True, True, False]
    assert column(spark, ["https://x/a.PNG", "https://x/a.png;v=1", "https://x/a.js", "https://x/font.woff2/"], U.is_media) == [True, True, False, True]
    assert column(spark, ["10.1.2.3", "::1", "2001:db8:1:2:3::4", "::ffff:10.1.2.3", "x:y", None], U.subnet) == ["10.1.2.0/24", "0:0:0:0::/64", "2001:db8:1:2::/64", "10.1.2.0/24", "x:y", None]
    assert column(spark, ["https://code.github.com/a", "https://github.com/org/repo/"], U.readme_url)[1] == "https://raw.githubusercontent.com/org/repo/master/README.md"


def test_link_scores(spark):
    got = column(spark, ["", "click here", "Architecture", "官方文档指南", "Distributed Raft Consensus Specification", None], U.anchor_score)
    assert got[0] == got[1] == got[5] == 0.05 and got[2] >= 0.7 and got[3] >= 0.6 and got[4] >= 0.8
    got = column(spark, ["https://go.dev/", "https://go.dev/doc/tutorial/getting-started.html", "https://x/a/b/c/d/e/f/g/h"], U.path_score)
    assert got[0] >= 0.35 and got[1] >= 0.8 and got[2] <= 0.25
    got = column(spark, ["https://x/docs/api"], lambda u: U.priority(u, F.lit("API reference"), F.lit(0))) + column(spark, ["https://x/login"], lambda u: U.priority(u, F.lit("Login"), F.lit(2)))
    assert got[0] >= 0.75 and got[1] <= 0.2


def test_patterns():
    assert U.pattern("*/docs/*.html?") == ".*/docs/.*\\.html." and U.pattern("^https") == "^https" and U.pattern("a+b") == "a\\+b"


def test_rounding_half_away(spark):
    assert column(spark, [0.5, -0.5, 2.5, 1.2345], lambda x: half_away(x, 0), "double") == [1.0, -1.0, 3.0, 1.0]


def test_tokens_leave_gaps(spark):
    docs = spark.createDataFrame([(1, " The quick, (brown) fox's\tden! "), (2, None), (3, "the a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.term, r.dl) for r in T.tokens(docs).collect())
    assert got == [(1, 1, "quick", 5), (1, 2, "brown", 5), (1, 3, "fox's", 5), (1, 4, "den", 5)]


def test_embedding_signs_and_norm():
    v = T.embed("Golang engine for search indexing")
    assert v.shape == (128,) and abs((v * v).sum() - 1) < 1e-9
    assert (v[::2] >= 0).all() and (v[1::2] <= 0).all()
    assert not T.embed("the a of").any()


def test_vbyte_round_trips():
    rng = random.Random(1)
    ids = sorted(rng.sample(range(1 << 30), 200))
    tfs = [rng.randint(1, 300) for _ in ids]
    assert X.decode_postings(X.encode_postings(ids, tfs)) == (ids, tfs)
    assert X.vbyte_decode(X.vbyte_encode([0, 127, 128, 1 << 40])) == [0, 127, 128, 1 << 40]


def test_ring_moves_few_keys(spark):
    keys = [f"k{i}" for i in range(400)]
    a = column(spark, keys, lambda k: X.ring_node(k, ["n1", "n2", "n3"]))
    b = column(spark, keys, lambda k: X.ring_node(k, ["n1", "n2", "n3", "n4"]))
    moved = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert all(y == ["n4"] for _, y in moved) and 0 < len(moved) < 200
    two = column(spark, keys[:20], lambda k: X.ring_node(k, ["n1", "n2"], replicas=3))
    assert all(sorted(x) == ["n1", "n2"] for x in two)


PAGE = """<html lang="en"><head><title>Test Page</title><meta name="pubdate" content="2026-08-08"><style>x</style><script>var t="</p>";</script></head><body>
<header>Top header</header><nav>menu</nav><main><header>Kept</header><h1>Main Title</h1><p>Text with <a href="/link">link</a> and <code>inline code</code> <b>open<p>Second
<ul><li>First item<li>Two <a href="#x">frag</a></ul><pre>a
 b</pre><h2>Section 2</h2><div>leaf <a href="mailto:x">mail</a></div><iframe>q</iframe></main><footer>Foot</footer></body></html>"""


def test_markdown():
    md, n, title, _ = H.to_markdown(PAGE, "https://example.com/x")
    assert title == "Test Page" and n == len(md.split())
    for part in ("# Main Title", "## Section 2", "[link](https://example.com/link)", "`inline code`", "- First item", "```\na\n b\n```", "leaf mail", "Kept", "- Two frag"):
        assert part in md
    for part in ("Top header", "menu", "Foot", "track", "var t", "iframe"):
        assert part not in md
    assert "[frag](https://example.com/x#x)" in H.to_markdown(PAGE, "https://example.com/x", "preserve_links")[0]


def test_clean_page():
    page = H.clean_page(PAGE, "https://example.com/x")
    assert (page["title"], page["language"], page["timestamp"]) == ("Test Page", "en", "2026-08-08")
    assert page["links"] == ["https://example.com/link", "https://example.com/x"]


def test_nested_tables_keep_their_headers():
    html = "<table><tr><th>A<th>B<tr><td>1<td><table><tr><th>X<tr><td>y</table></table>"
    md = H.to_markdown(html)[0]
    assert "| A | B |\n| --- | --- |\n| 1 | Xy |" in md and "| X |\n| --- |\n| y |" in md
    assert "| Col 1 | Col 2 |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |" in H.to_markdown("<table><tr><td>1<td>2<tr><td>3</table>")[0]


@given(st.text(alphabet="<>/abp='\" &;!-tdr", max_size=60))
@settings(max_examples=200, deadline=None)
def test_html_never_fails(text):
    H.to_markdown(text)
    H.clean_page(text, "http://x/")


def test_anchor_fallbacks():
    root = H.tree('<a href="/a"><img alt="pic"></a><a href="/b" title="t"></a><a href="/c" aria-label="l"></a>')
    assert H.anchors(root, "http://h/") == [("http://h/a", "pic"), ("http://h/b", "t"), ("http://h/c", "l")]


def test_json_repair_and_schema():
    assert J.repair('x ```json\n{"a":[1,2,],}\n``` y')[0] == {"a": [1, 2]}
    assert J.repair('bla {"a":"}","b":{"c":1}} tail')[0] == {"a": "}", "b": {"c": 1}}
    assert J.repair("no json")[2] is not None and J.repair('{"a": [1, 2')[2] is not None
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}, "t": {"type": "array", "items": {"enum": ["a"]}}}, "additionalProperties": False}
    assert J.violations({"n": 1, "t": ["a"]}, schema) == []
    assert len(J.violations({"n": -1, "t": ["b"], "z": 0}, schema)) == 3 and J.violations({}, schema) == ["$.n: missing"]
    assert J.violations({"n": True}, schema) == ["$.n: not integer"]


def test_budget_truncation():
    md = "# A\nword word\n# B\nword word word"
    assert T.truncate_markdown(md, 50) == (md, 9, False)
    assert T.truncate_markdown(md, 5)[0] == "# A\nword word" and T.truncate_markdown(md, 5)[2]


def test_text_columns(spark):
    assert column(spark, ["<Context>x</context>"], T.sanitize_context) == ["&lt;Context&gt;x&lt;/context&gt;"]
    assert column(spark, ["# Company Name\nACME Corp\n\n- Revenue: $1,000,000"], lambda c: T.extract_field(c, "revenue")) == ["Revenue: $1,000,000"]
    assert column(spark, ["x" * 90 + "\n# Head", "short\r\nline", "", None], lambda c: T.plain_title(c, F.lit("f"))) == ["Head", "short", "f", "f"]
    assert column(spark, ["A b  C!d"], T.slugify) == ["A-b-Cd"]


def pdf(body: bytes, head: bytes = b"") -> bytes:
    return b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode " + head + b" >>\nstream\n" + zlib.compress(body) + b"\nendstream\nendobj"


def test_pdf_text():
    body = b"BT /F1 12 Tf 72 700 Td (A Great Paper Title) Tj 0 -14 Td (Abstract) Tj 0 -14 Td [(Hel) 20 (lo) -250 (world)] TJ T* (exam-) Tj T* (ple of a \\(long\\) text, \\251 2026, with many) Tj T* <6D6F7265> Tj 10 0 Td (words so that it passes the test of length) Tj ET"
    text, title = D.pdf_text(pdf(body))
    assert title == "A Great Paper Title"
    assert "Hello world" in text and "example of a (long) text" in text and "more words so that" in text
    with pytest.raises(ValueError):
        D.pdf_text(pdf(b"BT (few words) Tj ET"))
    with pytest.raises(ValueError):
        D.pdf_text(b"no pdf")
    with pytest.raises(ValueError):
        D.pdf_text(pdf(body, b"/Type /XRef"))


def test_router():
    assert D.to_document("u", "text/html", b' {"title":"T","x":"<"}')[0] == '# T\n\n```json\n{\n  "title": "T",\n  "x": "\\u003c"\n}\n```'
    assert D.to_document("", "text/xml", b"<r><title>Hi</title><b>x</b>y</r>")[2] == "Hi"
    assert D.to_document("u", "application/xml", b"<broken")[2] == "u"
    assert D.to_document("u", "text/plain", b"first\nsecond")[0] == "# first\n\nfirst\nsecond"
    assert "image/png" in D.to_document("", "", b"\x89PNG\r\n")[3] and D.to_document("", "image/svg+xml", b"<svg></svg>")[3] is None
    assert D.to_document("", "application/octet-stream", b"\x00\x01\x02")[3] is not None
    assert D.to_document("u", None, None)[3] is None


def test_highlight():
    body = "one two three running four " + " ".join(f"w{i}" for i in range(40))
    got = R.highlight(body, ["runs"])
    assert "<mark>running</mark>" in got and got.endswith("...")
    got = R.highlight(" ".join(["match"] * 60), ["match"])
    assert len(got) <= 180 + len("</mark>...") and got.count("<mark>") == got.count("</mark>")
    assert R.highlight("", ["x"]) == "" and R.highlight("a b", []) == "a b"


def test_robots_and_sitemaps():
    rules = S.robots_rules("User-agent: a # c\nUser-agent: b\nDisallow: /x\nDisallow:\nUser-agent: *\nDisallow: /y\nAllow: /z")
    assert rules == [(0, "a", "/x"), (0, "b", "/x"), (1, "*", "/y")]
    import gzip

    data = b"<urlset xmlns='x'><url><loc> https://a/b </loc></url><url><loc>ftp://x</loc></url></urlset>"
    assert S.sitemap_urls(data) == S.sitemap_urls(gzip.compress(data)) == ("urlset", ["https://a/b"])
    for bad in (b"", b"<html></html>", b"<urlset>"):
        with pytest.raises(ValueError):
            S.sitemap_urls(bad)


def test_result_pages():
    html = '<div class="result"><h2><a class="result__a" href="//engine.example/l/?uddg=https%3A%2F%2Fa.com%2Fx">A</a></h2><a class="result__snippet">text</a></div><div class="result"><a class="result__a" href="https://a.com/x">dup</a></div><div class="result"><a class="result__a" href="https://a.com/p.png">img</a></div>'
    assert S.result_rows(html, "engine.example") == [("A", "https://a.com/x", "text")]
    assert S.result_rows('<a href="https://b.com/">B</a><a href="/own">x</a>', "engine.example") == [("B", "https://b.com/", "")]


def test_deep_documents_do_not_fail():
    n = 10_000
    deep = "<div>" * n + "x" + "</div>" * n
    assert H.clean_page(deep)["links"] == [] and H.clean_page("<p>" + "<b>" * n + "word</p>")["body"] == "word"
    for page in (deep, "<h1>" + "<b>" * n + "head", "<p>" + "<b>" * n + "text", "<table><tr><td>" + "<i>" * n + "cell"):
        whole = H.to_markdown(page, limits=H.WHOLE)
        assert whole[0].strip().endswith(("x", "head", "text", "|")) and whole[3] == ""
    assert H.to_markdown(deep)[3] == "depth"
    text, words, title, error = D.to_document("u", "application/json", b"[" * 200_000)
    assert error is None and title == "u" and "[[[" in text
    assert "x" in D.to_document("u", "text/xml", b"<a>" * n + b"x" + b"</a>" * n)[0]


def test_limits_of_tables_are_told():
    wide = "<table><tr>" + "".join(f"<td>{i}" for i in range(60)) + "</tr></table>"
    cut, whole = H.to_markdown(wide), H.to_markdown(wide, limits=H.WHOLE)
    assert cut[3] == "columns" and "| 49 |" in cut[0] and " 50 " not in cut[0].split("\n")[-1]
    assert whole[3] == "" and "| 59 |" in whole[0]
    tall = "<table>" + "".join(f"<tr><td>r{i}" for i in range(501)) + "</table>"
    assert H.to_markdown(tall)[3] == "rows" and "r500" in H.to_markdown(tall, limits=H.WHOLE)[0]
    long = f"<table><tr><td>{'y' * 1001}</table>"
    assert H.to_markdown(long)[3] == "cell" and "y" * 1001 in H.to_markdown(long, limits=H.WHOLE)[0]
    assert H.to_markdown("<p>a b c", count=len)[1] == len("# \n\na b c")


def test_pdf_pages_name_their_contents():
    shown = b"BT (" + b"these words stand on the page and there are more than fifteen of them so that it counts well) Tj ET"
    hidden = b"BT (" + b"these words stand in a stream that no page names at all and so nobody ever sees them) Tj ET"
    data = (
        b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents [4 0 R] >>\nendobj\n3 0 obj\n<< /Length 1 >>\nstream\n" + hidden
        + b"\nendstream\nendobj\n4 0 obj\n<< /Length 1 >>\nstream\n" + shown + b"\nendstream\nendobj"
    )
    text, _ = D.pdf_text(data)
    assert "on the page" in text and "nobody" not in text


def test_lost_ligatures_come_back():
    assert D.repair_ligatures("The rst gure is signicant and difcult, specically the eect; Ofce benets were dened") == (
        "The first figure is significant and difficult, specifically the effect; Office benefits were dened"
    )
    assert D.repair_ligatures("specify the ice, real words in order and at ease") == "specify the ice, real words in order and at ease"


def test_partitions_and_redirects(spark):
    keys = ["a", "", None, "ключ", "long key " * 20]
    assert column(spark, keys, X.partition_of) == [X.ring_hash(k or "") % 16 for k in keys]
    assert column(spark, keys, lambda c: X.shard_of(c, 64)) == [X.fnv1a32((k or "").encode()) % 64 for k in keys]
    engine = "engine.example"
    target = lambda href: S.redirect_target(href, engine)
    assert target(f"//{engine}/l/?uddg=https%3A%2F%2Fa.com%2Fx%3Fq%3D1") == "https://a.com/x?q=1"
    assert target("https://a.com/search?q=abc") == "https://a.com/search?q=abc" and target("https://a.com/x?userid=5") == "https://a.com/x?userid=5"
    assert target(f"https://{engine}/about") is None and S.redirect_target("https://a.com/?to=http://b.com/", engine, "to") == "http://b.com/"

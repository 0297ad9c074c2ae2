"""Operators on small tables."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions.text import stem
from quarryline.operators import crawl as C
from quarryline.operators import fusion as S
from quarryline.operators import graph as G
from quarryline.operators import index as I
from quarryline.operators import lifecycle as L
from quarryline.operators import ranking as R
from quarryline.operators import vectors as V
from quarryline.sources import crawl_files, stores
from quarryline.streaming import ingest


def hits(spark, lexical, dense):
    lex = spark.createDataFrame([(1, d, s, i + 1) for i, (d, s) in enumerate(lexical)], "query_id int, doc_id string, score double, rank int")
    vec = spark.createDataFrame([(1, d, s, i + 1) for i, (d, s) in enumerate(dense)], "query_id int, doc_id string, similarity double, rank int")
    return {r.doc_id: r for r in S.fuse(lex, vec).collect()}


def test_fusion(spark):
    got = hits(spark, [("doc1", 2.5), ("doc2", 1.8)], [("doc2", 0.95), ("doc3", 0.85)])
    assert len(got) == 3 and got["doc2"].rank == 1
    got = hits(spark, [("doc1", 2.5)], [("doc3", 0.85)])
    assert (got["doc1"].bm25_rank, got["doc1"].vector_rank, got["doc3"].bm25_rank, got["doc3"].vector_rank) == (1, None, None, 1)
    got = hits(spark, [("doc1", 10.0), ("doc2", 5.0)], [("doc1", 0.98), ("doc3", 0.75)])
    assert got["doc1"].rrf_score == pytest.approx(0.03279) and all(r.rrf_score <= 0.033 for r in got.values())
    assert len(hits(spark, [], [("zero", 0.0), ("neg", -0.45)])) == 2
    assert hits(spark, [], []) == {}


def test_rerank_prefers_matching_titles(spark):
    rows = [(1, "golang web crawler", "doc1", 0.03, 1, "Cooking", "pasta"), (1, "golang web crawler", "doc2", 0.02, 2, "Golang crawler", "the web")]
    own = spark.createDataFrame(rows, "query_id int, query string, doc_id string, rrf_score double, rank int, title string, snippet string")
    first = S.rerank(own).where("rank = 1").first()
    assert first.doc_id == "doc2" and first.original_rank == 2 and first.rerank_score == pytest.approx(2 + 3.5 + 3.5 + 1.5)


def corpus(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = ["engine", "search", "index", "crawl", "running", "runs", "vector", "the", "rank", "token"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("stems", [False, True])
def test_bm25_equals_plain_scoring(spark, stems):
    rows, docs = corpus(spark)
    queries = [(1, "the running engine engine"), (2, "nothing"), (3, "")]
    one = (lambda w: stem(w)) if stems else (lambda w: w)
    words = {i: [one(w) for w in t.split() if w != "the"] for i, t in rows}
    avg = sum(len(t.split()) for _, t in rows) / len(rows)
    want = {}
    for q, text in queries:
        for term in [one(w) for w in text.split() if w != "the"]:
            df = sum(term in w for w in words.values())
            for i, t in rows:
                tf = words[i].count(term)
                if tf:
                    idf = math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) if len(rows) - df + 0.5 > 0 else 0
                    want[q, i] = want.get((q, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / avg))
    asked = spark.createDataFrame(queries, "query_id int, query string")
    for found in (R.search(docs, asked, 1000, stem=stems), R.search_index(I.build(docs, stem=stems), asked, 1000, stem=stems)):
        got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 6e-4 for k in got)
    assert R.search(docs, asked, 0).count() == 0 and R.search(docs, asked, -1).count() == 0


def test_index_snapshot(spark, tmp_path):
    _, docs = corpus(spark)
    own = I.build(docs, buckets=3, slices=2)
    I.save(own, str(tmp_path / "i"))
    back = I.load(spark, str(tmp_path / "i"))
    assert back.buckets == 3
    for name in ("postings", "doc_len", "terms", "stats", "bounds"):
        there, here = getattr(back, name), getattr(own, name)
        assert there.select(*here.columns).exceptAll(here).count() == 0 and there.count() == here.count()


def test_block_bounds_prune_and_change_nothing(spark):
    """Retrieval by block bounds against scoring all, and no document above its block's bound."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 120)))) for i in range(1500)] + [(9000, None), (9001, "")]
    own = I.build(spark.createDataFrame(rows, "doc_id long, text string"), stem=False)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 4)))) for q in range(30)] + [(99, "nowhere"), (100, None)], "query_id long, query string")
    for k in (1, 3, 10, 5000):
        want = {(r.query_id, r.rank): (r.doc_id, r.score) for r in R.search_index(own, asked, k, stem=False).collect()}
        assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in R.block_max_top(own, asked, k, stem=False).collect()} == want
    bounds = {(r.query_id, r.block): r.bound for r in R.block_bounds(own, asked, stem=False).collect()}
    assert all(r.score <= bounds[r.query_id, r.doc_id // I.BLOCK] + 6e-4 for r in R.search_index(own, asked, 5000, stem=False).collect())
    assert R.block_max_top(own, asked, 0, stem=False).count() == 0


def test_shards_rank_by_their_own_statistics(spark):
    docs = spark.createDataFrame([(0, "apple"), (2, "apple pear"), (4, "plum"), (1, "apple apple kiwi"), (3, "kiwi")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    own = I.build(docs, stem=False)
    got = {r.doc_id: (r.shard, r.score) for r in R.sharded_search(own.postings, own.doc_len, F.col("doc_id") % 2, asked).collect()}
    want = {}
    for shard in (0, 1):
        part = docs.where(F.col("doc_id") % 2 == shard)
        want |= {r.doc_id: (shard, r.score) for r in R.search_index(I.build(part, stem=False), asked, 10, stem=False).collect()}
    assert got == want and len(want) == 3


def test_limits_by_surface():
    assert [R.clamped(None), R.clamped(0), R.clamped(500), R.clamped(70, "web"), R.clamped(None, "cluster"), R.clamped(700, "cluster"), R.clamped(60, "autocomplete")] == [5, 5, 100, 50, 10, 700, 50]
    assert [R.fetched(3), R.fetched(3, "cli"), R.fetched(8, "tools"), R.fetched(12, "tools"), R.fetched(10, "pages", 20)] == [6, 10, 10, 12, 30]


def test_completion(spark):
    terms = spark.createDataFrame([("golang", 10), ("goroutine", 5), ("google", 2), ("other", 9)], "term string, frequency long")
    assert [r.term for r in R.complete(terms, " GO", 5).collect()] == ["golang", "goroutine", "google"]
    assert R.prefix_count(terms.select("term")).first().nodes == len({t[:i] for t in ("golang", "goroutine", "google", "other") for i in range(1, len(t) + 1)})




def test_vectors(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    assert [r[0] for r in df.orderBy("doc_id").select(V.valid(F.col("v"), 2)).collect()] == [True, True, False, False, True]
    unit = {r.doc_id: r.u for r in df.where("doc_id < 2").select("doc_id", V.unit(F.col("v")).alias("u")).collect()}
    assert unit == {0: [0.6, 0.8], 1: [0.0, 0.0]}
    assert df.where("doc_id = 1").select(V.quantize(F.col("v")).alias("q")).first().q.s == 1.0
    small = spark.createDataFrame([(0, [0.1, -0.5, 0.8, -0.3, 0.0])], "i int, v array<double>")
    row = small.select(V.unit(F.col("v")).alias("u"), V.dequantize(V.quantize(F.col("v"))).alias("d")).first()
    assert max(abs(a - b) for a, b in zip(row.u, row.d, strict=True)) <= 0.02
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (8, [-1.0, -1.0])], "query_id long, v array<double>")
    got = [(r.query_id, r.doc_id, r.rank) for r in V.nearest(df.where("doc_id != 2"), asked, 5).orderBy("query_id", "rank").collect()]
    assert got == [(9, 4, 1), (9, 0, 2)]
    assert V.nearest(df, asked.limit(0), 3).count() == 0


def test_nearest_in_blocks_equals_one_block(spark):
    rng = random.Random(1)
    make = lambda n, key: spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)], f"{key} long, v array<double>")
    docs, asked = make(200, "doc_id").cache(), make(20, "query_id").cache()
    assert sorted(map(tuple, V.nearest(docs, asked, 5, block=3).collect())) == sorted(map(tuple, V.nearest(docs, asked, 5).collect()))


def test_int8_recall(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(128)]) for i in range(1000)], "doc_id long, v array<double>").cache()
    asked = docs.where("doc_id < 50").select(F.col("doc_id").alias("query_id"), "v")
    exact = {(r.query_id, r.doc_id) for r in V.nearest(docs, asked, 10).collect()}
    codes = docs.select("doc_id", V.dequantize(V.quantize(F.col("v"))).alias("v"))
    found = {(r.query_id, r.doc_id) for r in V.nearest(codes, asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.97


def ranks(spark, edges, **more):
    return {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "src string, dst string"), **more).collect()}


def test_pagerank(spark):
    got = ranks(spark, [("A", "C"), ("B", "C"), ("A", "C"), (None, "C")])
    assert got["C"] > got["A"] and sum(got.values()) == pytest.approx(1)
    for damping in (0.5, 0.95):
        got = ranks(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("E", "F")], damping=damping, iterations=5)
        assert len(got) == 6 and sum(got.values()) == pytest.approx(1, abs=1e-6)
    assert ranks(spark, []) == {}


def test_levels_and_aliases(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in G.levels(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    pairs = [(f"u{i}", f"u{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")]
    aliases = spark.createDataFrame(pairs, "alias string, canonical string")
    keys = spark.createDataFrame([("u0",), ("u9",), ("x",), ("z",), ("new",), ("s",)], "key string")
    assert {r.key: r.canonical for r in G.resolve_aliases(aliases, keys).collect()} == {"u0": "u9", "u9": "u9", "x": "x", "z": "z", "new": "new", "s": "s"}


def test_subtree_pruning(spark):
    log = [(1, "http://h/a/b/1", 0.005, 10, 2), (2, "http://h/a/b/2", 0.005, 1, 2), (3, "http://h/a/b/3", 0.005, 1, 2), (4, "http://h/a/b/4", 0.5, 1, 2),
           (5, "http://h/a/b/5", 0.005, 1, 2), (6, "http://h/a/b/6", 0.005, 1, 2), (7, "http://h/a/b/7", 0.005, 1, 2), (8, "http://h/a/b/8", 0.9, 1, 2), (9, "http://h/c/d/", 0.0, 1, 1)]
    pruned = C.pruned_subtrees(spark.createDataFrame(log, "seq long, url string, yield double, links int, depth int"))
    assert [tuple(r) for r in pruned.collect()] == [("/a/b/", 2)]
    pages = spark.createDataFrame([("http://h/a/b/x", 2), ("http://h/a/b/y", 3), ("http://h/q", 9)], "url string, depth int")
    assert sorted(r.depth for r in C.unpruned(pages, pruned).collect()) == [2, 9]


def test_frontier_and_crawl(spark):
    links = spark.createDataFrame([("http://h/docs/a", "API guide", 1), ("http://h/docs/a", "x", 3), ("http://h/login", "", 5), ("http://h/seen", "Manual", 0)], "url string, anchor string, depth int")
    seen = spark.createDataFrame([("http://h/seen",)], "url string")
    got = C.frontier(links, seen).collect()
    assert [(r.url, r.depth) for r in got] == [("http://h/docs/a", 1)]
    pages = spark.createDataFrame([(f"http://h/{c}",) for c in "abcde"], "url string")
    edges = spark.createDataFrame([(f"http://h/{a}", f"http://h/{b}") for a, b in ("ab", "ac", "bd", "de", "ea", "az")], "src string, dst string")
    start = pages.where("url = 'http://h/a'")
    assert {r.url[-1]: r.depth for r in C.crawl(pages, edges, start, max_depth=2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert C.crawl(pages, edges, start, max_pages=2).count() == 2
    assert {r.url[-1] for r in C.crawl(pages, edges, start, exclude=("*/b",)).collect()} == {"a", "c"}


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nUser-agent: quarry\nDisallow: /b\nUser-agent: quarrybot\nDisallow: /c")], "domain string, body string")
    rules = crawl_files.read_robots(files)
    pages = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://h/c/d",), ("http://other/a",)], "url string")
    left = lambda agent: sorted(r.url[7:] for r in C.robots_allowed(pages, rules, agent).collect())
    assert left("QuarryBot/1.0") == ["h/a", "h/b", "other/a"] and left("quarry-x") == ["h/a", "h/c/d", "other/a"] and left("zzz") == ["h/b", "h/c/d", "other/a"]


def test_sitemap_index(spark):
    files = [("root", b"<sitemapindex><sitemap><loc>http://h/s1</loc></sitemap><sitemap><loc>http://h/gone</loc></sitemap></sitemapindex>"), ("http://h/s1", b"<urlset><url><loc>http://h/1</loc></url></urlset>"), ("bad", b"<x>")]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in files], "source string, data binary")
    roots = spark.createDataFrame([("root",)], "root string")
    assert [tuple(r) for r in crawl_files.sitemap_pages(df, roots).collect()] == [("root", "http://h/1")]
    assert crawl_files.read_sitemaps(df).where("error is not null").count() == 1


def test_lifecycle(spark):
    schema = "id long, url string, title string, version long, created_at long"
    old = spark.createDataFrame([(1, "a", "old", 1, 10), (2, "b", "stay", 1, 11)], schema)
    new = spark.createDataFrame([(9, "a", "new", 2, 99), (3, "c", "add", 2, 12)], schema)
    assert sorted(map(tuple, L.upsert(old, new).collect())) == [(1, "a", "new", 2, 10), (2, "b", "stay", 1, 11), (3, "c", "add", 2, 12)]
    assert L.delete(old, spark.createDataFrame([("a",)], "url string"), "url").count() == 1
    ttl = spark.createDataFrame([(0,), (-5,), (1,), (10**9,), (1000,)], "s long").select(L.clamp_ttl(F.col("s")).alias("t"))
    assert [r.t for r in ttl.collect()] == [None, 604800, 300, 2592000, 1000]
    now = datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, None), (2, now), (3, now + timedelta(seconds=1))], "id long, expires_at timestamp")
    at = F.lit(now)
    assert [r.id for r in L.active(docs, at).orderBy("id").collect()] == [1, 3] and [r.id for r in L.expired(docs, at).collect()] == [2]
    table = spark.createDataFrame([(1, "u1", "s"), (2, "s", "x"), (3, "s", "y")], "id long, url string, source_url string")
    assert L.find(table, "s").first().id == 2 and L.find(table, "no").count() == 0
    assert [r.id for r in L.listing(table, 0, -4).collect()] == [1, 2, 3] and L.listing(table, 5, 9).count() == 0


def test_offsets(spark):
    rows = [(0, 1, "completed"), (0, 2, "in_flight"), (0, 3, "completed"), (1, 5, "completed"), (1, 6, "completed"), (2, 0, "failed")]
    got = {r.partition: r.committed for r in L.committed(spark.createDataFrame(rows, "partition int, offset long, status string")).collect()}
    assert got == {0: 2, 1: 7, 2: 0}


def test_percentiles(spark):
    own = spark.createDataFrame([(float(v),) for v in random.Random(2).sample(range(1000), 1000)], "v double")
    assert {r.point: r.value for r in L.percentiles(own, "v").collect()} == {0.5: 500.0, 0.9: 900.0, 0.95: 950.0, 0.99: 990.0}


def test_windows_and_buckets(spark):
    t = datetime(2024, 1, 1, 0, 0, 10)
    rows = [(i, "k", t + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 55, 56])]
    events = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    assert [r.allowed for r in L.within_limit(events, "key", 2).orderBy("event_id").collect()] == [True, True, False, True, True]
    assert [r.allowed for r in ingest.token_bucket_batch(events, 0.01, 2).orderBy("event_id").collect()] == [True, True, False, False, False]


@given(st.lists(st.floats(0, 5), max_size=40), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_bucket_never_exceeds_rate_and_capacity(gaps, capacity):
    times = [sum(gaps[: i + 1]) for i in range(len(gaps))]
    allowed, _, _ = ingest.take_tokens(0.5, capacity, float(capacity), None, times)
    for i in range(len(times)):
        for j in range(i, len(times)):
            assert sum(allowed[i : j + 1]) <= capacity + 0.5 * (times[j] - times[i]) + 1e-6


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u", "t", "b", 2, "web", None, datetime(2024, 1, 1), None)], stores.DOCUMENT)
    for driver, where in (("json", str(tmp_path / "j")), ("parquet", str(tmp_path / "p")), ("memory", "held")):
        stores.write_store(docs, driver, where)
        assert stores.read_store(spark, driver, where, multiLine="false").collect() == docs.collect()
    with pytest.raises(ValueError):
        stores.read_store(spark, "other", "x")
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id long, v array<double>")
    for precision, near in (("float64", [3.0, 4.0]), ("float32", [0.6, 0.8]), ("int8", [0.6, 0.8])):
        stores.save_vectors(vectors, str(tmp_path / precision), precision)
        row = stores.load_vectors(spark, str(tmp_path / precision)).first()
        assert row.precision == precision and row.v == pytest.approx(near, abs=0.01)
    raw = spark.createDataFrame([("http://h/x", "<p>", datetime(2024, 1, 2))], "url string, html string, fetched_at timestamp")
    stores.save_raw(raw, str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "day=2024-01-02" / "domain=h").exists()


def test_stream_upserts_replace_documents(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()

    def step(*messages):
        (source / f"{len(list(source.iterdir()))}.txt").write_text("\n".join(messages))
        raw = spark.readStream.schema("value string").text(str(source))
        run = ingest.messages(raw).writeStream.foreachBatch(ingest.upsert_index(index)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()

    step('{"doc_id": 1, "text": "alpha beta", "version": 1}', '{"doc_id": 2, "text": "alpha", "version": 1}', "no json")
    step('{"doc_id": 1, "text": "gamma", "version": 2}', '{"doc_id": 1, "text": "late", "version": 1}')
    post, lengths = ingest.current_index(spark, index)
    assert sorted((r.term, r.doc_id) for r in post.collect()) == [("alpha", 2), ("gamma", 1)]
    assert {r.doc_id: r.dl for r in lengths.collect()} == {1: 1, 2: 1}
    assert len(ingest.versions(spark, index)) == 2
    ingest.compact(spark, index)
    assert len(ingest.versions(spark, index)) == 1
    # A reader that planned before a merge still finds its files; an older version in a later batch changes nothing, also after a merge.
    assert sorted((r.term, r.doc_id) for r in post.collect()) == [("alpha", 2), ("gamma", 1)]
    step('{"doc_id": 1, "text": "old again", "version": 1}', '{"doc_id": 2, "text": "delta", "version": 1}')
    for _ in range(2):
        post, _ = ingest.current_index(spark, index)
        assert sorted((r.term, r.doc_id) for r in post.collect()) == [("delta", 2), ("gamma", 1)]
        ingest.compact(spark, index)
    assert ingest.versions(spark, index) == ["m=2"] and sorted(p.name for p in (tmp_path / "index").iterdir()) == ["m=1", "m=2", "v=2"]


def test_updates_by_address(spark):
    raw = spark.createDataFrame([('{"url": "http://h/1", "title": "T", "text": "one two", "version": 3}',), ('{"title": "no address"}',), ("no json",), (None,)], "value string")
    rows = ingest.addressed(raw).collect()
    assert [(r.text, r.version) for r in rows] == [("T one two", 3)] and rows[0].doc_id == spark.range(1).select(F.xxhash64(F.lit("http://h/1"))).first()[0]
    sent = ingest.outgoing(spark.createDataFrame([(7, "x")], "doc_id long, text string"), "doc_id").first()
    assert sent.key == "7" and sent.value == '{"doc_id":7,"text":"x"}'


def test_upserts_keep_rows_without_a_key_and_order_ties(spark):
    schema = "url string, version int, id int, body string"
    old = spark.createDataFrame([("a", 1, 1, "old"), (None, 1, 2, "x"), ("b", 5, 3, "late")], schema)
    new = spark.createDataFrame([("a", 1, 9, "new"), (None, 1, 8, "y"), ("b", 2, 7, "early"), ("c", None, 6, "c")], schema)
    got = sorted((r.url or "", r.version or 0, r.id, r.body) for r in L.upsert(old, new, keep=("id",)).collect())
    assert got == [("", 1, 2, "x"), ("", 1, 8, "y"), ("a", 1, 1, "new"), ("b", 5, 7, "late"), ("c", 0, 6, "c")]
    assert L.upsert(old.limit(0), new.limit(0)).count() == 0


def test_documents_are_found_by_both_forms_of_an_address(spark):
    rows = [(1, "http://h.com/a", None), (2, "x", "HTTP://H.com:80/a"), (3, "http://h.com/b", None)]
    docs = spark.createDataFrame(rows, "id long, url string, source_url string")
    assert [r.id for r in L.find(docs, "HTTP://H.com:80/a").collect()] == [1]
    assert [r.id for r in L.find(docs, "http://h.com/b").collect()] == [3] and L.find(docs, "http://h.com/c").count() == 0


def test_stateful_token_bucket(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(i, "k", t + timedelta(seconds=i)) for i in range(6)], "event_id long, key string, ts timestamp").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, key string, ts timestamp").parquet(str(tmp_path / "e"))
    run = ingest.token_bucket(stream, 0.25, 2).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.allowed for r in spark.table("bucket").orderBy("event_id").collect()] == [True, True, False, False, True, False]


def test_engine_end_to_end(spark, tmp_path):
    from quarryline.engine import Engine

    docs = spark.createDataFrame([(1, "Go", "Golang engine for search indexing"), (2, "", "cooking pasta at home"), (3, "Crawl", "a crawler feeds the search engine")], "doc_id long, title string, text string")
    engine = Engine(spark, str(tmp_path / "e"))
    engine.build(docs)
    asked = spark.createDataFrame([(7, "golang search")], "query_id long, query string")
    hits = engine.search(asked, 3).orderBy("rank").collect()
    assert hits[0].doc_id == 1 and "<mark>Golang</mark>" in hits[0].snippet and hits[0].bm25_rank == 1 and hits[0].vector_rank == 1
    assert {r.doc_id for r in engine.search(asked, 3, "bm25").collect()} == {1, 3}
    assert engine.complete("se").first().term == "search" and engine.document(2).count() == 1
    assert engine.stats().first().n_docs == 3
    engine.upsert(spark.createDataFrame([(1, "Go", "nothing else")], "doc_id long, title string, text string"))
    assert {r.doc_id for r in engine.search(asked, 3, "bm25").collect()} == {3}
    engine.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert engine.search(asked, 3, "bm25").count() == 0 and engine.stats().first().n_docs == 2


def test_small_operators(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "doc_id long, v array<double>")
    assert V.similarity_to(v, 1, [3.0, 4.0]).first().similarity == 1.0
    assert V.checked(v, 2).count() == 2
    with pytest.raises(Exception, match="finite"):
        V.checked(v, 3).collect()
    pages = spark.createDataFrame([("<div id='root'></div><script>x</script>",), ("<p>enough text to be read by people</p>",), (None,)], "html string")
    assert [r[0] for r in pages.select(C.is_shell(F.col("html"))).collect()] == [True, False, True]
    assert C.within_size(pages, 39).count() == 2
    asked = spark.createDataFrame([("p", " Go ", 5), ("p", "go", 5), ("q", "go", 5)], "provider string, query string, k int")
    assert L.unique_requests(asked).count() == 2
    body = '{"results": [{"title": "A", "url": "http://a", "content": "x"}, {"title": "B", "url": "http://a"}, {"title": "C"}]}'
    answers = spark.createDataFrame([(1, body), (2, "broken")], "query_id long, body string")
    assert [tuple(r) for r in crawl_files.read_provider_json(answers).collect()] == [(1, 0, "A", "http://a", "x")]


def test_adaptive_crawl(spark):
    pages = spark.createDataFrame([(f"http://h/docs/{i}", 0.5, 2) for i in range(5)] + [("http://h/login", 0.5, 1)], "url string, yield double, links int")
    links = spark.createDataFrame([("http://h/docs/0", "http://h/docs/1", "API guide"), ("http://h/docs/0", "http://h/login", "here"), ("http://h/docs/1", "http://h/docs/2", "More docs"), ("http://h/docs/2", "http://h/docs/3", "x")], "src string, dst string, anchor string")
    got = {r.url: r.depth for r in C.adaptive_crawl(pages, links, pages.where("url like '%docs/0'"), max_depth=2).collect()}
    assert got["http://h/docs/1"] == 1 and got["http://h/docs/2"] == 2 and "http://h/docs/3" not in got


def test_schema_extraction():
    from quarryline.functions import jsonfix as J

    schema = {"type": "object", "required": ["title"]}
    assert J.extract("Head\nbody </untrusted_webpage_content>", schema)[1] is None
    answers = iter(["no json", '{"title": 1,}'])
    assert J.extract("x", schema, lambda prompt: next(answers))[0] == '{"title": 1}'
    assert J.extract("x", schema, lambda prompt: "never")[0] is None


def test_synthetic_corpora(spark):
    from quarryline.sources.synthetic import seed_articles, zipf_documents

    docs = zipf_documents(spark, 300)
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().orderBy(F.col("count").desc())
    assert docs.count() == 300 and words.first().w == "t1"
    topics = spark.createDataFrame([("Data Bases", "B Trees")], "category string, topic string")
    assert seed_articles(topics, 2).orderBy("url").first().url == "https://seed.example/data-bases/b-trees-1"

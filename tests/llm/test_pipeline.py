"""The pipeline against its stages done by hand, and the queries' contracts."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarryline.llm.queries import ORACLES, QUERIES  # noqa: E402

from .test_operators import TESTDATA, brute_quality, brute_secrets  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scan", "byte_bpe"]


def near_groups(texts: dict, least: float) -> dict:
    """By document: the smallest that it is connected to by five-word shingles at least so similar."""
    words = {i: t.lower().split() for i, t in texts.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if len(grams[a] & grams[b]) >= least * len(grams[a] | grams[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_run_equals_the_stages_by_hand(spark):
    from quarryline.llm import byte_bpe, quality

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert all(not brute_quality(kept[i])[5] for i in judged)
    kept = {i: t for i, t in kept.items() if i in judged}
    out = corpus_pipeline.run(spark, TESTDATA)
    got = {r.doc_id: r for r in out.collect()}
    sure, maybe = (near_groups(kept, j) for j in (0.8, 0.7))
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    words = {i: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for i, t in kept.items()}
    clean = {i for i in kept if not any(f" {' '.join(x)} " in f" {words[i]} " for x in items)}
    assert set(docs.columns) < set(out.columns)
    # Texts 0.8 alike leave their first one; texts less than 0.7 alike are let alone.
    assert {i for i in clean if maybe[i] == i} <= set(got) <= {i for i in clean if sure[i] == i}
    codec = byte_bpe.replay_of(*byte_bpe.default_ranks())
    for i, r in got.items():
        assert not brute_secrets(r.text)
        assert codec.decode(list(r.token_ids)) == r.text.encode() and r.round_trip and r.n_tokens == len(r.token_ids)
        if not brute_secrets(kept[i]):
            assert r.text == kept[i]


def test_stages_take_odd_rows(spark):
    rows = [(None, None, "en", "s", None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 40_000, "en", "s", 1), (4, "Same text of more than ten words in one line here ok then", "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TESTDATA)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), TESTDATA).count() == 0
    corpus_pipeline.STAGES[-1][1](spark, docs, TESTDATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    got = QUERIES[name](spark, TESTDATA)
    names = sorted(got.columns)
    result = con.execute(ORACLES[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == names
    want = Counter(tuple(r[order.index(c)] for c in names) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want

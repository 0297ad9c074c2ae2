"""Operators whose cost must grow no faster than their input: what they exchange and hold, and that results are whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import index as I
from quarryline.operators import ranking as R
from quarryline.plans import QUERIES

from .conftest import TESTDATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_documents(spark):
    rng = random.Random(8)
    words = ["The", "running", "engine", "«Ünï»", "(don't)", "...", "", "İx", "\x1cy", "a b", "c d", "e\nf", '"g"', "a", "\U0001f600"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(-70, 300)]
    rows += [(5, "engine twice engine"), (5, None), (7, "\t engine \r\n")] + [(1 << 40, "far engine"), (400, None), (401, " 　 ")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def grouped(docs, stems=False):
    """Postings by an exchange of each token."""
    terms = T.stemmed(T.tokens(docs)) if stems else T.tokens(docs)
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


@pytest.mark.parametrize("stems", [False, True])
def test_index_exchanges_documents_not_tokens(spark, stems, monkeypatch):
    monkeypatch.setattr(I, "CHUNK", 2000)
    docs = odd_documents(spark)
    own = I.build(docs, stem=stems)
    said = plan(own.segments)
    assert said.count("Exchange hashpartitioning") == 1 and said.index("MapInArrow") < said.index("Exchange")
    want = grouped(docs, stems)
    got = own.postings.select("term", "doc_id", "tf", "positions")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    lengths = I.doc_lengths(docs.where("doc_id not in (5, 7)"))
    assert own.postings.where("doc_id not in (5, 7)").select("doc_id", "dl").distinct().exceptAll(lengths).count() == 0
    blocks = own.postings.withColumn("block", F.floor(F.col("doc_id") / I.BLOCK)).groupBy("term", "block")
    bounds = blocks.agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_len"), F.max("doc_id").alias("max_id"))
    got = own.bounds.select(*bounds.columns)
    assert got.count() == bounds.count() and got.exceptAll(bounds).count() == 0


def hits(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_exchange_postings_not_pairs(spark, monkeypatch):
    """Postings go to their document once; pairs of queries and documents are added up and cut in the task."""
    monkeypatch.setattr(R, "PAIRS", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 8)))) for i in range(400)] + [(1 << 50, "a b c"), (None, "a a b")]
    own = I.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3), stem=False)
    asked = spark.createDataFrame([(q, " ".join(rng.choices("abcdefghz", k=rng.randint(0, 5)))) for q in range(40)] + [(None, "b c")], "query_id long, query string")
    found = R.search_index(own, asked, 7, stem=False)
    said = plan(found)
    behind, before = said.split("MapInArrow", 1)
    assert "Exchange hashpartitioning(query_id" in behind and behind.count("Exchange ") == 1 and "Exchange hashpartitioning(doc_id" in before
    listed = hits(found)
    monkeypatch.setattr(R, "HELD", 0)  # as tables, by joins
    assert listed == hits(R.search_index(own, asked, 7, stem=False)) and len(listed) > 200


def test_shards_exchange_postings_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 50)
    rng = random.Random(4)
    own = I.build(spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 8)))) for i in range(300)], "doc_id long, text string"), stem=False)
    asked = spark.createDataFrame([(q, " ".join(rng.choices("abcdefgh", k=3))) for q in range(20)], "query_id long, query string")
    columns = ["query_id", "shard", "doc_id", "score", "match_count", "rank"]
    found = R.sharded_search(own.postings, own.doc_len, F.col("doc_id") % 4, asked, 5).select(*columns)
    assert "MapInArrow" in plan(found).split("hashpartitioning(doc_id")[0]
    listed = hits(found)
    monkeypatch.setattr(R, "HELD", 0)
    assert listed == hits(R.sharded_search(own.postings, own.doc_len, F.col("doc_id") % 4, asked, 5).select(*columns)) and len(listed) == 20 * 4 * 5


def test_words_are_hashed_side_by_side(monkeypatch):
    """Embeddings of many texts equal those of each, bit for bit."""
    rng = random.Random(5)
    words = ["a", "the", "bb", "ccc", "dddd", "<tag>", "straße", "İx", "don't", "x" * 33, "\0z", "long-hyphened-word", "--", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "\u3000"]
    want = [T.embed(t or "").tolist() for t in texts]
    assert T.embed_all(texts).tolist() == want
    monkeypatch.setattr(T, "EMBED_CHARS", 100)
    monkeypatch.setattr(T, "EMBED_WORDS", 5)
    assert T.embed_all(texts).tolist() == want and T.embed_all([]).shape == (0, 128)


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_embedded", "rerank_boost", "agentic_synthesis", "two_stage_rescore"])
def test_hits_go_to_the_documents(spark, name):
    """Tables of documents or vectors are not exchanged for the few that were hit, whatever Spark takes a table's size for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = plan(QUERIES[name](spark, TESTDATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = []
    for line in said.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan parquet" in line and ("documents.parquet" in line or "embeddings.parquet" in line):
            joins = [i for i, (_, x) in enumerate(above) if "Join" in x or "MapIn" in x]
            assert joins and not any("Exchange hashpartitioning" in x for _, x in above[joins[-1] :]), said


def test_prefixes_are_counted_in_order(spark):
    """Nodes of a trie by sorted terms: no prefix is exchanged, or made at all."""
    rng = random.Random(7)
    terms = [None, "", "é", "\U0001f600\U0001f600", "\uffee", *("".join(rng.choices("abé\U0001f600", k=rng.randint(1, 7))) for _ in range(2000))]
    df = spark.createDataFrame([(t,) for t in terms], "term string").repartition(3)
    found = R.prefix_count(df)
    assert "Generate" not in plan(found) and found.dtypes == [("nodes", "bigint")]
    assert found.first().nodes == len({t[:i] for t in terms if t for i in range(1, len(t) + 1)})
    assert R.prefix_count(df.where("false")).first().nodes == 0


def test_postings_are_counted_where_texts_lie(spark):
    assert "Exchange" not in plan(I.postings(odd_documents(spark).where("doc_id not in (5, 7)")))
    docs = odd_documents(spark)  # two ids come up twice
    want = grouped(docs)
    own = I.postings(docs).select(*want.columns)
    assert own.count() == want.count() and own.exceptAll(want).count() == 0


def test_block_stats_exchange_documents_only(spark):
    said = plan(I.block_stats(odd_documents(spark)))
    assert said.count("Exchange hashpartitioning") == 1 and said.index("MapInArrow") < said.index("Exchange")

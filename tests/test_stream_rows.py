"""An index by streams keeps a row for each document and exchanges no tokens."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators import index as I
from quarryline.streaming import ingest


def postings(docs):
    return docs.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def same(a, b):
    assert a.count() == b.count() and a.select(*b.columns).exceptAll(b).count() == 0


def test_batches_keep_a_row_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "CHUNK", 500)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(["the", "Alpha", "beta,", "gamma", "(delta)", "", "\u2003eps", "..."], k=rng.randint(0, 12)))
    first = spark.createDataFrame([(i, text(), 2) for i in range(100)] + [(200, None, None), (201, "the", 1)], "doc_id long, text string, version int")
    second = spark.createDataFrame([(i, text(), i % 4) for i in range(50, 130)] + [(60, text(), 9)], "doc_id long, text string, version int")
    path = str(tmp_path / "i")
    run = ingest.upsert_index(path)
    run(first, 0)
    assert spark.read.parquet(f"{path}/v=0/documents").count() == 102
    same(ingest.current_index(spark, path)[0], postings(tokens(first)))
    run(second, 1)
    best = {}
    for r in [*first.collect(), *second.collect()]:
        if r.doc_id not in best or (r.version or 0) >= best[r.doc_id][2]:
            best[r.doc_id] = (r.doc_id, r.text, r.version or 0)
    want = spark.createDataFrame(list(best.values()), "doc_id long, text string, version int")
    for _ in range(2):
        post, lengths = ingest.current_index(spark, path)
        same(post, postings(tokens(want)))
        same(lengths, I.doc_lengths(want).join(want.select("doc_id", "version"), "doc_id"))
        ingest.compact(spark, path)

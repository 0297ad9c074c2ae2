"""Rank fusion: RRF, modes, re-ranking, two stages, scatter and gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import RRF_K
from ..functions.numbers import half_away
from ..functions.text import fields, is_stopword, sanitize_context
from .ranking import top_k


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 10, const: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, score, rank) and (query_id, doc_id, similarity, rank).

    A lexical rank counts if its score is above zero, a dense one always."""
    lex = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").cast("int").alias("bm25_rank"))
    vec = dense.select("query_id", "doc_id", F.col("similarity").alias("vector_similarity"), F.col("rank").cast("int").alias("vector_rank"))
    both = lex.join(vec, ["query_id", "doc_id"], "full_outer")
    part = F.when(F.col("bm25_score") > 0, 1.0 / (const + F.col("bm25_rank"))).otherwise(F.lit(0.0))
    total = part + F.coalesce(1.0 / (const + F.col("vector_rank")), F.lit(0.0))
    scored = both.withColumn("raw", half_away(total, 9)).where("raw > 1e-6")
    best = top_k(scored, k, by="raw")
    return best.select("query_id", "doc_id", half_away(F.col("raw"), 5).alias("rrf_score"), "bm25_score", "vector_similarity", "bm25_rank", "vector_rank", "rank")


def only_mode(hits: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Filters fused hits by mode after the limit, so fewer than k may be left."""
    needed = {"bm25": "bm25_rank", "vector": "vector_rank"}.get(mode)
    return hits if needed is None else hits.where(F.col(needed).isNotNull())


def boost(query: Column, title: Column, snippet: Column) -> Column:
    """1.5 for each kept query word found in title or snippet, 2.0 more if in the title; 2 digits."""
    words = F.filter(fields(F.lower(query)), lambda w: ~is_stopword(w))
    name, both = F.lower(title), F.lower(F.concat_ws(" ", title, snippet))
    score = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.contains(both, w), 1.5).otherwise(0.0) + F.when(F.contains(name, w), 2.0).otherwise(0.0))
    return half_away(score, 2)


def rerank(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, query, doc_id, rrf_score, rank, title, snippet) by 100 rrf + boost, 3 digits."""
    score = half_away(100 * F.col("rrf_score") + boost(F.col("query"), F.col("title"), F.col("snippet")), 3)
    scored = hits.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", score)
    return top_k(scored, k, by="rerank_score")


def gather(shard_hits: DataFrame, k: int = 10, key: Column | None = None) -> DataFrame:
    """Merges hits of several shards: of each key the best score, then the k best."""
    own = shard_hits.withColumn("key", F.col("doc_id").cast("string") if key is None else key)
    best = own.groupBy("query_id", "key").agg(F.max(F.struct("rrf_score", (-F.col("doc_id")).alias("neg"))).alias("best"))
    hits = best.select("query_id", (-F.col("best.neg")).alias("doc_id"), F.col("best.rrf_score").alias("rrf_score"))
    return top_k(hits, k, by="rrf_score")


def shard_top(hits: DataFrame, shard: Column, k: int = 10, by: str = "score") -> DataFrame:
    """The k best of each query within each shard."""
    order = Window.partitionBy("query_id", "shard").orderBy(F.col(by).desc(), "doc_id")
    return hits.withColumn("shard", shard).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def two_stage(lexical: DataFrame, similarities: DataFrame, k: int = 10) -> DataFrame:
    """Candidates by BM25, re-scored by vectors, then fused: ``similarities``
    (query_id, doc_id, similarity) are those of the candidates only."""
    candidates = similarities.join(lexical.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").where("similarity > 0")
    return fuse(lexical, top_k(candidates, k, by="similarity"), k)


def synthesize(hits: DataFrame) -> DataFrame:
    """(query_id, answer): a Markdown list of the hits with their sources, in rank order."""
    line = F.format_string("%d. **%s** (score %.4f)\n   %s", F.col("rank"), F.col("title"), F.col("rrf_score"), F.col("snippet"))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return listed.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"))


def context_passages(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits as numbered, escaped passages for a prompt, in rank order."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), sanitize_context(F.col("snippet")))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return listed.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))

"""The engine as one object: documents in, answers to batches of queries out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import embedding
from .operators import fusion, graph, index, lifecycle, ranking, vectors


class Engine:
    """An index of documents (doc_id, title, text) in a folder.

    ``embed`` turns a text column into a vector column; queries are tables
    (query_id, query), so one plan answers all of them."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = embedding, stem: bool = True):
        self.spark, self.path, self.embed, self.stem = spark, path, embed, stem

    def build(self, docs: DataFrame) -> None:
        """Indexes ``docs`` anew: documents, postings, statistics, vectors."""
        docs.write.mode("overwrite").parquet(f"{self.path}/docs")
        own = self.documents()
        index.save(index.build(own, self.stem), f"{self.path}/index")
        text = F.concat_ws(" ", "title", "text")
        own.select("doc_id", self.embed(text).alias("v")).write.mode("overwrite").parquet(f"{self.path}/vectors")

    def upsert(self, docs: DataFrame) -> None:
        """Replaces documents by id and rebuilds; a changed document keeps no old posting."""
        kept = lifecycle.delete(self.documents(), docs.select("doc_id"))
        self.build(graph.cut(kept.unionByName(docs)))

    def delete(self, ids: DataFrame) -> None:
        self.build(graph.cut(lifecycle.delete(self.documents(), ids)))

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def index(self) -> index.Index:
        return index.load(self.spark, f"{self.path}/index")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
        """Hits by mode (hybrid, bm25, vector), with titles and highlighted snippets; 2k of each kind are fused, and the mode filters what is left."""
        lexical = ranking.search_index(self.index(), queries, 2 * k, self.stem)
        dense = vectors.nearest(self.vectors(), queries.select("query_id", self.embed(F.col("query")).alias("v")), 2 * k)
        hits = fusion.only_mode(fusion.fuse(lexical, dense, k), mode)
        return self.hydrate(hits, queries)

    def hydrate(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """``hits`` with titles (the id where there is none) and snippets; vector-only hits have no terms to mark."""
        words = queries.select("query_id", F.split(F.lower(F.trim("query")), r"\s+").alias("words"))
        full = ranking.held(hits).join(self.documents().select("doc_id", "title", "text"), "doc_id").join(words, "query_id")
        marked = F.when(F.col("bm25_rank").isNotNull(), F.col("words")).otherwise(F.array().cast("array<string>"))
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("doc_id").cast("string"))
        return full.withColumn("snippet", ranking.snippet(F.col("text"), marked)).withColumn("title", title).drop("text", "words")

    def complete(self, prefix: str, k: int = 10) -> DataFrame:
        return ranking.complete(self.index().terms.select("term", F.col("cf").alias("frequency")), prefix, k)

    def document(self, doc_id: int) -> DataFrame:
        return self.documents().where(F.col("doc_id") == doc_id)

    def stats(self) -> DataFrame:
        """Documents, tokens, mean length, terms and prefixes."""
        own = self.index()
        return own.stats.withColumn("terms", own.terms.agg(F.count("*").alias("n")).select("n").scalar()).withColumn(
            "nodes", ranking.prefix_count(own.terms.select("term")).select("nodes").scalar()
        )

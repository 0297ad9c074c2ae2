"""Made-up corpora of any size for benches: Zipf words, log-normal lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify


def zipf_documents(spark: SparkSession, n: int, vocabulary: int = 50_000, exponent: float = 1.07, mean: float = 3.6, spread: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, text): words ``t<rank>`` by the inverse of a continuous Zipf law, lengths log-normal; all on the executors."""
    size = F.greatest(F.lit(1), F.exp(mean + spread * F.randn(seed)).cast("int"))
    flat = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), size)).alias("i"))
    top = float(vocabulary) ** (1 - exponent)
    rank = F.floor(F.pow(1 + F.rand(seed + 1) * (top - 1), 1 / (1 - exponent)))
    words = flat.withColumn("w", F.concat(F.lit("t"), F.least(rank, F.lit(vocabulary)).cast("string")))
    return words.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("text"))


def seed_articles(topics: DataFrame, variants: int = 5) -> DataFrame:
    """(url, title, text) for each of ``topics`` (category, topic) in several variants."""
    every = topics.select("category", "topic", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    title = F.format_string("%s: part %d", F.col("topic"), F.col("variant"))
    text = F.format_string("# %s\n\n%s is a subject of %s. This is article %d about %s.", title, F.col("topic"), F.col("category"), F.col("variant"), F.col("topic"))
    return every.select(F.format_string("https://seed.example/%s/%s-%d", slugify(F.lower("category")), slugify(F.lower("topic")), F.col("variant")).alias("url"), title.alias("title"), text.alias("text"))

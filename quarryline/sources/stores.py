"""Document stores: JSON files, Parquet, JDBC tables, memory; raw page sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host, url_key

DOCUMENT = (
    "id long, url string, title string, clean_body string, total_tokens int, source_type string, source_url string, "
    "created_at timestamp, expires_at timestamp"
)


def read_store(spark: SparkSession, driver: str, where: str, **options: str) -> DataFrame:
    """The documents of a store: json (arrays or lines), parquet, memory (a view) or jdbc (options: dbtable, user, ...)."""
    if driver == "json":
        return spark.read.schema(DOCUMENT).option("multiLine", options.get("multiLine", "true")).json(where)
    if driver == "parquet":
        return spark.read.parquet(where)
    if driver == "memory":
        return spark.table(where)
    if driver == "jdbc":
        return spark.read.format("jdbc").option("url", where).options(**options).load()
    raise ValueError(f"unknown store {driver!r}: json, parquet, memory or jdbc")


def write_store(docs: DataFrame, driver: str, where: str, **options: str) -> None:
    """Replaces a store's documents. A file store is written beside the old one by Spark's committer."""
    if driver == "json":
        docs.write.mode("overwrite").json(where)
    elif driver == "parquet":
        docs.write.mode("overwrite").parquet(where)
    elif driver == "memory":
        docs.createOrReplaceTempView(where)
    elif driver == "jdbc":
        docs.write.format("jdbc").mode("overwrite").option("url", where).options(**options).save()
    else:
        raise ValueError(f"unknown store {driver!r}: json, parquet, memory or jdbc")


def save_raw(pages: DataFrame, path: str) -> None:
    """Raw pages (url, html, fetched_at), compressed, by day and host; the key is the url's SHA-256."""
    own = pages.select(url_key(F.col("url")).alias("key"), "url", "html", F.to_date("fetched_at").alias("day"), F.coalesce(host(F.col("url")), F.lit("none")).alias("domain"))
    own.repartition("day", "domain").write.mode("append").partitionBy("day", "domain").option("compression", "gzip").json(path)


def save_vectors(vectors: DataFrame, path: str, precision: str) -> None:
    """A vector snapshot (doc_id, v) with its precision: float64, float32 or int8."""
    from ..operators.vectors import doubles, quantize, unit

    v = doubles(F.col("v"))
    kept = {"float64": v, "float32": unit(v).cast("array<float>"), "int8": quantize(v)}[precision]
    vectors.select("doc_id", kept.alias("v"), F.lit(precision).alias("precision")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, v array<double>, precision) of a snapshot; one without a precision column is float64."""
    from ..operators.vectors import dequantize, doubles

    own = spark.read.parquet(path)
    if "precision" not in own.columns:
        own = own.withColumn("precision", F.lit("float64"))
    v = dequantize(F.col("v")) if own.schema["v"].dataType.typeName() == "struct" else doubles(F.col("v"))
    return own.select("doc_id", v.alias("v"), "precision")

"""Streams: index upserts, deduplication, token buckets, rate windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import packed, repeated, unpacked

MESSAGE = "doc_id long, text string, version long"
UPDATE = "url string, title string, text string, version long"


def messages(raw: DataFrame, schema: str = MESSAGE, key: str = "doc_id") -> DataFrame:
    """Parsed messages of a stream with a ``value`` (Kafka's, or a file's lines); malformed ones and those without a key are left out."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*").where(F.col(key).isNotNull())


def addressed(raw: DataFrame) -> DataFrame:
    """The messages of a second stream, index updates by address (url, title, text, version): the document's number
    follows from its address, so both streams may feed one index."""
    own = messages(raw, UPDATE, "url")
    return own.select(F.xxhash64("url").alias("doc_id"), F.concat_ws(" ", "title", "text").alias("text"), "version")


def publish(docs: DataFrame, key: str, **kafka: str) -> None:
    """``docs`` as JSON messages, keyed so that a key's messages stay in order; kafka: topic, bootstrap servers and
    other options of the sink. Needs Spark's Kafka connector."""
    sink = outgoing(docs, key).write.format("kafka").option("kafka.acks", "all")
    for name, value in kafka.items():
        sink = sink.option(name.replace("_", "."), value)
    sink.save()


def outgoing(docs: DataFrame, key: str) -> DataFrame:
    """(key, value) of messages to be published."""
    return docs.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*docs.columns)).alias("value"))


def upsert_index(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the batch's documents to the index at ``path``.

    A batch writes its own documents, a row of packed postings for each, under its
    number and then marks it whole, so a batch that is run again overwrites only
    itself, readers never see half of one, and the cost of a batch is its own size.
    Texts are exchanged only if a document comes up twice in a batch. Readers take
    each document from the batch that has its highest version, of equal versions
    from the latest batch; so an old message that comes late changes nothing, and all
    postings of a replaced document go. :func:`compact` merges batches."""

    def run(batch: DataFrame, number: int) -> None:
        own = batch.select("doc_id", "text", F.coalesce("version", F.lit(0)).alias("version"))
        if repeated(own):
            own = own.groupBy("doc_id").agg(F.max(F.struct("version", "text")).alias("m")).select("doc_id", "m.text", "m.version")
        _write(f"{path}/v={number}", packed(own))

    return run


def _write(folder: str, own: DataFrame) -> None:
    own.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/documents")
    own.sparkSession.createDataFrame([(1,)], "n long").write.mode("overwrite").parquet(f"{folder}/done")


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind``=number of an index that are whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and fs.exists(hadoop(f"{path}/{n}/done/_SUCCESS")))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up an index: the latest merged one, and the batches since."""
    merged = _whole(spark, path, "m")[-1:]
    since = [v for v in _whole(spark, path, "v") if not merged or v > merged[0]]
    return [*(f"m={m}" for m in merged), *(f"v={v}" for v in since)]


def _current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packed documents, doc_len): each document as its highest version has it."""
    folders = versions(spark, path)
    if not folders:
        raise FileNotFoundError(f"no index at {path}")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/[vm]=(\d+)/", 1).cast("long")
    own = spark.read.parquet(*(f"{path}/{f}/documents" for f in folders))
    if len(folders) == 1:
        return own, own.select("doc_id", "dl", "version")
    own = own.withColumn("batch", number)
    latest = own.groupBy("doc_id").agg(F.max_by(F.struct("dl", "version", "batch"), F.struct("version", "batch")).alias("l")).select("doc_id", "l.*")
    kept = own.join(latest.select("doc_id", "batch").hint("shuffle_hash"), ["doc_id", "batch"], "left_semi")
    return kept.drop("batch"), latest.drop("batch")


def current_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_len): each document as its highest version has it. However many batches there are, the plan scans one table."""
    own, latest = _current(spark, path)
    return unpacked(own), latest


def compact(spark: SparkSession, path: str) -> None:
    """Writes what all batches say as one merged folder; between batches only.

    The merged folder counts once it is whole, and nothing that it replaces is
    deleted before: what an earlier merge replaced goes now, what this one
    replaces goes with the next, so readers with open plans find their files."""
    batches, before = _whole(spark, path, "v"), _whole(spark, path, "m")[-1:]
    if not batches or before == [batches[-1]]:
        return
    _write(f"{path}/m={batches[-1]}", _current(spark, path)[0])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if before:
        for old in [*(f"v={v}" for v in batches if v <= before[0]), *(f"m={m}" for m in _whole(spark, path, "m") if m < before[0])]:
            fs.delete(hadoop(f"{path}/{old}"), True)


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose key has not come up within ``late`` of event time."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rate_windows(stream: DataFrame, key: str, ts: str = "ts", minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Events by key and tumbling window; late rows count until the watermark passes."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes"), key).agg(F.count("*").alias("n"))


BUCKET_ROW = "key string, ts timestamp, event_id long, allowed boolean"


def take_tokens(rate: float, capacity: float, tokens_left: float, last: float | None, times: list[float]) -> tuple[list[bool], float, float | None]:
    """A token bucket over event times (seconds): who is allowed, the tokens left, the last time."""
    out = []
    for t in times:
        if last is not None:
            tokens_left = min(capacity, tokens_left + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens_left >= 1)
        if out[-1]:
            tokens_left -= 1
    return out, tokens_left, last


def token_bucket(stream: DataFrame, rate: float, capacity: float) -> DataFrame:
    """``stream`` (key, ts, event_id) with ``allowed``, by a bucket for each key that fills by ``rate`` a second."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        seconds = [t.timestamp() for t in rows["ts"]]
        allowed, left, last = take_tokens(rate, capacity, left, last, seconds)
        state.update((left, last))
        yield rows[["key", "ts", "event_id"]].assign(allowed=allowed)

    own = stream.select(F.col("key").cast("string").alias("key"), "ts", "event_id")
    return own.groupBy("key").applyInPandasWithState(run, BUCKET_ROW, "left double, last double", "append", GroupStateTimeout.NoTimeout)


def token_bucket_batch(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """The same over a table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        allowed, _, _ = take_tokens(rate, capacity, float(capacity), None, [t.timestamp() for t in rows["ts"]])
        return rows[["key", "ts", "event_id"]].assign(allowed=allowed)

    own = events.select(F.col("key").cast("string").alias("key"), "ts", "event_id")
    return own.groupBy("key").applyInPandas(run, BUCKET_ROW)


def sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Bursts of a key: events less than ``gap`` apart, as one row each (a debounced save)."""
    own = stream if late is None else stream.withWatermark(ts, late)
    return own.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")

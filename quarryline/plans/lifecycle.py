"""Documents over time, limits, offsets, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.graph import shared_dir
from ..streaming import ingest
from .registry import query, table

NOW = "2024-01-15 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


TTL = "(event_id % 7 - 1) * 500000"


@query(f"SELECT event_id, CASE WHEN {TTL} = 0 THEN NULL WHEN {TTL} < 0 THEN 604800 ELSE least(greatest({TTL}, 300), 2592000) END AS ttl FROM events")
def ttl_clamp(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", L.clamp_ttl((F.col("event_id") % 7 - 1) * 500_000).cast("long").alias("ttl"))


@query(
    f"""SELECT event_id FROM (SELECT event_id, ts, CASE WHEN event_id % 7 = 1 THEN NULL ELSE ts + INTERVAL 5 DAY END AS expires_at FROM events)
    WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'"""
)
def ttl_active(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 1, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    return L.active(own, F.lit(NOW).cast("timestamp")).select("event_id")


@query("SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, min(event_id) AS id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of their user's row; the id stays the first one."""
    own = events(spark, d).select("user_id", F.col("event_id").alias("version"), "event_type", F.col("event_id").alias("id"))
    return L.upsert(own.where("version % 2 = 0"), own.where("version % 2 = 1"), key="user_id", keep=("id",))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return L.delete(table(spark, d, "documents").select("doc_id"), gone)


@query(
    f"""SELECT event_id AS job_id FROM (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 10 MINUTE END AS finished FROM events)
    WHERE finished IS NULL OR finished > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR ORDER BY ts DESC, event_id LIMIT 1000"""
)
def job_eviction(spark: SparkSession, d: str) -> DataFrame:
    jobs = events(spark, d).select(
        F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at")
    )
    return L.evict_jobs(jobs, F.lit(NOW).cast("timestamp")).select("job_id")


@query(
    """SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS last_ids FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10 GROUP BY user_id"""
)
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).select("user_id", "event_id", F.col("event_id").cast("string").alias("said"))
    return L.recent(own, "user_id", "event_id", "said").select("user_id", F.array_join("values", " ").alias("last_ids"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 60 MINUTE, ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return L.within_limit(events(spark, d), "user_id", 1, minutes=60).select("event_id", "allowed")


@query(
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1440 MINUTE, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) <= CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS allowed FROM events"""
)
def tenant_quota(spark: SparkSession, d: str) -> DataFrame:
    """Daily quotas of three tiers."""
    own = events(spark, d)
    tiers = [L.within_limit(own.where(F.col("user_id") % 3 == t), "user_id", most, minutes=1440) for t, most in enumerate((1, 2, 3))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).select("event_id", "allowed")


@query("SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def tenant_usage(spark: SparkSession, d: str) -> DataFrame:
    return L.usage(events(spark, d), "event_type", "value")


@query(
    """WITH o AS (SELECT user_id AS partition, event_id AS offset_, CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events)
    SELECT partition, coalesce(min(CASE WHEN status <> 'completed' THEN offset_ END), max(offset_) + 1) AS committed FROM o GROUP BY partition"""
)
def offset_watermark(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 50 == 0, "failed").otherwise("completed")
    return L.committed(events(spark, d).select(F.col("user_id").alias("partition"), F.col("event_id").alias("offset"), status.alias("status")))


@query(
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS point)
    SELECT CAST(point AS DOUBLE) AS point, value FROM r, p WHERE i = least(CAST(floor(CAST(point AS DOUBLE) * n) AS BIGINT), n - 1)"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return L.percentiles(events(spark, d).select("value"), "value")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def store_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of the store: limit and offset are the feature."""
    return L.listing(table(spark, d, "orders").select("o_orderkey"), 20, 40, by="o_orderkey")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT user_id, event_id, t, n, CAST(2 AS DOUBLE) AS room FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, least(2, b.room - CASE WHEN b.room >= 1 THEN 1 ELSE 0 END + (e.t - b.t) * (CAST(1 AS DOUBLE) / 3600)) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, room >= 1 AS allowed FROM b"""
)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Two events at once and one more an hour, for each user."""
    own = events(spark, d).withColumn("key", F.col("user_id"))
    return ingest.token_bucket_batch(own, rate=1 / 3600, capacity=2).select("key", "event_id", "allowed")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL),
    s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_bursts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(events(spark, d), "user_id", "2 hours")


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS BIGINT) AS dl FROM documents")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream of messages, upserted batch by batch into an index; its document lengths."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    docs.select(F.to_json(F.struct("doc_id", "text", F.lit(1).alias("version"))).alias("value")).write.text(f"{folder}/in")
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 64).text(f"{folder}/in")
    run = ingest.messages(raw).writeStream.foreachBatch(ingest.upsert_index(f"{folder}/index")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return ingest.current_index(spark, f"{folder}/index")[1].select("doc_id", "dl")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS version,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS BIGINT) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS dl FROM documents"""
)
def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of messages with a merge between and behind them; for two documents of three the second batch brings an
    older version, which must change nothing."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = ingest.upsert_index(folder)
    run(docs.withColumn("version", F.lit(2)), 0)
    ingest.compact(spark, folder)
    run(docs.select("doc_id", F.concat("text", F.lit(" late message")).alias("text"), F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1).alias("version")), 1)
    ingest.compact(spark, folder)
    return ingest.current_index(spark, folder)[1].select("doc_id", "version", "dl")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-15 00:00:00' OR event_id % 7 = 1")
def janitor(spark: SparkSession, d: str) -> DataFrame:
    """What a janitor leaves: the table without the keys that it hands on for deletion elsewhere."""
    own = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 1, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    _, gone = L.purge(own, F.lit(NOW).cast("timestamp"), key="event_id")
    return L.delete(own, gone, "event_id").select("event_id")

"""Documents over time: upserts, expiry, deletion, lookups, limits, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TTL_DEFAULT, TTL_MAX, TTL_MIN
from ..functions.urls import canonical
from .graph import cut


def upsert(old: DataFrame, new: DataFrame, key: str = "url", version: str = "version", keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """``old`` with the latest version of each key from ``new``; columns in
    ``keep`` stay those of the first version. One exchange by key. Of equal
    versions that of ``new`` counts, of several such rows always the same one;
    rows without a key are no versions of one another and all stay."""
    names = [c for c in old.columns if c != key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(version), F.col("_new"), F.xxhash64(F.to_json(F.struct(*names))))
    first = F.min_by(F.struct(*[c for c in keep if c in names] or names[:1]), order)
    latest = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), order).alias("l"), first.alias("f"))
    own = latest.select(*[F.col(key) if c == key else F.col(f"f.{c}" if c in keep else f"l.{c}").alias(c) for c in old.columns])
    return own.unionByName(both.where(F.col(key).isNull()).select(*old.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``table`` without the keys' rows; the same for postings, lengths and vectors."""
    return table.join(keys.select(key), key, "left_anti")


def clamp_ttl(seconds: Column, default: int = TTL_DEFAULT) -> Column:
    """0: none (null); below 0: the default; else within the limits."""
    return F.when(seconds == 0, F.lit(None)).when(seconds < 0, F.lit(default)).otherwise(F.least(F.greatest(seconds, F.lit(TTL_MIN)), F.lit(TTL_MAX)))


def active(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired at ``now``."""
    return table.where(F.col(expires).isNull() | (F.col(expires) > now))


def expired(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return table.where(F.col(expires) <= now)


def purge(table: DataFrame, now: Column, expires: str = "expires_at", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What a janitor leaves of a table at ``now``, and the keys (key) that it takes, to be deleted elsewhere too."""
    return active(table, now, expires), expired(table, now, expires).select(key)


def find(table: DataFrame, address: str) -> DataFrame:
    """The document at an address as it is written or in its canonical form: by url before source_url, by the
    address as written before its canonical form, then the smallest id."""
    forms = [address] + [x for x in [canonical(address)] if x and x != address]
    places = [F.col(c) == f for c in ("url", "source_url") for f in forms]
    rank = F.coalesce(*[F.when(p, F.lit(i)) for i, p in enumerate(places)])
    return table.withColumn("_at", rank).where("_at is not null").orderBy("_at", "id").limit(1).drop("_at")


def usage(log: DataFrame, tenant: str, amount: str) -> DataFrame:
    """(tenant, tokens): whole tokens used by each tenant; rows without an amount use none."""
    return log.groupBy(tenant).agg(F.coalesce(F.sum(F.floor(amount)), F.lit(0)).cast("long").alias("tokens"))


def listing(table: DataFrame, limit: int, offset: int, by: str = "id") -> DataFrame:
    """A page in order of ids; a negative offset is 0, a limit of 0 or less is none."""
    ordered = table.orderBy(by).offset(max(0, offset))
    return ordered.limit(limit) if limit > 0 else ordered


def evict_jobs(jobs: DataFrame, now: Column, most: int | None = 1000, seconds: int = 3600) -> DataFrame:
    """Jobs that stay: unfinished ones, and of those finished within ``seconds`` the ``most`` latest in all (None: all)."""
    alive = jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") > now - F.expr(f"INTERVAL {seconds} SECONDS")))
    return alive if most is None else alive.orderBy(F.col("created_at").desc(), "job_id").limit(most)


def recent(log: DataFrame, key: str, order: str, value: str, n: int = 10) -> DataFrame:
    """(key, values): the last n values of each key, oldest first."""
    rank = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = log.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= n)
    return last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def within_limit(events: DataFrame, key: str, most: int, ts: str = "ts", minutes: int = 1, tie: str = "event_id") -> DataFrame:
    """Events with ``allowed``: among the first ``most`` of their key in their window of ``minutes``."""
    own = events.withColumn("_w", F.window(ts, f"{minutes} minutes").start)
    order = Window.partitionBy(key, "_w").orderBy(ts, tie)
    return own.withColumn("allowed", F.row_number().over(order) <= most).drop("_w")


def committed(offsets: DataFrame) -> DataFrame:
    """(partition, committed): the offset to commit, just behind the longest
    run of completed messages: never past one that is in flight or failed."""
    own = offsets.groupBy("partition").agg(F.min(F.when(F.col("status") != "completed", F.col("offset"))).alias("stop"), F.max("offset").alias("last"))
    return own.select("partition", F.coalesce("stop", F.col("last") + 1).alias("committed"))


def ranked(samples: DataFrame, value: str) -> DataFrame:
    """``samples`` with the column ``position``, from 0 in order of ``value``, over
    all rows: ranges are sorted apart, and each begins where those before it end."""
    own = cut(samples.where(F.col(value).isNotNull()).repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(value)) - 1
    return own.withColumn("_at", place).join(before, "_part").withColumn("position", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def percentiles(samples: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), by: str | None = None) -> DataFrame:
    """(point, value), exact: the sample at position floor(p n), of all rows or of each ``by``."""
    keys = [by] if by else []
    if by:
        order = Window.partitionBy(by).orderBy(value)
        placed = samples.where(F.col(value).isNotNull()).withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    else:
        placed = ranked(samples, value)
    size = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    spots = size.select(*keys, "_n", F.explode(F.array(*map(F.lit, points))).alias("point"))
    spots = spots.withColumn("position", F.least(F.floor(F.col("point") * F.col("_n")), F.col("_n") - 1))
    return placed.join(spots, [*keys, "position"]).select(*keys, "point", F.col(value).alias("value"))


def unique_requests(requests: DataFrame) -> DataFrame:
    """Of equal requests (provider, query up to case and outer spaces, k) one."""
    own = requests.withColumn("_q", F.lower(F.trim("query")))
    return own.dropDuplicates(["provider", "_q", "k"]).drop("_q")


def cached(entries: DataFrame, now: Column, hours: int = 24, most: int | None = 10_000, at: str = "fetched_at", key: str = "domain") -> DataFrame:
    """Cache entries that are still fresh; of those the ``most`` latest (None: all)."""
    fresh = entries.where(F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS"))
    return fresh if most is None else fresh.orderBy(F.col(at).desc(), key).limit(most)

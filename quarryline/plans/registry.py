"""Queries by name, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import index as I
from ..operators.graph import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame; ``sql`` is its twin."""

    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


#: FNV-1a of the bytes of key: h0 of 64 bits (h) and of 32 (h32), hashed with the 64 bits spread.
RING_SQL = """k AS (SELECT key, hex(encode(key)) AS x FROM keys),
b AS (SELECT key, list_transform(range(0, length(x) // 2), lambda i: CAST(16 * instr('0123456789ABCDEF', x[2 * i + 1]) + instr('0123456789ABCDEF', x[2 * i + 2]) - 17 AS UHUGEINT)) AS bytes FROM k),
h0 AS (SELECT key, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), bytes), lambda h, y: (xor(h, y) * CAST(1099511628211 AS UHUGEINT)) % two64) AS h, list_reduce(list_prepend(CAST(2166136261 AS UHUGEINT), bytes), lambda h, y: (xor(h, y) * CAST(16777619 AS UHUGEINT)) % CAST(4294967296 AS UHUGEINT)) AS h32 FROM b),
h1 AS (SELECT key, h32, (xor(h, h >> 33) * CAST(18397679294719823053 AS UHUGEINT)) % two64 AS h FROM h0),
h2 AS (SELECT key, h32, (xor(h, h >> 33) * CAST(14181476777654086739 AS UHUGEINT)) % two64 AS h FROM h1),
hashed AS (SELECT key, h32, xor(h, h >> 33) AS h FROM h2)""".replace("two64", "CAST(18446744073709551616 AS UHUGEINT)")

#: Scanned bytes up to which a table of fewer files than cores is dealt to all cores.
SPREAD_BYTES = 512 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one whose scan has fewer tasks than there are cores (one row group, say) is dealt by its
    first column, for work on it would otherwise run in those few tasks; a table of more than SPREAD_BYTES never is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if not LEAST_SPREAD <= size <= SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


#: Scanned bytes from which dealing is worth its exchange.
LEAST_SPREAD = 1 << 20

_indexes: dict[tuple[str, str, bool], tuple[str, I.Index]] = {}


def _files(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: what a stored index was made from."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(folder)))


def stored_index(spark: SparkSession, sf_dir: str, stem: bool = False) -> I.Index:
    """The index of ``documents``: built and saved when a session first asks for it, then loaded, as long as the
    table's files are the same."""
    key, files = (spark.sparkContext.applicationId, sf_dir, stem), _files(spark, f"{sf_dir}/documents.parquet")
    if _indexes.get(key, ("",))[0] != files:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        I.save(I.build(table(spark, sf_dir, "documents"), stem), path)
        _indexes[key] = (files, I.load(spark, path))
    return _indexes[key][1]

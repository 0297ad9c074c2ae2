"""Connected components of an edge table, distributed.

Large-star and small-star steps alternate: each gives a node's neighbours the
smallest node around it, until every component is a star around its smallest
node. A step is a grouped minimum (pre-aggregated before its exchange) and a
join that adaptive execution can split at hubs; nothing is collected, and each
round is written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import durable


def _smallest(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v) joined with m, the smallest v of u. The minima are written first:
    both sides of the join are then dealt by u for it alone, and adaptive
    execution may split the edges of a hub."""
    return edges.join(durable(edges.groupBy("u").agg(F.min("v").alias("m")), rows=rows), "u")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component): each node of an edge between two different nodes,
    and the smallest node that it reaches. Nulls and loops are ignored.
    ``rows`` is about how many edges there are at most, if known."""
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
    stars = durable(pairs.distinct(), rows=rows)
    before = _mark(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * before[0]
        large = _smallest(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        joined = _smallest(large, n)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(joined.select("u", F.col("m").alias("v"))).distinct()
        stars = durable(small, release=True, rows=n)
        after = _mark(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())

"""Link graphs: edges, PageRank, reachability by levels, alias chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where lineage is cut if the cluster names no shared folder (local tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. In local mode a local one
    will do; on a cluster executors would each see another folder, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def edge_set(edges: DataFrame) -> DataFrame:
    """(src, dst) without repeats or nulls."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ranks sum to 1. Nodes
    without outgoing edges spread their rank over all nodes.

    A round joins edges with the shares of their sources and exchanges one sum
    per node and task. Each round's ranks are written to the shared folder: a
    plan that names them three times must not grow with the rounds."""
    own = edge_set(edges)
    nodes = own.select(F.col("src").alias("node")).union(own.select("dst")).distinct()
    degree = own.groupBy("src").agg(F.count("*").alias("out"))
    state = cut(nodes.join(degree, nodes.node == degree.src, "left").select("node", F.coalesce("out", F.lit(0)).alias("out")))
    n = state.count()
    if n == 0:
        return state.select("node", F.lit(0.0).alias("rank"))
    links = cut(own)
    ranks = state.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        lost = ranks.where("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).scalar()
        given = links.join(ranks.where("out > 0").select(F.col("node").alias("src"), F.try_divide("rank", "out").alias("share")), "src")
        sums = given.groupBy("dst").agg(F.sum("share").alias("got"))
        flow = ranks.join(sums, ranks.node == sums.dst, "left")
        ranks = flow.select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        ranks = cut(ranks)
    return ranks.select("node", "rank")


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node, depth) of all nodes within ``max_depth`` steps of ``seeds`` (node); one join per level."""
    own = edge_set(edges)
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        found = own.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def resolve_aliases(aliases: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, canonical): where chains of (alias, canonical) end. Keys without
    an alias, and keys on a cycle or leading into one, are their own.

    Each round doubles the steps taken, so chains of n steps take log2 n rounds.
    If a round ends no key's chain, the rest never end: a chain that does end has
    keys at every distance from its end, one of them in the reach of each round."""
    own = cut(aliases.select(F.col("alias").alias("key"), F.col("canonical").alias("to")).where("key != to").groupBy("key").agg(F.min("to").alias("to")))
    hops, left = own, own.count()
    while True:
        onward = hops.select(F.col("key").alias("to"), F.col("to").alias("next"))
        moved = cut(hops.join(onward, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        hops, before, left = moved.select("key", "to"), left, moved.where("moved").count()
        if left in (0, before):
            break
    known = moved.select("key", F.when(F.col("moved"), F.col("key")).otherwise(F.col("to")).alias("canonical"))
    if keys is None:
        return known
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("canonical", "key").alias("canonical"))

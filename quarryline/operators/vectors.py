"""Dense vectors: cosine, normalization, int8, exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import lean
from ..functions.numbers import half_away, let
from .ranking import top_k


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalized; a zero vector stays."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def valid(v: Column, dim: int | None = None) -> Column:
    """Whether a vector has numbers only, and ``dim`` of them."""
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return good if dim is None else good & (F.size(v) == dim)


def checked(batch: DataFrame, dim: int, v: str = "v") -> DataFrame:
    """A batch to be added: all of it, or an error if any vector has another size or is not finite."""
    good = valid(F.col(v), dim)
    return batch.withColumn(v, F.when(good, F.col(v)).otherwise(F.raise_error(F.lit(f"a vector is not {dim} finite numbers"))))


def converted(v: Column, precision: str) -> Column:
    """A vector in another precision: float64 as it is, float32 normalized again, int8 quantized."""
    return {"float64": doubles(v), "float32": unit(doubles(v)).cast("array<float>"), "int8": quantize(doubles(v))}[precision]


def similarity_to(vectors: DataFrame, doc_id: int, query: list[float]) -> DataFrame:
    """(doc_id, similarity) of one document to a query, 4 digits."""
    asked = F.array(*map(F.lit, map(float, query)))
    return vectors.where(F.col("doc_id") == doc_id).select("doc_id", half_away(cosine(doubles(F.col("v")), asked), 4).alias("similarity"))


def cosine(u: Column, v: Column) -> Column:
    """0 for different lengths or a zero vector."""
    return let(norm(u) * norm(v), lambda both: F.when((F.size(u) != F.size(v)) | (both == 0), F.lit(0.0)).otherwise(dot(u, v) / both))


def quantize(v: Column) -> Column:
    """struct(d array<tinyint>, s float): symmetric int8 of the normalized vector."""

    def codes(u: Column, scale: Column) -> Column:
        one = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), half_away(x / scale.cast("double"), 0)))
        return F.struct(F.transform(u, one).cast("array<tinyint>").alias("d"), scale.alias("s"))

    def scaled(u: Column) -> Column:
        largest = F.array_max(F.transform(u, F.abs))
        scale = F.when(largest > 0, (largest / 127.0).cast("float")).otherwise(F.lit(1.0).cast("float"))
        return let(scale, lambda s: codes(u, s))

    return let(unit(v), scaled)


def dequantize(q: Column) -> Column:
    return F.transform(q["d"], lambda x: x.cast("double") * q["s"].cast("double"))


def int8_dot(query: Column, q: Column) -> Column:
    """The normalized query with a quantized vector."""
    return dot(query, F.transform(q["d"], lambda x: x.cast("double"))) * q["s"].cast("double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, positive_only: bool = True, unit_vectors: bool = True, floor: float | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank): exact nearest neighbours.

    The queries (query_id, v) are a stated set, compared in blocks with all of
    ``vectors`` (doc_id, v): a block is a matrix that is broadcast, each task
    keeps its k best of each query, and the k best of those are ranked. What is
    exchanged is k rows per query and task; what a task holds is bounded by PAIRS
    and k rows per query. Without ``unit_vectors`` those of
    ``vectors`` are taken as they are. Without ``positive_only`` all similarities
    count, as in stores that drop none; ``floor`` lifts lower ones to it."""
    spark = vectors.sparkSession
    numbered = queries.select("query_id", doubles(F.col("v")).alias("v"))
    n = numbered.count()
    out = None
    for b in range(max(1, -(-n // block))):
        part = numbered if n <= block else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block))) == b)
        rows = part.collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast(([r.query_id for r in rows], _units(np.array([r.v for r in rows], float))))
        found = _best(vectors, held, k, positive_only, unit_vectors, floor)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, doc_id long, similarity double")
    return top_k(out, k, by="similarity")


def _units(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


#: Pairs of a vector and a query that are compared at once.
PAIRS = 1 << 20


def _best(vectors: DataFrame, held, k: int, positive_only: bool, unit_vectors: bool, floor: float | None) -> DataFrame:
    def run(batches):
        ids, matrix = held.value
        step = max(1, PAIRS // len(ids))
        least = np.full(len(ids), -np.inf)  # of each query the k-th best score so far
        keep = np.empty((0,), [("query", "i8"), ("doc", "i8"), ("score", "f8")])
        for batch in batches:
            batch = batch[batch["v"].notna()]
            for low in range(0, len(batch) if k > 0 else 0, step):
                part = batch.iloc[low : low + step]
                own = np.stack(part["v"].to_numpy()).astype(float)
                scores = (_units(own) if unit_vectors else own) @ matrix.T
                scores = np.sign(scores) * np.floor(np.abs(np.clip(scores, -1, 1)) * 1e4 + 0.5) / 1e4
                if floor is not None:
                    scores = np.maximum(scores, floor)
                if positive_only:
                    scores = np.where(scores > 0, scores, -np.inf)
                # Whatever reaches the k-th best score, ties with it too, is ranked.
                n = len(scores)
                here = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(len(ids), -np.inf)
                row, col = np.nonzero((scores >= np.maximum(here, least)) & np.isfinite(scores))
                if not len(row):
                    continue
                new = np.empty(len(row), keep.dtype)
                new["query"], new["doc"], new["score"] = col, part["doc_id"].to_numpy()[row], scores[row, col]
                both = np.concatenate([keep, new])
                both = both[np.lexsort((both["doc"], -both["score"], both["query"]))]
                place = np.arange(len(both)) - np.searchsorted(both["query"], both["query"])
                keep, place = both[place < k], place[place < k]
                last = keep[place == k - 1]
                least[last["query"]] = last["score"]
        if len(keep):
            yield pd.DataFrame({"query_id": np.asarray(ids)[keep["query"]], "doc_id": keep["doc"], "similarity": keep["score"]})

    pairs = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), doubles(F.col("v")).alias("v"))
    return pairs.mapInPandas(lean(run), "query_id long, doc_id long, similarity double")

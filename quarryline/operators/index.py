"""The inverted index as tables: postings, document lengths, corpus statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import STOPWORDS, TOKEN_TRIM
from ..functions.memory import lean
from ..functions.text import blanks, fields, stem


#: Documents whose ids share a block's number share its bounds.
BLOCK = 64
#: Bytes of text that are taken apart at once.
CHUNK = 4 << 20
#: Scanned bytes of documents that a task gets.
TASK_BYTES = 16 << 20


@dataclass(frozen=True)
class Index:
    """postings (bucket, term, doc_id, tf, dl, positions), doc_len (doc_id, dl), terms (bucket, term, df, cf), stats (one
    row), bounds (bucket, term, block, n, max_tf, min_len, max_id). A term's bucket is ``bucket_of`` of ``buckets``.
    segments has postings and bounds as they lie: see :func:`_segments`."""

    postings: DataFrame
    doc_len: DataFrame
    terms: DataFrame
    stats: DataFrame
    bounds: DataFrame
    buckets: int
    segments: DataFrame


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl): the number of white-space tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(fields(F.col(text_col))).cast("long").alias("dl"))


# --- documents taken apart where they lie ---------------------------------------------


def _chunks(batches: Iterable[pa.RecordBatch], whole: bool, most: int) -> Iterator[pa.Table]:
    """Rows of about ``most`` bytes of text; with ``whole``, neighbours of one block stay together."""
    held, size, last = [], 0, None
    for batch in batches:
        start = 0
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        blocks = batch.column("block").to_pylist() if whole else range(len(lengths))
        for i, (n, block) in enumerate(zip(lengths, blocks, strict=True)):
            if size >= most and (block != last or not whole):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size, last = size + n + 64, block
        held.append(batch.slice(start))
    if size:
        yield pa.Table.from_batches(held)


def _encoded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones (null is one of them), and those."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(own, pa.ChunkedArray):  # no chunk, or too large for one
        own = pa.concat_arrays(own.chunks) if own.num_chunks else pa.array([], own.type)
    coded = own.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _taken_apart(chunk: pa.Table, stems: bool) -> tuple[dict[str, pa.Array | np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the texts of ``chunk`` (doc_id, text), by term and then by document in the order of the rows; the
    number of each one's term and its row; the lengths of all rows. Texts with one id are one document."""
    words = pc.split_pattern(chunk["text"].combine_chunks(), " ")
    rows = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    code, raw = _encoded(words.flatten())
    there = ~np.asarray(pc.equal(raw, ""), bool)[code]
    code, rows = code[there], rows[there]
    lengths = np.bincount(rows, minlength=len(words))
    pos = np.arange(len(rows)) - (np.cumsum(lengths) - lengths)[rows]

    terms = pc.utf8_trim(raw, characters=TOKEN_TRIM)
    kept = ~np.asarray(pc.is_in(terms, value_set=pa.array(["", *STOPWORDS])), bool)
    if stems:
        terms = pa.array([stem(t) if k else "" for t, k in zip(terms.to_pylist(), kept, strict=True)], pa.string())
    own, terms = _encoded(terms)
    order = np.asarray(pc.sort_indices(terms))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keep = kept[code]
    term, rows, pos = rank[own[code[keep]]], rows[keep], pos[keep]

    doc, ids = _encoded(chunk["doc_id"])
    first = np.full(len(ids), len(doc))
    np.minimum.at(first, doc, np.arange(len(doc)))
    key = term * len(ids) + doc[rows]
    at = np.argsort(key, kind="stable") if len(ids) == len(doc) else np.lexsort((pos, key))
    key = key[at]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(start, len(key))
    term, doc = np.divmod(key[start], len(ids))
    own = {
        "term": terms.take(pa.array(order[term])), "doc_id": ids.take(pa.array(doc)), "tf": np.diff(ends), "dl": lengths[first[doc]],
        "positions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[at], pa.int32())),
    }
    return own, term, first[doc], lengths


def _fields(docs: DataFrame, id_col: str, *more: str) -> str:
    return ", ".join(["term string", f"doc_id {docs.schema[id_col].dataType.simpleString()}", "tf bigint", "dl bigint", "positions array<int>", *more])


def _told(table: dict) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in table.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def postings(docs: DataFrame, stem: bool = False, id_col: str = "doc_id", text_col: str = "text", unique: bool | None = None) -> DataFrame:
    """(term, doc_id, tf, dl, positions), one row per term and document.

    A text is counted where it lies and nothing is exchanged, unless ids repeat (``unique`` says so where it is
    known, else they are counted): then what the texts of one id have is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, False, CHUNK):
            yield _told(_taken_apart(chunk, stem)[0])

    own = docs.select(F.col(id_col).alias("doc_id"), blanks(F.lower(F.col(text_col))).alias("text")).mapInArrow(lean(run), _fields(docs, id_col))
    if unique or (unique is None and not repeated(docs, id_col)):
        return own
    added = own.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return added.select("term", "doc_id", "tf", "dl", "positions")


def repeated(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any id comes up twice."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def packed(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text, version), whose ids don't repeat: (doc_id, version, dl, terms, ends,
    positions). terms are joined by blanks; the positions of the i-th are those from ends[i - 1] to ends[i]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, False, CHUNK):
            own, number, row, lengths = _taken_apart(chunk, False)
            at = np.lexsort((number, row))
            tf, n = own["tf"][at], np.bincount(row, minlength=len(lengths))
            first, places = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(np.bincount(row[at], tf, len(lengths)).astype(np.int64)))
            lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            yield _told({
                "doc_id": chunk["doc_id"].combine_chunks(), "version": chunk["version"].combine_chunks(), "dl": lengths,
                "terms": pc.binary_join(lists(first, own["term"].take(pa.array(at))), " "),
                "ends": lists(first, pa.array(np.cumsum(tf) - np.repeat(places[:-1], n), pa.int32())),
                "positions": lists(places, own["positions"].take(pa.array(at)).flatten()),
            })

    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "version")}
    own = docs.select("doc_id", "version", blanks(F.lower(F.col("text"))).alias("text"))
    return own.mapInArrow(lean(run), f"doc_id {kind['doc_id']}, version {kind['version']}, dl bigint, terms string, ends array<int>, positions array<int>")


def unpacked(own: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) of :func:`packed` rows."""
    flat = own.where(F.size("ends") > 0).select("doc_id", "ends", "positions", F.posexplode(F.split("terms", " ")).alias("i", "term"))
    start = F.when(F.col("i") > 0, F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))).otherwise(0)
    placed = flat.select("term", "doc_id", (F.element_at("ends", F.col("i") + 1) - start).alias("tf"), start.alias("start"), "positions")
    return placed.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.slice("positions", F.col("start") + 1, F.col("tf")).alias("positions"))


def _parts(docs: DataFrame, least: int) -> int:
    """Tasks for the documents: as many as there are cores, and so many that one gets TASK_BYTES as scanned."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 50
    return max(least, spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES) if known else int(spark.conf.get("spark.sql.shuffle.partitions")))


def _segments(docs: DataFrame, stem: bool, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(term, doc_id, tf, dl, positions, block, n, max_tf, min_len): postings in runs of whole blocks, by term and then
    by document. The last posting that a term has in a block carries the block's bounds, other rows have none there.

    Texts are exchanged once, by block; a token never is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, True, CHUNK):
            own, number, row, _ = _taken_apart(chunk, stem)
            tf = own["tf"]
            if not len(tf):
                continue
            block, blocks = _encoded(chunk["block"])
            block = block[row]
            start = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            ends = np.append(start[1:], len(tf))
            last = np.full(len(tf), -1)
            last[ends - 1] = np.arange(len(start))
            at = pa.array(last, mask=last < 0)
            bounds = {"n": ends - start, "max_tf": np.maximum.reduceat(tf, start), "min_len": np.minimum.reduceat(own["dl"], start)}
            yield _told(own | {"block": blocks.take(pa.array(block[start])).take(at)} | {k: pa.array(v).take(at) for k, v in bounds.items()})

    own = docs.select(F.floor(F.col(id_col) / BLOCK).alias("block"), F.col(id_col).alias("doc_id"), blanks(F.lower(F.col(text_col))).alias("text"))
    dealt = own.repartition(_parts(docs, least), "block").sortWithinPartitions("block", "doc_id")
    return dealt.mapInArrow(lean(run), _fields(docs, id_col, "block bigint", "n bigint", "max_tf bigint", "min_len bigint"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf) of postings: documents and occurrences."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n_docs, total_len, avgdl) in one row."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")).withColumn(
        "avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(F.lit(0.0))
    )


def block_stats(docs: DataFrame, stem: bool = False) -> DataFrame:
    """By term and block of BLOCK documents: largest tf, least length, last document; the bounds that pruning needs."""
    return _bounds(_segments(docs, stem)).select("term", "block", "n", "max_tf", "min_len", "max_id")


def _bounds(segments: DataFrame) -> DataFrame:
    return segments.where("n is not null").withColumnRenamed("doc_id", "max_id")


def _index(segments: DataFrame, lengths: DataFrame, terms: DataFrame, stats: DataFrame, buckets: int) -> Index:
    bucket = bucket_of(F.col("term"), buckets).alias("bucket")
    post = segments.select(bucket, "term", "doc_id", "tf", "dl", "positions")
    bounds = _bounds(segments).select(bucket, "term", "block", "n", "max_tf", "min_len", "max_id")
    return Index(post, lengths, terms.select(bucket, "term", "df", "cf"), stats, bounds, buckets, segments)


def build(docs: DataFrame, stem: bool = True, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, slices: int = 1) -> Index:
    """The index of ``docs``, as plans; at least ``slices`` tasks make it."""
    lengths, own = doc_lengths(docs, id_col, text_col), _segments(docs, stem, id_col, text_col, slices)
    return _index(own, lengths, term_stats(own), corpus_stats(lengths), buckets)


def save(index: Index, path: str) -> None:
    """A snapshot. Postings lie in runs sorted by term, so a query of few terms reads few pages of each file; what
    follows from postings is computed from those written."""
    spark = index.postings.sparkSession
    index.segments.write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_len.write.mode("overwrite").parquet(f"{path}/doc_len")
    own, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_len")
    term_stats(own).write.mode("overwrite").parquet(f"{path}/terms")
    corpus_stats(lengths).withColumn("buckets", F.lit(index.buckets)).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    stats = read("stats")
    return _index(read("postings"), read("doc_len"), read("terms"), stats, stats.first()["buckets"])

"""BM25 ranking of batches of queries, top k, pages, completion, snippets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import RRF_K, STOPWORDS, TOKEN_TRIM, B, K1  # noqa: F401
from ..functions.memory import lean
from ..functions.numbers import half_away
from ..functions.text import fields, is_stopword, stem, stemmed, tokens, trimmed
from .graph import cut
from .index import BLOCK, Index


def idf(n_docs: Column, df: Column) -> Column:
    top = n_docs - df + 0.5
    value = F.log(F.when(top < 0, F.lit(0.5)).otherwise(top) / (df + 0.5) + 1)
    return F.when((n_docs <= 0) | (df <= 0), F.lit(0.0)).otherwise(value)


def bm25(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    length = dl / F.when(avgdl <= 0, F.lit(1.0)).otherwise(avgdl)
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


def query_terms(queries: DataFrame, stem_terms: bool = False) -> DataFrame:
    """(query_id, term, times): kept terms of ``queries`` (query_id, query); repeats count."""
    flat = queries.select("query_id", F.explode(fields(F.lower("query"))).alias("raw")).select("query_id", trimmed(F.col("raw")).alias("term"))
    kept = flat.where((F.col("term") != "") & ~is_stopword(F.col("term")))
    if stem_terms:
        kept = stemmed(kept)
    return kept.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def score_terms(matched: DataFrame, n_docs: Column, avgdl: Column) -> DataFrame:
    """(query_id, doc_id, score, match_count) of rows (query_id, term, times, doc_id, tf, dl, df); scores have 3 digits."""
    part = F.col("times") * bm25(idf(n_docs, F.col("df")), F.col("tf"), F.col("dl"), avgdl)
    scored = matched.withColumn("part", part).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.sum("times").alias("match_count"))
    return scored.withColumn("score", half_away(F.col("score"), 3))


def top_k(scored: DataFrame, k: int, by: str = "score", key: str = "query_id", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best of each query, ties by id, with their ranks; k <= 0: none."""
    order = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= max(0, k))


def scores(docs: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, doc_id, score, match_count) by BM25 without a saved index.
    Only tokens that a query has are grouped; document frequencies come from those."""
    terms = tokens(docs)
    wanted = query_terms(queries, stem)
    terms = stemmed(terms) if stem else terms
    hits = terms.join(wanted.select("term").distinct(), "term").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    lengths = docs.select(F.size(fields(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    matched = hits.join(df, "term").join(wanted, "term")
    return score_terms(matched, lengths.select("n_docs").scalar(), lengths.select("avgdl").scalar())


def search(docs: DataFrame, queries: DataFrame, k: int = 10, stem: bool = False) -> DataFrame:
    """The k best documents of each of ``queries``, with ranks."""
    return top_k(scores(docs, queries, stem), k)


#: Distinct query terms up to which the scan gets them as a list; more terms are pruned by bucket only.
LISTED = 256


#: Rows of query terms that are held as a local table, so that their size is known; more stay distributed.
HELD = 200_000


def held(df: DataFrame) -> DataFrame:
    """``df`` as a local table that joins broadcast, if it has HELD rows at most; else as it is."""
    rows = df.limit(HELD + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows)) if rows.num_rows <= HELD else df


def _wanted(index: Index, queries: DataFrame, stem: bool) -> tuple[DataFrame, Column, float, pa.Table | None]:
    """(query_id, term, times, df, weight) of the terms that the index has, a filter for scans if they are few, the
    mean length, and the rows if they are held."""
    stats, wanted = index.stats.first(), query_terms(queries, stem)
    rows = wanted.limit(HELD + 1).toArrow()
    few = rows.num_rows <= HELD
    terms = rows.column("term").unique().to_pylist() if few else []
    here = F.col("term").isin(terms) if few and len(terms) <= LISTED else F.lit(True)
    if few:
        wanted = F.broadcast(wanted.sparkSession.createDataFrame(rows))
    weight = idf(F.lit(stats["n_docs"]), F.col("df")).alias("weight")
    weighed = index.terms.where(here).select("term", "df").join(wanted, "term").select("query_id", "term", "times", "df", weight)
    own = None
    if few:
        own = weighed.toArrow()
        weighed = F.broadcast(weighed.sparkSession.createDataFrame(own))
    return weighed, here, float(stats["avgdl"]), own


def _scored(post: DataFrame, wanted: DataFrame, avgdl: float) -> DataFrame:
    """(query_id, doc_id, score, match_count): the sums over the postings of each query's terms; scores have 3 digits."""
    part = F.col("times") * bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.lit(avgdl))
    summed = post.join(wanted, [c for c in ("query_id", "term", "block") if c in post.columns and c in wanted.columns])
    own = summed.withColumn("part", part).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.sum("times").alias("match_count"))
    return own.withColumn("score", half_away(F.col("score"), 3))


#: Postings that a task ranks, and pairs of a posting and a query that it adds up at once.
TASK_POSTINGS, PAIRS = 1 << 20, 1 << 20


def _best(post: DataFrame, wanted: pa.Table, k: int, by: list[str], terms: list[str]) -> DataFrame:
    """(by..., doc_id, score, match_count, rank) of the ``k`` best documents of each row of ``by`` columns.

    ``wanted`` has ``by`` and ``terms`` columns, times, df, weight and avgdl; ``post`` has ``terms`` columns, doc_id, tf
    and dl. A posting that any query wants is exchanged once, by its document. Tasks add up what queries get from
    whole documents and keep the k best of each, so pairs of a query and a document are never exchanged."""
    spark = post.sparkSession
    asked, askers = _numbered(wanted, by)
    number, names = _numbered(wanted, terms)
    order = np.lexsort((asked, number))
    first = np.unique(number, return_index=True)[1]
    one = lambda name: wanted.column(name).to_numpy()
    table = spark.sparkContext.broadcast((
        np.searchsorted(number[order], np.arange(len(first) + 1)), asked[order], one("times")[order], one("weight")[first], one("avgdl")[first], askers,
    ))
    local = F.broadcast(spark.createDataFrame(names.append_column("number", pa.array(np.arange(len(first))))))
    matched = post.join(local, terms).select("number", "doc_id", "tf", "dl")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(one("df")[first].sum() / TASK_POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows or k <= 0:
            return
        start, who, times, weight, avgdl, askers = table.value
        own = pa.Table.from_batches(rows)
        ids = own.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        up = pc.array_sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
        doc = np.empty(len(up), np.int64)
        doc[up] = np.arange(len(up))
        doc, term, tf, dl = doc[ids.indices.to_numpy()], *(own.column(c).to_numpy() for c in ("number", "tf", "dl"))
        at = np.lexsort((term, doc))
        doc, term, tf, dl = doc[at], term[at], tf[at], dl[at]
        mean = avgdl[term]
        part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl / np.where(mean <= 0, 1.0, mean))))
        askings = start[term + 1] - start[term]
        total, new = np.cumsum(askings), np.flatnonzero(np.diff(doc, append=-1))  # the last rows of documents
        floor, keep, low = np.full(askers.num_rows, -np.inf), None, 0
        while low < len(doc):
            full = np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")
            high = new[np.searchsorted(new, max(full - 1, low))] + 1
            found = _summed(slice(low, high), doc, term, part, askings, start, who, times)
            found = found[:, found[2] >= floor[found[0].astype(np.int64)]]
            keep = found if keep is None else np.hstack([keep, found])
            keep = keep[:, np.lexsort((keep[1], -keep[2], keep[0]))]
            place = np.arange(keep.shape[1]) - np.searchsorted(keep[0], keep[0])
            keep, place = keep[:, place < k], place[place < k]
            last = place == k - 1
            floor[keep[0, last].astype(np.int64)] = keep[2, last]
            low = high
        at = pa.array(keep[0].astype(np.int64))
        docs = ids.dictionary.take(pa.array(up[keep[1].astype(np.int64)]))
        columns = [*(askers.column(c).combine_chunks().take(at) for c in by), docs, pa.array(keep[2]), pa.array(keep[3].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, [*by, "doc_id", "score", "match_count"])

    kind = {f.name: f.dataType.simpleString() for f in [*post.schema, *spark.createDataFrame(askers.slice(0, 0)).schema]}
    found = matched.repartition(tasks, "doc_id").mapInArrow(lean(run), ", ".join(f"{c} {kind[c]}" for c in [*by, "doc_id"]) + ", score double, match_count bigint")
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k))


def _numbered(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, pa.Table]:
    """The number of each row's values in ``columns`` among the distinct ones, and those."""
    number = np.zeros(table.num_rows, np.int64)
    for c in columns:
        own = pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type)
        coded = own.dictionary_encode(null_encoding="encode")
        number = number * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, table.select(columns).take(pa.array(first))


def _summed(rows: slice, doc, term, part, askings, start, who, times) -> np.ndarray:
    """Columns (query, document, score of 3 digits, matches) of postings of whole documents, by query and document."""
    n = askings[rows]
    row = np.repeat(np.arange(rows.start, rows.stop), n)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[term[row]]
    low, width = doc[rows.start], doc[rows.stop - 1] - doc[rows.start] + 1
    key = who[entry] * width + doc[row] - low
    own = times[entry]
    if (int(key.max()) + 1 if len(key) else 0) <= 4 * len(key) + 1000:
        matches = np.bincount(key, own)
        pair = np.flatnonzero(matches)
        score, matches = np.bincount(key, own * part[row])[pair], matches[pair]
    else:
        pair, key = np.unique(key, return_inverse=True)
        score, matches = np.bincount(key, own * part[row]), np.bincount(key, own)
    score = np.sign(score) * np.floor(np.abs(score) * 1e3 + 0.5) / 1e3
    return np.vstack([pair // width, pair % width + low, score, matches])


def search_index(index: Index, queries: DataFrame, k: int = 10, stem: bool = True) -> DataFrame:
    """The same over a built or loaded index: only postings of the queries' terms are exchanged, and each has what its
    score needs but the term's weight. Queries of more than HELD terms in all are joined as tables."""
    wanted, here, avgdl, rows = _wanted(index, queries, stem)
    post = index.postings.where(here).select("term", "doc_id", "tf", "dl")
    if rows is None:
        return top_k(_scored(post, wanted, avgdl), k)
    return _best(post, rows.append_column("avgdl", pa.array(np.full(rows.num_rows, avgdl))), k, ["query_id"], ["term"])


def block_bounds(index: Index, queries: DataFrame, stem: bool = True) -> DataFrame:
    """(query_id, block, bound): the most that a document of a block can score."""
    wanted, here, avgdl, _ = _wanted(index, queries, stem)
    return _block_bounds(index, wanted, here, avgdl)


def _block_bounds(index: Index, wanted: DataFrame, here: Column, avgdl: float) -> DataFrame:
    most = F.col("times") * bm25(F.col("weight"), F.col("max_tf"), F.col("min_len"), F.lit(avgdl))
    return index.bounds.where(here).join(wanted, "term").withColumn("most", most).groupBy("query_id", "block").agg(F.sum("most").alias("bound"))


def block_max_top(index: Index, queries: DataFrame, k: int = 10, stem: bool = True, probes: int = 2, block: int = BLOCK) -> DataFrame:
    """The k best documents by block bounds (WAND), equal to :func:`search_index`.

    Blocks are ranges of ids, the same for all terms, so a block's bound is the
    sum of its terms' bounds. Of each query the documents of the ``probes`` * k
    blocks with the highest bounds are scored; their k-th score is a floor, and
    only blocks whose bound reaches it (or that tie with it once rounded) are
    scored to the end. Other blocks' postings are dropped before they are summed."""
    if k <= 0:
        return search_index(index, queries, 0, stem)
    wanted, here, avgdl, _ = _wanted(index, queries, stem)
    bounds = cut(_block_bounds(index, wanted, here, avgdl))
    post = index.postings.where(here).select("term", "doc_id", "tf", "dl", F.floor(F.col("doc_id") / block).alias("block"))
    in_blocks = lambda chosen: _scored(post, wanted.join(chosen, "query_id"), avgdl)
    best = top_k(bounds, probes * k, by="bound", tie="block").select("query_id", "block")
    floor = top_k(in_blocks(best), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    kept = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 0.000501))
    return top_k(in_blocks(kept.select("query_id", "block")), k)


def sharded_search(post: DataFrame, lengths: DataFrame, shard: Column, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, shard, doc_id, score, match_count, rank): the k best of each query in each shard, by the shard's own
    document frequencies and mean length, as shards that don't know of each other give them."""
    wanted = held(query_terms(queries))
    own = post.select("term", "doc_id", "tf", "dl", shard.alias("shard"))
    df = own.join(held(wanted.select("term").distinct()), "term").groupBy("shard", "term").agg(F.count("*").alias("df"))
    stats = lengths.withColumn("shard", shard).groupBy("shard").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    weight = idf(F.col("n_docs"), F.col("df")).alias("weight")
    weighed = df.join(stats, "shard").join(wanted, "term").select("query_id", "shard", "term", "times", "df", weight, "avgdl")
    rows = weighed.limit(HELD + 1).toArrow()
    if rows.num_rows <= HELD:
        return _best(own, rows, k, ["query_id", "shard"], ["shard", "term"])
    part = F.col("times") * bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    summed = own.join(weighed, ["shard", "term"]).withColumn("part", part).groupBy("query_id", "shard", "doc_id")
    scored = summed.agg(F.sum("part").alias("score"), F.sum("times").alias("match_count")).withColumn("score", half_away(F.col("score"), 3))
    order = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: By surface: results where none are asked for, and the most; the same for offsets of pages.
LIMITS = {"search": (5, 100), "web": (5, 50), "autocomplete": (10, 50), "cluster": (10, None)}


def clamped(k: int | None, surface: str = "search") -> int:
    """The number of results that a surface gives for ``k``."""
    default, most = LIMITS[surface]
    own = default if k is None or k <= 0 else k
    return own if most is None else min(own, most)


def fetched(k: int, surface: str = "search", offset: int = 0) -> int:
    """How many results of each kind are fetched before they are fused."""
    return {"cli": max(10, 2 * k), "tools": max(10, k), "pages": offset + k}.get(surface, 2 * k)


def page(ranked: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of ranked rows; offset 0 to 10000, limit 1 to 100."""
    low = min(max(offset, 0), 10_000)
    return ranked.where((F.col("rank") > low) & (F.col("rank") <= low + min(max(limit, 1), 100)))


def complete(terms: DataFrame, prefix: str, k: int = 10, longest: int = 64) -> DataFrame:
    """Terms (term, frequency) that begin with ``prefix``, the most frequent first. No cap is set on the candidates."""
    clean = prefix.strip().lower()
    found = terms.where(F.col("term").startswith(clean) & (F.length("term") <= longest))
    return found.orderBy(F.col("frequency").desc(), "term").limit(max(0, k))


def _shared(a: str, b: str) -> int:
    """The length of the longest prefix that both have."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def prefix_count(terms: DataFrame) -> DataFrame:
    """The number of different prefixes of all terms: the nodes of their trie.

    In order, a term adds the prefixes that it does not share with the one before it. So terms are sorted by ranges
    and no prefix is made; ranges send their first and last terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, nodes = None, "", 0
        for batch in batches:
            for term in batch.column(0).to_pylist():
                first = term if first is None else first
                nodes += len(term) - _shared(last, term)
                last = term
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "nodes": [nodes]})

    own = terms.where("term != ''").select("term")
    ranges = own.repartitionByRange("term").sortWithinPartitions("term").mapInArrow(run, "first string, last string, nodes bigint").collect()
    ranges.sort(key=lambda r: r["first"])
    nodes = sum(r.nodes for r in ranges) - sum(_shared(a.last, b["first"]) for a, b in zip(ranges, ranges[1:]))
    return terms.sparkSession.range(1).select(F.lit(nodes).cast("long").alias("nodes"))


def highlight(body: str, terms: list[str], longest: int = 180) -> str:
    """A passage of 25 words around the first match, matches in <mark>."""
    words = (body or "").split()
    if not words:
        return ""
    lower = body.lower()
    places = [len(lower[:at].encode()) for at in (lower.find(t.lower()) for t in terms) if at >= 0]
    match = 0
    if places:
        passed = 0
        for i, word in enumerate(words):
            passed += len(word.encode()) + 1
            if passed >= min(places):
                match = i
                break
    first = max(0, match - 5)
    last = min(len(words), first + 25)
    exact, stems = {t.lower() for t in terms}, {stem(t) for t in terms}
    clean = [w.lower().strip(TOKEN_TRIM) for w in words[first:last]]
    marked = [f"<mark>{w}</mark>" if c in exact or stem(c) in stems else w for w, c in zip(words[first:last], clean, strict=True)]
    text = ("..." if first else "") + " ".join(marked) + ("..." if last < len(words) else "")
    if len(text) <= longest:
        return text
    cut = text[:longest]
    if cut.rfind("<") > cut.rfind(">"):
        cut = cut[: cut.rfind("<")]
    if cut.count("<mark>") > cut.count("</mark>"):
        cut += "</mark>"
    return cut + "..."


def snippet(body: Column, terms: Column, longest: int = 180) -> Column:
    """:func:`highlight` as a column; meant for the few rows that ranking left."""

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([highlight(b or "", [] if w is None else list(w), longest) for b, w in zip(bodies, words, strict=True)], dtype=object)

    return run(body, terms)

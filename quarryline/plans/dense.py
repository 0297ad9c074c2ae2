"""Vectors and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_away, half_away_sql
from ..functions.text import embedding
from ..operators import fusion as S
from ..operators import ranking as R
from ..operators import vectors as V
from .lexical import BENCH, SCORES, STOP, TOKENS, TRIM, bench_queries, fields_sql
from .registry import query, stored_index, table

VEC = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
#: Queries: every hundredth vector, against all.
KNN = f"""{VEC}, n AS (SELECT doc_id, v, {NORM.format(v="v")} AS l FROM v),
sim AS (SELECT a.doc_id AS query_id, b.doc_id, {half_away_sql(f"greatest(-1, least(1, {DOT.format(a='a.v', b='b.v')} / (a.l * b.l)))", 4)} AS similarity
  FROM n a, n b WHERE a.doc_id % 100 = 0 AND a.l > 0 AND b.l > 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM sim WHERE similarity > 0)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("v"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "v")


@query(f"WITH {VEC} SELECT doc_id, {half_away_sql(NORM.format(v='v'), 6)} AS norm FROM v")
def vector_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("doc_id", half_away(V.norm(F.col("v")), 6).alias("norm"))


@query(
    f"""WITH {VEC} SELECT a.doc_id, {half_away_sql(f"{DOT.format(a='a.v', b='b.v')} / ({NORM.format(v='a.v')} * {NORM.format(v='b.v')})", 4)} AS cosine
    FROM v a JOIN v b ON b.doc_id = a.doc_id + 1"""
)
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    after = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("w"))
    return own.join(after, "doc_id").select("doc_id", half_away(V.cosine(F.col("v"), F.col("w")), 4).alias("cosine"))


@query(f"WITH {KNN} SELECT query_id, doc_id, similarity, rank FROM knn WHERE rank <= 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(vectors(spark, d), vector_queries(spark, d), 10).select("query_id", "doc_id", "similarity", "rank")


@query(
    f"""WITH {KNN}, sub AS (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank
    FROM knn JOIN embeddings e ON e.vec_id = doc_id WHERE e.label = 3) SELECT query_id, doc_id, similarity, rank FROM sub WHERE rank <= 10"""
)
def knn_subset(spark: SparkSession, d: str) -> DataFrame:
    candidates = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return V.nearest(vectors(spark, d).join(candidates, "doc_id", "left_semi"), vector_queries(spark, d), 10).select("query_id", "doc_id", "similarity", "rank")


INT8 = f"""u AS (SELECT doc_id, list_transform(v, lambda x: x / {NORM.format(v="v")}) AS u FROM v),
s AS (SELECT doc_id, u, CAST(list_max(list_transform(u, lambda x: abs(x))) / 127.0 AS FLOAT) AS s FROM u),
c AS (SELECT doc_id, u, s, list_transform(u, lambda x: CAST({half_away_sql("(x / CAST(s AS DOUBLE))", 0)} AS INTEGER)) AS c FROM s)"""


@query(f"WITH {VEC}, {INT8} SELECT doc_id, array_to_string(c, ' ') AS codes, {half_away_sql('CAST(s AS DOUBLE)', 8)} AS scale FROM c")
def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    q = vectors(spark, d).select("doc_id", V.quantize(F.col("v")).alias("q"))
    return q.select("doc_id", F.array_join(F.col("q.d").cast("array<string>"), " ").alias("codes"), half_away(F.col("q.s").cast("double"), 8).alias("scale"))


@query(f"WITH {VEC}, {INT8} SELECT doc_id, {half_away_sql('list_max(list_transform(list_zip(u, c), lambda p: abs(p[1] - p[2] * CAST(s AS DOUBLE))))', 6)} AS worst FROM c")
def dequantize_error(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d).select("doc_id", V.unit(F.col("v")).alias("u"), V.quantize(F.col("v")).alias("q"))
    gap = F.array_max(F.zip_with("u", V.dequantize(F.col("q")), lambda a, b: F.abs(a - b)))
    return own.select("doc_id", half_away(gap, 6).alias("worst"))


@query(
    f"""WITH {KNN}, {INT8}, qs AS (SELECT a.doc_id AS query_id, b.doc_id, {half_away_sql("list_sum(list_transform(list_zip(a.u, b.c), lambda p: p[1] * p[2])) * CAST(b.s AS DOUBLE)", 4)} AS similarity
      FROM u a, c b WHERE a.doc_id % 100 = 0),
    qk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM qs WHERE similarity > 0)
    SELECT k.query_id, count(q.doc_id) / 10.0 AS recall FROM (SELECT * FROM knn WHERE rank <= 10) k LEFT JOIN (SELECT * FROM qk WHERE rank <= 10) q USING (query_id, doc_id) GROUP BY k.query_id"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of int8 against exact search; the queries are a stated set."""
    exact = V.nearest(vectors(spark, d), vector_queries(spark, d), 10)
    codes = vectors(spark, d).select("doc_id", V.dequantize(V.quantize(F.col("v"))).alias("v"))
    found = V.nearest(codes, vector_queries(spark, d), 10, unit_vectors=False).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))


#: Lexical ranks by BM25 of the benchmark's texts; dense ranks by cosine, the query's vector being that of its number.
LEX = f"{TOKENS}, {BENCH}, {SCORES}, lex AS (SELECT * FROM ranked WHERE rank <= 20)"
NORMED = f"{VEC}, nv AS (SELECT doc_id, v, {NORM.format(v='v')} AS l FROM v)"
DEN = f"""{NORMED}, pairs AS (SELECT a.doc_id AS query_id, b.doc_id, {half_away_sql(f"greatest(-1, least(1, {DOT.format(a='a.v', b='b.v')} / (a.l * b.l)))", 4)} AS similarity
  FROM nv a JOIN q ON q.query_id = a.doc_id, nv b WHERE a.l > 0 AND b.l > 0),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM pairs WHERE similarity > 0) WHERE rank <= 20)"""
RRF = f"""fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id, l.score AS bm25_score, v.similarity AS vector_similarity,
    CAST(l.rank AS INTEGER) AS bm25_rank, CAST(v.rank AS INTEGER) AS vector_rank,
    {half_away_sql("CASE WHEN l.score > 0 THEN CAST(1.0 AS DOUBLE) / (60 + l.rank) ELSE 0.0 END + coalesce(CAST(1.0 AS DOUBLE) / (60 + v.rank), 0.0)", 9)} AS raw
    FROM lex l FULL OUTER JOIN den v ON l.query_id = v.query_id AND l.doc_id = v.doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM fused WHERE raw > 1e-6) WHERE rank <= 10)"""
RRF_COLUMNS = f"query_id, doc_id, {half_away_sql('raw', 5)} AS rrf_score, bm25_score, vector_similarity, bm25_rank, vector_rank, rank"


def _lexical(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return R.search_index(stored_index(spark, d), bench_queries(spark, d), k, stem=False)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, v): the vectors that stand for the queries."""
    own = vectors(spark, d).withColumnRenamed("doc_id", "query_id")
    return own.join(R.held(bench_queries(spark, d).select("query_id")), "query_id", "left_semi")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_lexical(spark, d), V.nearest(vectors(spark, d), _asked(spark, d), 20), 10)


@query(f"WITH {LEX}, {DEN}, {RRF} SELECT {RRF_COLUMNS} FROM hits")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query(f"WITH {LEX}, {DEN}, {RRF} SELECT {RRF_COLUMNS} FROM hits WHERE vector_rank IS NOT NULL")
def hybrid_mode_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.only_mode(_fused(spark, d), "vector")


@query(
    f"""WITH {LEX}, {DEN}, {RRF}, t AS (SELECT h.query_id, h.doc_id, h.rank AS original_rank, {half_away_sql("h.raw", 5)} AS rrf_score, lower(q.query) AS qq, lower(dd.source) AS title,
      lower(concat_ws(' ', dd.source, dd.text)) AS both_texts FROM hits h JOIN q USING (query_id) JOIN documents dd USING (doc_id)),
    w AS (SELECT *, list_filter(list_filter(regexp_split_to_array(qq, '\\s+'), lambda w: w <> ''), lambda w: w NOT IN ({STOP})) AS ws FROM t),
    b AS (SELECT *, {half_away_sql("coalesce(list_sum(list_transform(ws, lambda w: CASE WHEN contains(both_texts, w) THEN 1.5 ELSE 0 END + CASE WHEN contains(title, w) THEN 2.0 ELSE 0 END)), 0)", 2)} AS boost FROM w),
    r AS (SELECT query_id, doc_id, original_rank, {half_away_sql("(100 * rrf_score + boost)", 3)} AS rerank_score FROM b)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM r) WHERE rank <= 5"""
)
def rerank_boost(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("snippet"))
    hits = docs.join(R.held(_fused(spark, d).select("query_id", "doc_id", "rrf_score", "rank")), "doc_id").join(R.held(bench_queries(spark, d)), "query_id")
    return S.rerank(hits, 5).select("query_id", "doc_id", "original_rank", "rerank_score", "rank")


@query(
    f"""WITH {TOKENS}, {BENCH}, sp AS (SELECT *, doc_id % 4 AS shard FROM post),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, trim(unnest({fields_sql("lower(query)")}), '{TRIM}') AS term FROM q) WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY query_id, term),
    sdf AS (SELECT shard, term, count(*) AS df FROM sp GROUP BY shard, term),
    ss AS (SELECT doc_id % 4 AS shard, count(*) AS n, avg(len(r)) AS avgdl FROM raw GROUP BY 1),
    sc AS (SELECT query_id, shard, doc_id, {half_away_sql("sum(times * ln(greatest(n - df + 0.5, 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))", 3)} AS score
      FROM sp JOIN sdf USING (shard, term) JOIN ss USING (shard) JOIN qt USING (term) GROUP BY query_id, shard, doc_id),
    sh AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, doc_id) AS rank FROM sc),
    rr AS (SELECT query_id, doc_id, {half_away_sql("(CAST(1.0 AS DOUBLE) / (60 + rank))", 5)} AS rrf_score FROM sh WHERE rank <= 20)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM rr) WHERE rank <= 10"""
)
def scatter_gather_merge(spark: SparkSession, d: str) -> DataFrame:
    """Four shards rank by their own statistics; the best score of each document counts."""
    own = stored_index(spark, d)
    top = R.sharded_search(own.postings, own.doc_len, F.col("doc_id") % 4, bench_queries(spark, d), R.fetched(10))
    return S.gather(top.select("query_id", "doc_id", half_away(1.0 / (60 + F.col("rank")), 5).alias("rrf_score")), R.clamped(None, "cluster"))


@query(
    f"""WITH {LEX}, cand AS (SELECT * FROM ranked WHERE rank <= 100), {VEC}, {INT8},
    pairs AS (SELECT cand.query_id, cand.doc_id, {half_away_sql("greatest(-1, least(1, list_sum(list_transform(list_zip(a.u, b.c), lambda p: p[1] * p[2])) * CAST(b.s AS DOUBLE)))", 4)} AS similarity
      FROM cand JOIN u a ON a.doc_id = cand.query_id JOIN c b ON b.doc_id = cand.doc_id),
    den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM pairs WHERE similarity > 0) WHERE rank <= 10),
    {RRF.replace("FROM lex l", "FROM cand l")} SELECT {RRF_COLUMNS} FROM hits"""
)
def two_stage_rescore(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best by BM25, those of them that have a vector scored by int8, both fused."""
    lexical = R.held(_lexical(spark, d, 100))
    own = vectors(spark, d).join(lexical.select("query_id", "doc_id"), "doc_id").select("query_id", "doc_id", V.quantize(F.col("v")).alias("code"))
    asked = _asked(spark, d).select("query_id", V.unit(F.col("v")).alias("u"))
    pairs = own.join(R.held(asked), "query_id")
    near = pairs.select("query_id", "doc_id", half_away(clamp(V.int8_dot(F.col("u"), F.col("code")), -1.0, 1.0), 4).alias("similarity"))
    return S.two_stage(lexical, near, 10)


@query(
    f"""WITH {LEX}, {DEN}, {RRF}, h AS (SELECT {RRF_COLUMNS} FROM hits)
    SELECT h.*, coalesce(nullif(dd.source, ''), CAST(h.doc_id AS VARCHAR)) AS title, dd.lang AS lang FROM h JOIN documents dd USING (doc_id)"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Stored index and stored vectors, twice as many hits of each kind as are asked for, fused, then their metadata."""
    title = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.col("doc_id").cast("string"))
    about = table(spark, d, "documents").select("doc_id", title.alias("title"), "lang")
    return R.held(_fused(spark, d)).join(about, "doc_id")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = table(spark, d, "documents"), bench_queries(spark, d)
    lexical = R.search_index(stored_index(spark, d, stem=True), queries, 20, stem=True)
    vec = docs.select("doc_id", embedding(F.col("text")).alias("v"))
    return S.fuse(lexical, V.nearest(vec, queries.select("query_id", embedding(F.col("query")).alias("v")), 20), 10)


@query(None)
def hybrid_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search by stems and hashed n-grams, embedded on the fly."""
    return _hybrid(spark, d)


@query(
    f"""WITH {LEX}, {DEN}, {RRF}, h AS (SELECT {RRF_COLUMNS} FROM hits)
    SELECT query_id, string_agg(CAST(h.rank AS VARCHAR) || '. **' || coalesce(dd.source, 'null') || '** (score ' || CAST(CAST(CAST(rrf_score AS DECIMAL(18, 5)) AS DECIMAL(18, 4)) AS VARCHAR) || ')' || chr(10) || '   ' || coalesce(dd.text, 'null'), chr(10) ORDER BY h.rank) AS answer
    FROM h JOIN documents dd USING (doc_id) WHERE h.rank <= 3 GROUP BY query_id"""
)
def agentic_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """Answers from the three best hits of the stored index and the stored vectors."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("snippet"))
    return S.synthesize(docs.join(R.held(_fused(spark, d).where("rank <= 3")), "doc_id"))

"""Text analytics, BM25, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import EMBED_TRIM, STOPWORDS
from ..functions.numbers import half_away, half_away_sql
from ..operators import index as I
from ..operators import ranking as R
from .registry import RING_SQL, query, stored_index, table

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
TRIM = ".,!?:;\"''()[]{}"
#: Frequent words of the driver's corpora.
QUERY = "thre thnd onon"


def fields_sql(x: str) -> str:
    """The non-empty runs between white space of a text."""
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


TOKENS = f"""
raw AS (SELECT doc_id, {fields_sql("lower(text)")} AS r FROM documents),
flat AS (SELECT doc_id, len(r) AS dl, unnest(r) AS w, unnest(range(len(r))) AS pos FROM raw),
tok AS (SELECT doc_id, dl, pos, term FROM (SELECT doc_id, dl, pos, trim(w, '{TRIM}') AS term FROM flat) WHERE term <> '' AND term NOT IN ({STOP})),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM tok GROUP BY term, doc_id)
"""
SCORES = f"""
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(r)) AS avgdl FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, trim(unnest({fields_sql("lower(query)")}), '{TRIM}') AS term FROM q)
  WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY query_id, term),
part AS (SELECT query_id, doc_id, times, times * ln(greatest(n - df + 0.5, 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s
  FROM post JOIN df USING (term) JOIN qt USING (term), stats),
scored AS (SELECT query_id, doc_id, {half_away_sql("sum(s)", 3)} AS score, CAST(sum(times) AS BIGINT) AS match_count FROM part GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""
BENCH = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
ONE = f"q AS (SELECT 1 AS query_id, '{QUERY}' AS query)"


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def one_query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, QUERY)], "query_id long, query string")


HITS = ("query_id", "doc_id", "score", "match_count", "rank")


@query(f"WITH {TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.term_stats(I.postings(table(spark, d, "documents")))


@query(f"SELECT doc_id, CAST(len({fields_sql('text')}) AS BIGINT) AS dl FROM documents")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_lengths(table(spark, d, "documents"))


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    own = I.postings(table(spark, d, "documents"))
    return own.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(
    f"""WITH {TOKENS} SELECT (SELECT count(*) FROM raw) AS n_docs, (SELECT CAST(sum(len(r)) AS BIGINT) FROM raw) AS total_len,
    (SELECT sum(len(r)) / count(*) FROM raw) AS avgdl, count(DISTINCT term) AS vocabulary FROM post"""
)
def vocab_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = T.tokens(docs).select("term").distinct().agg(F.count("*").alias("vocabulary"))
    return I.corpus_stats(I.doc_lengths(docs)).withColumn("vocabulary", words.select("vocabulary").scalar())


@query(f"WITH {TOKENS}, {ONE}, {SCORES} SELECT {', '.join(HITS)} FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.search_index(stored_index(spark, d), one_query(spark), 10, stem=False).select(*HITS)


@query(f"WITH {TOKENS}, {BENCH}, {SCORES} SELECT {', '.join(HITS)} FROM ranked WHERE rank <= 10")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.search_index(stored_index(spark, d), bench_queries(spark, d), 10, stem=False).select(*HITS)


@query(f"WITH {TOKENS}, {BENCH}, {SCORES} SELECT {', '.join(HITS)} FROM ranked WHERE rank > 10 AND rank <= 20")
def bm25_paged(spark: SparkSession, d: str) -> DataFrame:
    ranked = R.search_index(stored_index(spark, d), bench_queries(spark, d), 20, stem=False)
    return R.page(ranked, 10, 10).select(*HITS)


@query(f"WITH {TOKENS}, {BENCH}, {SCORES} SELECT {', '.join(HITS)} FROM ranked WHERE rank <= 5")
def wand_topk(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval by block bounds gives what scoring everything gives."""
    return R.block_max_top(stored_index(spark, d), bench_queries(spark, d), 5, stem=False).select(*HITS)


UPPER = "times * ln(greatest(n - df + 0.5, 0.5) / (df + 0.5) + 1) * max_tf * 2.2 / (max_tf + 1.2 * (1 - 0.75 + 0.75 * min_len / avgdl))"


@query(
    f"""WITH {TOKENS}, {ONE}, {SCORES}, bl AS (SELECT term, CAST(floor(doc_id / 64.0) AS BIGINT) AS block, max(tf) AS max_tf, min(dl) AS min_len FROM post GROUP BY ALL)
    SELECT query_id, block, {half_away_sql(f"sum({UPPER})", 6)} AS bound FROM bl JOIN df USING (term) JOIN qt USING (term), stats GROUP BY query_id, block"""
)
def block_upper_bounds(spark: SparkSession, d: str) -> DataFrame:
    bounds = R.block_bounds(stored_index(spark, d), one_query(spark), stem=False)
    return bounds.select("query_id", "block", half_away(F.col("bound"), 6).alias("bound"))


@query(
    f"""WITH {TOKENS} SELECT term, CAST(floor(doc_id / 64.0) AS BIGINT) AS block, count(*) AS n, max(tf) AS max_tf, min(dl) AS min_len, max(doc_id) AS max_id
    FROM post GROUP BY term, block"""
)
def block_max_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.block_stats(table(spark, d, "documents"))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).terms.select("term", F.col("cf").alias("frequency"))


@query(
    f"""WITH {TOKENS}, f AS (SELECT term, CAST(sum(tf) AS BIGINT) AS frequency FROM post GROUP BY term)
    SELECT term, frequency FROM f WHERE starts_with(term, 'th') AND length(term) <= 64 ORDER BY frequency DESC, term LIMIT 50"""
)
def autocomplete_prefix(spark: SparkSession, d: str) -> DataFrame:
    return R.complete(_frequencies(spark, d), " Th ", 50)


@query(
    f"""WITH {TOKENS}, v AS (SELECT DISTINCT term FROM post), p AS (SELECT DISTINCT substr(term, 1, i) AS prefix FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM v))
    SELECT count(*) AS nodes FROM p"""
)
def trie_node_count(spark: SparkSession, d: str) -> DataFrame:
    return R.prefix_count(_frequencies(spark, d).select("term"))


@query(None)
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return R.search_index(stored_index(spark, d, stem=True), bench_queries(spark, d), 10, stem=True).select(*HITS)


@query(None)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """Highlighted passages of the best hits only: ranking first, texts afterwards."""
    docs, queries = table(spark, d, "documents"), bench_queries(spark, d)
    words = queries.select("query_id", F.filter(T.fields(F.lower("query")), lambda w: ~T.is_stopword(w)).alias("words"))
    best = R.held(R.search_index(stored_index(spark, d), queries, 3, stem=False)).join(docs.select("doc_id", "text"), "doc_id").join(words, "query_id")
    return best.select("query_id", "doc_id", "score", R.snippet(F.col("text"), F.col("words")).alias("snippet"))


@query(
    """WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, E' \\t\\x0B\\x0C\\r\\n')) AS lines FROM documents),
    t AS (SELECT doc_id, list_filter(lines, lambda x: starts_with(x, '# '))[1] AS h, list_filter(lines, lambda x: octet_length(encode(x)) > 0 AND octet_length(encode(x)) <= 80)[1] AS s FROM l)
    SELECT doc_id, coalesce(nullif(trim(substr(h, 3)), ''), s, 'Plain Text Document') AS title FROM t"""
)
def plain_text_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.plain_title(F.col("text"), F.lit("Plain Text Document")).alias("title"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\s+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query(
    """WITH t AS (SELECT conv_id, turn, concat('<Context>', coalesce(text, ''), '</context>') AS x FROM conversations)
    SELECT conv_id, turn, regexp_replace(x, '<(/?context)>', '&lt;\\1&gt;', 'gi') AS clean FROM t"""
)
def sanitize_context(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("<Context>"), F.coalesce("text", F.lit("")), F.lit("</context>"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitize_context(wrapped).alias("clean"))


@query(
    """WITH t AS (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license'))[1], ' ') AS x FROM documents)
    SELECT doc_id, trim(regexp_replace(trim(regexp_replace(x, '^#', ''), ' '), '^-', ''), ' ') AS field FROM t WHERE x IS NOT NULL"""
)
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.extract_field(F.col("text"), "License").alias("field")).where("field is not null")


@query(
    f"""WITH w AS (SELECT item_id, trim(unnest({fields_sql("lower(text)")}), '{EMBED_TRIM.replace("'", "''")}') AS word FROM benchmark),
    f AS (SELECT item_id, unnest(list_concat([word], list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2]), list_transform(range(1, length(word) - 2), lambda i: word[i:i + 3]))) AS key FROM w WHERE word <> '' AND word NOT IN ({STOP})),
    keys AS (SELECT DISTINCT key FROM f), {RING_SQL},
    s AS (SELECT item_id, CAST(h % 128 AS INTEGER) AS dim, sum(CASE WHEN h % 2 = 1 THEN -1 ELSE 1 END) AS x FROM f JOIN h0 USING (key) GROUP BY item_id, dim),
    n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY item_id)
    SELECT item_id, dim, CAST(round(CAST(x AS DOUBLE) / norm, 6) AS DOUBLE) AS x FROM s JOIN n USING (item_id) WHERE x <> 0"""
)
def embed_ngram(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings of benchmark texts, by dimension; zeros are left out."""
    own = table(spark, d, "benchmark").select("item_id", F.posexplode(T.embedding(F.col("text"))).alias("dim", "x"))
    return own.select("item_id", "dim", F.round("x", 6).alias("x")).where("x != 0")

"""Queries of vector and word search, fusion, hierarchy, budgets and merged results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, text
from ..operators import search
from ..sources.tables import table
from .registry import query

TIER_SQL = "CASE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' ELSE 'UNV' END"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
#: The stated query set: every vector, and every benchmark item, whose id is divisible by 20.
STATED = 20


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") % STATED == 0).select(F.col("vec_id").alias("query_id"), "embedding")


_COSINE_SQL = (
    f"SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % {STATED} = 0"
)
_NEAR_SQL = f"SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM ({_COSINE_SQL})"


@query(f"SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM ({_NEAR_SQL}) WHERE rank <= 5")
def vector_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    found = search.vector_topk(table(spark, d, "embeddings"), _queries(spark, d), 5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT query_id, count(*) AS hits, max(round(s, 6)) AS best FROM ({_COSINE_SQL}) WHERE s >= 0.3 AND query_id <> vec_id GROUP BY query_id")
def vector_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    near = search.vectors_within(table(spark, d, "embeddings"), _queries(spark, d), 0.3).where("query_id <> vec_id")
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max(F.round("similarity", 6)).alias("best"))


@query(
    "SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2"
)
def vector_centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(F.col("item_id") % STATED == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEX_SQL = (
    f"p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)) GROUP BY 1, 2), "
    "n AS (SELECT count(*) AS docs, avg(dl) AS mean_dl FROM (SELECT doc_id, max(dl) AS dl FROM p GROUP BY 1)), "
    f"t AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format('text')})) AS term FROM benchmark WHERE item_id % {STATED} = 0), "
    "f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY 1), "
    "k AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_dl))), 6) AS keyword_score, count(*) AS matched "
    "FROM t JOIN f USING (term) JOIN p USING (term) CROSS JOIN n GROUP BY 1, 2)"
)
_SHORT_SQL = "FROM (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS text FROM benchmark)"
_RANKED_SQL = "row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, doc_id) AS rank"


@query(f"WITH {_INDEX_SQL} SELECT * FROM (SELECT query_id, doc_id, keyword_score, {_RANKED_SQL} FROM k) WHERE rank <= 5")
def keyword_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search_words(table(spark, d, "documents"), _asked(spark, d), 5)


@query(
    f"WITH {_INDEX_SQL.replace('FROM benchmark', _SHORT_SQL)}, w AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1) SELECT * FROM (SELECT query_id, doc_id, keyword_score, {_RANKED_SQL} FROM k JOIN w USING (query_id) WHERE matched = n) WHERE rank <= 50"
)
def keyword_and_search(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 3), " "))  # two or three words each
    return search.search_words(table(spark, d, "documents"), asked, 50, every_term=True)


_FUSED_SQL = (
    f"WITH {_INDEX_SQL}, kw AS (SELECT * FROM (SELECT query_id, doc_id, keyword_score, {_RANKED_SQL} FROM k) WHERE rank <= 5), "
    f"ve AS (SELECT query_id, vec_id AS doc_id, s AS similarity, rank FROM ({_NEAR_SQL}) WHERE rank <= 5), "
    "al AS (SELECT query_id, doc_id, similarity, 0.0::DOUBLE AS keyword_score, rank, 0 AS list FROM ve UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE, keyword_score, rank, 1 FROM kw), "
    "fu AS (SELECT query_id, doc_id, max(similarity) AS similarity, max(keyword_score) AS keyword_score, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(list * 1000 + rank) AS tie FROM al GROUP BY 1, 2) "
)


@query(
    f"{_FUSED_SQL} SELECT query_id, doc_id, round(similarity, 6) AS similarity, keyword_score, round(fused, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, tie) AS fused_rank FROM fu"
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    near = search.vector_topk(table(spark, d, "embeddings"), _queries(spark, d), 5)
    found = search.search_words(table(spark, d, "documents"), _asked(spark, d), 5)
    fused = search.reciprocal_rank_fusion(near, found)
    return fused.withColumn("similarity", F.round("similarity", 6)).withColumn("fused", F.round("fused", 6))


_BOOST = "CASE WHEN NOT any_p1 THEN 1.0 WHEN tier = 'P1' THEN 1.5 WHEN tier = 'P3' THEN 0.5 WHEN tier = 'UNV' THEN 0.3 ELSE 1.0 END"
_BEST_SQL = (
    f"{_FUSED_SQL}, jo AS (SELECT fu.*, {TIER_SQL} AS tier, text FROM fu JOIN documents USING (doc_id)), an AS (SELECT *, bool_or(tier = 'P1') OVER (PARTITION BY query_id) AS any_p1 FROM jo), "
    f"we AS (SELECT *, round(CAST(fused * {_BOOST} AS DOUBLE), 9) AS weighted FROM an), ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, doc_id) AS weighted_rank FROM we)"
)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", quality.corpus_tier(F.col("source")).alias("source_tier"))


_BUDGET = (
    "SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY weighted_rank) AS cum FROM (SELECT *, greatest(1, length(text) // 4) AS n FROM ra WHERE weighted_rank <= 3 AND (similarity >= 0.0 OR keyword_score > 0))"
)


@query(
    f"{_BEST_SQL}, bu AS ({_BUDGET}), ou AS (SELECT *, 2000 - (cum - n) AS room, coalesce(max(cum) OVER (PARTITION BY query_id ORDER BY weighted_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 2000 AS fst FROM bu) "
    "SELECT query_id, doc_id, tier AS source_tier, round(fused, 6) AS fused, round(weighted, 6) AS weighted, weighted_rank, CAST(CASE WHEN cum > 2000 THEN room ELSE n END AS BIGINT) AS token_count, "
    "length(CASE WHEN cum > 2000 THEN substring(text, 1, CAST(room * 4 AS INT)) ELSE text END) AS chars FROM ou WHERE cum <= 2000 OR (fst AND room > 50)"
)
def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).join(_queries(spark, d), "query_id", "full_outer").withColumn("query", F.coalesce("query", F.lit("")))
    best = search.retrieve(_corpus(spark, d), table(spark, d, "embeddings"), asked, least=None)
    return best.select(
        "query_id", "doc_id", "source_tier", F.round("fused", 6).alias("fused"), F.round("weighted", 6).alias("weighted"), "weighted_rank", "token_count", F.length("text").cast("long").alias("chars")
    )


@query(
    f"SELECT lang, doc_id, tier AS source_tier, round(CAST(n_chars * CASE WHEN NOT any_p1 THEN 1.0 WHEN tier = 'P1' THEN 1.5 WHEN tier = 'P3' THEN 0.5 WHEN tier = 'UNV' THEN 0.3 ELSE 1.0 END AS DOUBLE), 6) AS weighted FROM "
    f"(SELECT lang, doc_id, n_chars, tier, bool_or(tier = 'P1') OVER (PARTITION BY lang) AS any_p1 FROM (SELECT lang, doc_id, n_chars, {TIER_SQL} AS tier FROM documents))"
)
def source_hierarchy_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", "doc_id", "n_chars", quality.corpus_tier(F.col("source")).alias("source_tier"))
    ranked = search.weigh_by_tier(rows, "n_chars", by="lang")
    return ranked.select("lang", "doc_id", "source_tier", F.round(F.col("weighted").cast("double"), 6).alias("weighted"))


@query(
    "SELECT source, doc_id, CAST(CASE WHEN cum > 2000 THEN room ELSE n END AS BIGINT) AS token_count, cum > 2000 AS partial FROM (SELECT *, 2000 - (cum - n) AS room, "
    "coalesce(max(cum) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 2000 AS fst FROM (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS cum "
    "FROM (SELECT source, doc_id, greatest(1, length(text) // 4) AS n FROM documents))) WHERE cum <= 2000 OR (fst AND room > 50)"
)
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    near = search.before_budget(docs, 2000, "doc_id", by="source")
    return search.token_budget(near, 2000, "doc_id", by="source").select("source", "doc_id", "token_count", "partial")


_RESULTS_SQL = (
    f"(SELECT 'https://x.example.org/' || (doc_id % 500) AS url, {TIER_SQL} AS tier, 0 AS source_pos, doc_id AS pos, lang FROM documents UNION ALL SELECT url, 'P3', 1, page_id, 'en' FROM pages UNION ALL SELECT '', 'P1', 2, page_id, 'en' FROM pages)"
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://x.example.org/"), (F.col("doc_id") % 500).cast("string"))
    docs = table(spark, d, "documents").select(url.alias("url"), quality.corpus_tier(F.col("source")).alias("tier"), F.lit(0).alias("source_pos"), F.col("doc_id").alias("pos"), "lang")
    pages = table(spark, d, "pages")
    more = pages.select("url", F.lit("P3").alias("tier"), F.lit(1).alias("source_pos"), F.col("page_id").alias("pos"), F.lit("en").alias("lang"))
    blank = pages.select(F.lit("").alias("url"), F.lit("P1").alias("tier"), F.lit(2).alias("source_pos"), F.col("page_id").alias("pos"), F.lit("en").alias("lang"))
    return docs.union(more).union(blank)


_ORDER = "CASE tier WHEN 'P1' THEN 0 WHEN 'P2' THEN 1 WHEN 'P3' THEN 2 WHEN 'UNV' THEN 3 ELSE 4 END"


@query(
    f"SELECT url, tier, pos FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}, source_pos, pos) AS o FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_pos, pos) AS n FROM {_RESULTS_SQL} WHERE url <> '') WHERE n = 1) WHERE o <= 20"
)
def search_router_merge(spark: SparkSession, d: str) -> DataFrame:
    return search.merge_sources(_results(spark, d), limit=20).select("url", "tier", "pos")


@query(f"SELECT url, tier, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_pos, pos) AS n FROM {_RESULTS_SQL} WHERE url <> '') WHERE n = 1")
def merge_dedup_by_url(spark: SparkSession, d: str) -> DataFrame:
    return search.merge_sources(_results(spark, d)).select("url", "tier", "pos")


@query(
    f"WITH r AS (SELECT lang, doc_id, tier, {_ORDER} AS o FROM (SELECT lang, doc_id, CASE lang WHEN 'en' THEN {TIER_SQL} WHEN 'fr' THEN replace({TIER_SQL}, 'P1', 'P2') ELSE replace(replace({TIER_SQL}, 'P1', 'UNV'), 'P2', 'UNV') END AS tier FROM documents)), "
    "b AS (SELECT *, min(o) OVER (PARTITION BY lang) AS best, row_number() OVER (PARTITION BY lang, o ORDER BY doc_id) AS i FROM r), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS p FROM b WHERE best >= 2 AND ((o = 2 AND i <= 3) OR o > 2)) "
    "SELECT lang, doc_id, tier, tier = 'P3' AS flagged FROM b WHERE best < 2 AND o = best AND i <= 5 UNION ALL SELECT lang, doc_id, tier, tier = 'P3' FROM t WHERE p <= 3"
)
def tier_enforce_per_lang(spark: SparkSession, d: str) -> DataFrame:
    tier = quality.corpus_tier(F.col("source"))
    worse = F.replace(F.replace(tier, F.lit("P1"), F.lit("UNV")), F.lit("P2"), F.lit("UNV"))
    given = F.when(F.col("lang") == "en", tier).when(F.col("lang") == "fr", F.replace(tier, F.lit("P1"), F.lit("P2"))).otherwise(worse)
    return search.tier_filter(table(spark, d, "documents").select("lang", "doc_id", given.alias("tier")), "lang", "doc_id")


@query(
    "SELECT o_orderkey, decayed, row_number() OVER (PARTITION BY o_orderstatus ORDER BY decayed DESC, o_orderkey) AS decayed_rank FROM (SELECT o_orderkey, o_orderstatus, "
    "round(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice * 0.9::DOUBLE ELSE o_totalprice * pow(0.95::DOUBLE, greatest(0, 2024 - year(o_orderdate))) END, 6) AS decayed FROM orders)"
)
def temporal_decay_rank(spark: SparkSession, d: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", date.alias("date"))
    return search.temporal_rank(rows, "o_orderstatus", 2024, "o_totalprice", "date", "o_orderkey").select("o_orderkey", "decayed", "decayed_rank")


@query(
    f"SELECT tier, count(*) AS docs, round(avg(n_chars), 4) AS mean_chars, CAST(sum(CASE WHEN length(text) % 4 = 0 THEN length(text) // 4 ELSE length(text) // 4 + 1 END) AS BIGINT) AS tokens_up FROM (SELECT *, {TIER_SQL} AS tier FROM documents) GROUP BY tier"
)
def corpus_by_tier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tier", quality.corpus_tier(F.col("source")))
    return docs.groupBy("tier").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.sum(text.ceil_tokens(F.col("text"))).alias("tokens_up"))

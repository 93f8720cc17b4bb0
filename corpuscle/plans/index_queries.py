"""Queries over stored indexes, by SQL functions, of paths in the graph and of replayed logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.stem import stems_sql
from ..operators import cycles, graph_paths, inverted_index, replay, table_functions, trigrams, vector_index
from ..operators.search import vector_topk
from ..sources.tables import durable, table
from .knowledge_queries import _EDGES_SQL, graph_edges
from .registry import query
from .retrieval_queries import _NEAR_SQL, STATED, TIER_SQL, _asked, _queries
from .text_queries import _fixed_sql

_TERMS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(asked: str, k: int, every: bool = False, where: str = "TRUE") -> str:
    every_sql = "WHERE matched = wanted" if every else ""
    return f"""
WITH flat AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents)),
v AS (SELECT o, term FROM {stems_sql('(SELECT DISTINCT term AS o, term FROM flat)')}),
p AS (SELECT doc_id, v.term, count(*) AS tf, any_value(dl) AS dl FROM flat JOIN v ON flat.term = v.o GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS docs, avg(dl) AS mean_dl FROM (SELECT doc_id, max(dl) AS dl FROM p GROUP BY 1)),
t AS (SELECT DISTINCT query_id, term FROM {stems_sql(f"(SELECT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM {asked} WHERE item_id % {STATED} = 0)")}),
q AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY 1),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_dl))), 6) AS keyword_score, count(*) AS matched
  FROM t JOIN f USING (term) JOIN p USING (term) CROSS JOIN n GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, doc_id, keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, doc_id) AS rank
  FROM s JOIN q USING (query_id) JOIN documents d USING (doc_id) {every_sql} {'AND' if every else 'WHERE'} {where}) WHERE rank <= {k}"""


def _index(spark: SparkSession, d: str) -> inverted_index.InvertedIndex:
    """The index of ``documents``, built in two batches."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    index = inverted_index.create_index(spark, f"words_{uuid.uuid4().hex}", docs, ["lang", "source"], buckets=inverted_index.buckets_for(docs))
    for batch, part in enumerate(("doc_id % 3 > 0", "true")):  # the second finds a part of its documents indexed
        inverted_index.add_documents(index, docs.where(part), batch)
    return index


@query(_bm25_sql("benchmark", 5))
def index_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return inverted_index.search_index(_index(spark, d), _asked(spark, d), 5)


_SHORT_SQL = "(SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS text FROM benchmark)"


@query(_bm25_sql(_SHORT_SQL, 50, True, "lang = 'en'"))
def index_every_word_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 3), " "))
    return inverted_index.search_index(_index(spark, d), asked, 50, every_term=True, where=F.col("lang") == "en")


@query()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    index = vector_index.build_vector_index(table(spark, d, "embeddings"))
    return vector_index.search_vectors(index, _queries(spark, d), 5).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % {STATED} = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds nine of ten exact neighbours."""
    vectors, asked = table(spark, d, "embeddings"), _queries(spark, d)
    found = vector_index.search_vectors(vector_index.build_vector_index(vectors), asked, 10)
    return vector_index.recall(durable(found), vector_topk(vectors, asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM ({_NEAR_SQL}) WHERE rank <= 5")
def vector_index_all_lists(spark: SparkSession, d: str) -> DataFrame:
    """All lists as probes are an exact search."""
    index = vector_index.build_vector_index(table(spark, d, "embeddings"))
    return vector_index.search_vectors(index, _queries(spark, d), 5, probes=len(index.centres)).withColumn("similarity", F.round("similarity", 6))


_PATTERN = "substr(text, 1 + item_id % 7, 2 + item_id % 3 * 9)"


@query(
    f"SELECT query_id, doc_id FROM documents JOIN (SELECT item_id AS query_id, {_PATTERN} AS pattern FROM benchmark WHERE item_id % {STATED} = 0) ON contains(lower(text), lower(pattern))"
)
def trigram_substrings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    patterns = table(spark, d, "benchmark").where(F.col("item_id") % STATED == 0).selectExpr("item_id AS query_id", f"{_PATTERN.replace('substr(text, 1 + item_id % 7, 2 + item_id % 3 * 9)', 'substr(text, CAST(1 + item_id % 7 AS INT), CAST(2 + item_id % 3 * 9 AS INT))')} AS pattern")
    return trigrams.search_substrings(trigrams.build_trigram_index(docs), docs, patterns)


_GRAMS_SQL = (
    "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)


@query(
    f"WITH g AS (SELECT page_id, {_GRAMS_SQL.format('url')} AS g FROM pages), c AS (SELECT q.page_id AS query_id, p.page_id AS doc_id, len(list_intersect(q.g, p.g)) AS c, len(q.g) AS n, len(p.g) AS m FROM g q JOIN g p ON q.page_id % {STATED} = 0) "
    "SELECT query_id, doc_id, round(c::DOUBLE / (n + m - c), 6) AS similarity FROM c WHERE c::DOUBLE / (n + m - c) >= 0.5"
)
def trigram_similar_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    asked = pages.where(F.col("doc_id") % STATED == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return trigrams.search_similar(trigrams.build_trigram_index(pages, padded=True), asked, 0.5).withColumn("similarity", F.round("similarity", 6))


def _corpus(spark: SparkSession, d: str) -> str:
    """A view of the documents with vectors, tiers, domains and kinds."""
    name = f"corpus_{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", quality.corpus_tier(F.col("source")).alias("source_tier"), F.col("source").alias("domain"), F.col("lang").alias("doc_type"), "text")
    docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").createOrReplaceTempView(name)
    return name


@query(f"SELECT doc_id, chunk_index, total_chunks, token_count, chunk_sha FROM ({_fixed_sql(400, 320, 320)})")
def sql_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    name = _corpus(spark, d)
    table_functions.register(spark, name)
    made = spark.sql(f"SELECT doc_id, c.* FROM {name}, LATERAL chunk_text(text, 'fixed', 100, 0.2) c")
    return made.withColumn("chunk_sha", F.sha2("chunk", 256)).drop("chunk")


@query(
    f"SELECT q.vec_id AS query_id, doc_id, source_tier, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS place FROM "
    f"(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity, {TIER_SQL} AS source_tier "
    f"FROM embeddings q JOIN embeddings v ON q.vec_id % {STATED} = 0 JOIN documents d ON d.doc_id = v.vec_id) WHERE s >= 0.1 AND source_tier = 'P1') r JOIN embeddings q ON q.vec_id = r.query_id WHERE place <= 3"
)
def sql_search_documents(spark: SparkSession, d: str) -> DataFrame:
    name = _corpus(spark, d)
    table_functions.register(spark, name)
    found = table_functions.search_asked(spark, name, _queries(spark, d), 0.1, 3, filter_tier="P1")
    return found.select("query_id", "doc_id", "source_tier", F.round("similarity", 6).alias("similarity"))


_PATHS_SQL = f"""
WITH RECURSIVE e AS (
  SELECT src, dst, src || '>' || dst AS relation FROM {_EDGES_SQL} UNION ALL SELECT 'r' || r_regionkey, 'world', 'top' FROM region UNION ALL SELECT 'world', 'c' || c_custkey, 'has' FROM customer WHERE c_custkey % 10 = 0
),
p AS (SELECT s_suppkey AS pair_id, 's' || s_suppkey AS start, 'n' || (s_suppkey % 25) AS goal FROM supplier),
f(pair_id, node, d) AS (SELECT pair_id, start, 0 FROM p UNION SELECT pair_id, dst, d + 1 FROM f JOIN e ON src = node WHERE d < 4),
b(pair_id, node, d) AS (SELECT pair_id, goal, 0 FROM p UNION SELECT pair_id, src, d + 1 FROM b JOIN e ON dst = node WHERE d < 4),
fd AS (SELECT pair_id, node, min(d) AS d FROM f GROUP BY 1, 2), bd AS (SELECT pair_id, node, min(d) AS d FROM b GROUP BY 1, 2),
m AS (SELECT pair_id, min(fd.d + bd.d) AS distance FROM fd JOIN bd USING (pair_id, node) GROUP BY 1)
SELECT pair_id, distance::BIGINT AS distance, distance::INT AS steps FROM m
"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d).withColumn("relation", F.concat("src", F.lit(">"), "dst"))
    top = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("src"), F.lit("world").alias("dst"), F.lit("top").alias("relation"))
    down = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("world").alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"), F.lit("has").alias("relation"))
    return edges.union(top).union(down)


@query(_PATHS_SQL)
def kg_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's shortest way to a nation; ``steps`` counts the path's relations that are edges in a row."""
    pairs = table(spark, d, "supplier").selectExpr("s_suppkey AS pair_id", "concat('s', s_suppkey) AS start", "concat('n', s_suppkey % 25) AS goal")
    found = durable(graph_paths.connections(_linked(spark, d), pairs))
    hops = found.select("pair_id", "distance", F.posexplode_outer("relations").alias("i", "relation"), "nodes").withColumns({"src": F.get("nodes", F.col("i")), "dst": F.get("nodes", F.col("i") + 1)})
    real = hops.join(_linked(spark, d).withColumn("edge", F.lit(1)), ["src", "dst", "relation"], "left")
    return real.groupBy("pair_id", "distance").agg(F.count("edge").cast("int").alias("steps"))


_REPLAY_SQL = """
WITH RECURSIVE u AS (
  SELECT doc_id AS update_id, doc_id % 50 AS page_id, CASE WHEN doc_id % 2 = 1 THEN (doc_id // 50) % 10 END AS base_version, (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 3 AS p1,
    row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS i FROM documents
),
w(page_id, i, update_id, accepted, version, state) AS (
  SELECT DISTINCT page_id, 0::BIGINT, NULL::BIGINT, FALSE, page_id % 3, ['draft', 'active', 'stale', 'contradicted', 'archived'][CAST(page_id % 5 AS INT) + 1] FROM u WHERE page_id < 45
  UNION ALL
  SELECT u.page_id, u.i, u.update_id, coalesce(u.base_version = w.version, TRUE), w.version + CASE WHEN coalesce(u.base_version = w.version, TRUE) THEN 1 ELSE 0 END,
    CASE WHEN NOT coalesce(u.base_version = w.version, TRUE) THEN w.state WHEN u.confidence >= 0.5 AND u.p1 > 0 AND w.state IN ('draft', 'stale', 'contradicted') THEN 'active'
      WHEN w.state = 'stale' AND u.confidence >= 0.5 OR w.state = 'contradicted' AND u.confidence >= 0.7 THEN 'active' ELSE w.state END
  FROM w JOIN u ON u.page_id = w.page_id AND u.i = w.i + 1
)
"""


def _replayed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    pages = docs.selectExpr("doc_id % 50 AS page_id").distinct().where("page_id < 45").selectExpr(
        "page_id", "element_at(array('draft', 'active', 'stale', 'contradicted', 'archived'), CAST(page_id % 5 AS INT) + 1) AS state", "page_id % 3 AS version", "'old' AS content", "0D AS confidence", "0L AS p1", "0L AS p2", "0L AS p3"
    )
    updates = docs.selectExpr(
        "doc_id AS update_id", "doc_id % 50 AS page_id", "CASE WHEN doc_id % 2 = 1 THEN doc_id div 50 % 10 END AS base_version", "source AS content", "(doc_id % 10) / 10D AS confidence", "doc_id % 3 AS p1", "1L AS p2", "0L AS p3"
    )
    return replay.replay_updates(pages, updates)


@query(
    f"{_REPLAY_SQL} SELECT page_id, update_id, accepted, CASE WHEN accepted THEN version - 1 END AS base_version, CASE WHEN accepted THEN version END AS result_version, state FROM w WHERE i > 0 "
    "UNION ALL SELECT page_id, update_id, FALSE, NULL, NULL, NULL FROM u WHERE page_id >= 45"
)
def page_replay_log(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)[1]


@query(
    f"{_REPLAY_SQL}, l AS (SELECT page_id, max(i) AS i FROM w GROUP BY 1), a AS (SELECT page_id, max(update_id) FILTER (accepted) AS update_id FROM w GROUP BY 1) "
    "SELECT page_id, w.state, w.version, coalesce(source, 'old') AS content FROM w JOIN l USING (page_id, i) JOIN a USING (page_id) LEFT JOIN documents ON doc_id = a.update_id"
)
def page_replay_pages(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)[0].select("page_id", "state", "version", "content")


@query(f"SELECT query_id, doc_id, keyword_score AS score FROM ({_bm25_sql('benchmark', 4)})")
def sql_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    name = _corpus(spark, d)
    docs = spark.table(name)
    index = inverted_index.create_index(spark, f"words_{uuid.uuid4().hex}", docs, ["source_tier"], buckets=inverted_index.buckets_for(docs))
    inverted_index.add_documents(index, docs, 0)
    table_functions.register(spark, name, index)
    return table_functions.keyword_asked(index, _asked(spark, d), 4).select("query_id", "doc_id", "score")


_CYCLES_SQL = """
WITH k0 AS (SELECT question_id, url, 0 AS cycle FROM (SELECT doc_id % 40 AS question_id, 'u' || (doc_id * 7 % 300) AS url FROM documents WHERE doc_id % 5 = 0) GROUP BY ALL),
g AS (SELECT question_id, cycle, gap_no, 'gap ' || ((question_id * 7 + cycle * 3 + gap_no) % 45) AS gap FROM (SELECT DISTINCT doc_id % 40 AS question_id FROM documents), (SELECT unnest([1, 2]) AS cycle), (SELECT unnest([0, 1, 2]) AS gap_no) WHERE (question_id + cycle) % 6 > 0),
o AS (SELECT gap, url FROM (SELECT 'gap ' || (doc_id % 60) AS gap, 'u' || (doc_id * 11 % 400) AS url, row_number() OVER (PARTITION BY doc_id % 60, doc_id % 3 ORDER BY doc_id) AS n FROM documents) WHERE n <= 2),
k1 AS (SELECT DISTINCT question_id, url, 1 AS cycle FROM g JOIN o USING (gap) JOIN (SELECT DISTINCT question_id FROM k0) USING (question_id) WHERE cycle = 1 AND NOT EXISTS (SELECT 1 FROM k0 WHERE k0.question_id = g.question_id AND k0.url = o.url)),
k2 AS (SELECT DISTINCT question_id, url, 2 AS cycle FROM g JOIN o USING (gap) JOIN (SELECT DISTINCT question_id FROM k1) USING (question_id) WHERE cycle = 2 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1) k WHERE k.question_id = g.question_id AND k.url = o.url))
SELECT question_id, url, cycle::BIGINT AS cycle FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)
"""


@query(_CYCLES_SQL)
def research_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Forty questions, what documents say first, and recorded answers to what is missing."""
    docs = table(spark, d, "documents")
    first = docs.where("doc_id % 5 = 0").selectExpr("doc_id % 40 AS question_id", "concat('u', doc_id * 7 % 300) AS url", "source", "doc_id AS pos")
    asks = docs.selectExpr("doc_id % 40 AS question_id").distinct().selectExpr("question_id", "explode(array(1L, 2L)) AS cycle").selectExpr("question_id", "cycle", "explode(array(0L, 1L, 2L)) AS gap_no").where("(question_id + cycle) % 6 > 0")
    gaps = asks.withColumn("gap", F.expr("concat('gap ', (question_id * 7 + cycle * 3 + gap_no) % 45)"))
    answers = docs.selectExpr("concat('gap ', doc_id % 60) AS gap", "doc_id % 3 AS source", "doc_id AS pos", "concat('u', doc_id * 11 % 400) AS url")
    return cycles.research_cycles(first.withColumn("source", F.lit(0).cast("long")), gaps, answers).select("question_id", "url", "cycle")

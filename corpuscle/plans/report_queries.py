"""Queries of citations, answers, contexts, reports, statements, page updates and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, text
from ..operators import claims, knowledge, reports, search
from ..sources import connectors
from ..sources.tables import table
from .knowledge_queries import _EDGES_SQL, graph_edges
from .registry import query
from .retrieval_queries import TIER_SQL

#: Lists of five documents each, as a search would return them.
_SIMILAR = "doc_id * 37 % 100 / 100.0"
_CHUNKS_SQL = (
    "c AS (SELECT doc_id // 5 AS query_id, doc_id % 5 AS rank, round(CAST(doc_id * 37 % 100 AS DOUBLE) / 100, 2) AS similarity, CASE WHEN doc_id % 3 = 0 THEN 'Au ' || source || ', J.' END AS author, "
    "CASE WHEN doc_id % 2 = 0 THEN '23' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '.00001' ELSE '' END AS arxiv, source || '.example.org' AS domain, "
    f"{TIER_SQL} AS tier, 'https://' || source || '.example.org/20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') AS url, lang AS title, text FROM documents)"
)
_CITE = "'[' || CASE WHEN author IS NOT NULL AND arxiv <> '' THEN string_split(author, ',')[1] || ' ' || arxiv[1:4] ELSE domain END || ', ' || tier || ']'"
_WORDS_IN = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def chunk_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    made = docs.selectExpr(
        "doc_id div 5 AS query_id", "doc_id % 5 AS rank", "round(CAST(doc_id * 37 % 100 AS DOUBLE) / 100, 2) AS similarity", "CASE WHEN doc_id % 3 = 0 THEN 'Au ' || source || ', J.' END AS author",
        "CASE WHEN doc_id % 2 = 0 THEN '23' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || '.00001' ELSE '' END AS arxiv", "source || '.example.org' AS domain", "source",
        "'https://' || source || '.example.org/20' || lpad(CAST(doc_id % 30 AS STRING), 2, '0') AS url", "lang AS title", "text",
    )
    return made.withColumn("tier", quality.corpus_tier(F.col("source"))).drop("source")


@query(f"WITH {_CHUNKS_SQL} SELECT query_id, rank, {_CITE} AS citation, '[' || CASE WHEN author IS NOT NULL THEN string_split(author, ',')[1] || ' ' || regexp_extract(url, '(20[0-9]{{2}})', 1) ELSE domain END || ', ' || tier || ']' AS source_citation FROM c")
def citation_formats(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("author", "arxiv", "domain", "tier", "url")]
    return chunk_lists(spark, d).select("query_id", "rank", reports.chunk_citation(*c[:4]).alias("citation"), reports.source_citation(c[4], c[3], c[0]).alias("source_citation"))


_DIRECT_SQL = (
    f"di AS (SELECT query_id, CASE WHEN len({_WORDS_IN.format('text')}) > 150 THEN CASE WHEN ends_with(h, '.') THEN h ELSE h || '.' END ELSE text END || ' ' || {_CITE} AS answer "
    "FROM (SELECT *, array_to_string(list_slice(string_split(text, '. '), 1, 3), '. ') AS h FROM c WHERE rank = (SELECT min(k.rank) FROM c k WHERE k.query_id = c.query_id) AND similarity >= 0.85))"
)
_CONTEXT_SQL = (
    f"co AS (SELECT query_id, string_agg('[Source ' || n || ' ' || {_CITE} || ']: ' || text, chr(10) || chr(10) ORDER BY n) AS context "
    "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM c) GROUP BY 1)"
)


@query(f"WITH {_CHUNKS_SQL}, {_DIRECT_SQL} SELECT query_id, md5(answer) AS answer, length(answer) AS chars FROM di")
def direct_answers(spark: SparkSession, d: str) -> DataFrame:
    return reports.direct_answer(chunk_lists(spark, d)).select("query_id", F.md5("answer").alias("answer"), F.length("answer").cast("long").alias("chars"))


@query(f"WITH {_CHUNKS_SQL}, {_CONTEXT_SQL} SELECT query_id, md5(context) AS context, length(context) AS chars FROM co")
def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    return reports.context(chunk_lists(spark, d)).select("query_id", F.md5("context").alias("context"), F.length("context").cast("long").alias("chars"))


@query(
    f"WITH {_CHUNKS_SQL}, {_DIRECT_SQL}, {_CONTEXT_SQL}, m AS (SELECT query_id, round(avg(similarity), 6) AS mean_similarity FROM c GROUP BY 1), "
    "a AS (SELECT query_id, mean_similarity, answer IS NOT NULL AS direct, coalesce(answer, left(context, CASE WHEN query_id % 2 = 0 THEN 1200 ELSE 600 END)) AS said FROM m LEFT JOIN di USING (query_id) LEFT JOIN co USING (query_id)) "
    "SELECT query_id, CASE WHEN direct THEN 'pass_through' ELSE 'raw_context' END AS method, md5(said) AS answer, greatest(1, length(said) // 4) AS token_count, mean_similarity FROM a"
)
def offline_answers(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_lists(spark, d)
    asked = chunks.select("query_id").distinct().withColumn("needs_table", F.col("query_id") % 2 == 0)
    return reports.answers(chunks, asked).withColumn("answer", F.md5("answer"))


@query(
    "SELECT doc_id, md5(CASE WHEN greatest(1, length(text) // 4) > 150 THEN CASE WHEN p > 0 AND p - 1 > length(h) * 0.7 THEN left(h, CAST(p AS BIGINT)) ELSE h END ELSE text END) AS capped FROM (SELECT *, CASE WHEN instr(h, '.') > 0 THEN length(h) - instr(reverse(h), '.') + 1 ELSE 0 END AS p FROM "
    f"(SELECT doc_id, text, array_to_string(list_slice({_WORDS_IN.format('text')}, 1, 150), ' ') AS h FROM documents))"
)
def capped_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(reports.cap_words(F.col("text"))).alias("capped"))


@query(
    f"WITH {_CHUNKS_SQL} SELECT query_id, md5(string_agg('--- Result ' || n || ' ' || s || ' ---' || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || url || chr(10) || 'Tier: ' || tier || ' | Similarity: ' || printf('%.3f', similarity) "
    "|| chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS rendered FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, "
    "'[' || CASE WHEN author IS NOT NULL THEN string_split(author, ',')[1] || ' ' || regexp_extract(url, '(20[0-9]{2})', 1) ELSE domain END || ', ' || tier || ']' AS s FROM c) GROUP BY 1"
)
def rendered_results(spark: SparkSession, d: str) -> DataFrame:
    return reports.render(chunk_lists(spark, d)).select("query_id", F.md5("rendered").alias("rendered"))


_REPORT = (
    "'# Report' || chr(10) || '## Executive Summary' || chr(10) || 'On ' || source || ' in ' || lang || '.' || chr(10) || chr(10) || '## KEY FINDINGS' || chr(10) || '| Finding | Evidence | Source |' || chr(10) || '|---|---|---|' || chr(10) || "
    "'| f' || doc_id || ' | ' || n_chars || ' characters | ' || source || ' | P1 | sure |' || chr(10) || '| too | short |' || chr(10) || '## ACTIVE DEBATE' || chr(10) || ' - ' || lang || ' or not' || chr(10) || '# no' || chr(10) || 'second ' || doc_id || chr(10) || '## SPECULATIVE FINDINGS' || chr(10) || 'maybe ' || source"
)


@query(
    "SELECT doc_id, 'summary' AS section, 0 AS line_no, 'On ' || source || ' in ' || lang || '.' AS cells FROM documents UNION ALL SELECT doc_id, 'findings', 0, 'f' || doc_id || '|' || n_chars || ' characters|' || source || '|P1|sure' FROM documents "
    "UNION ALL SELECT doc_id, 'debates', 0, '- ' || lang || ' or not' FROM documents UNION ALL SELECT doc_id, 'debates', 1, 'second ' || doc_id FROM documents UNION ALL SELECT doc_id, 'speculative', 0, 'maybe ' || source FROM documents"
)
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").selectExpr("doc_id", f"{_REPORT} AS text")
    return reports.report_lines(made, "doc_id").withColumn("cells", F.array_join("cells", "|"))


@query(
    "SELECT doc_id, 'look at ' || source || ' again|a dashed item of ' || lang AS gaps, CASE doc_id % 5 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'TENTATIVE' WHEN 2 THEN 'ACTIVE_DEBATE' WHEN 3 THEN 'SPECULATIVE' ELSE 'UNVERIFIED' END AS status FROM documents"
)
def gap_lines(spark: SparkSession, d: str) -> DataFrame:
    answer = F.expr("'Gaps:' || chr(10) || '1. short' || chr(10) || ' 2) look at ' || source || ' again' || chr(10) || '- tiny' || chr(10) || '- a dashed item of ' || lang")
    said = F.expr("element_at(array('[established]', 'quite Tentative', 'contested', '[SPECULATIVE]', 'who knows'), CAST(doc_id % 5 AS INT) + 1)")
    return table(spark, d, "documents").select("doc_id", F.array_join(reports.gaps(answer), "|").alias("gaps"), reports.claim_status(said).alias("status"))


_STATEMENTS_SQL = (
    f"s AS (SELECT doc_id // 5 AS query_id, doc_id, {TIER_SQL} AS tier, text || ' Use of ' || source || ' causes more work. It is known. We found that ' || lang || ' texts are long. So it is.' AS snippet FROM documents), "
    "x AS (SELECT query_id, doc_id, tier, list_concat(list_concat(" + ", ".join(
        f"regexp_extract_all(snippet, '(?is)([^.]*?(?:{verbs})[^.]*?\\.)[^.]*\\.', 1)" + (")" if i == 1 else "") for i, verbs in enumerate(claims.CAUSAL)
    ) + ") AS l FROM s), "
    "y AS (SELECT query_id, doc_id, tier, trim(unnest(l), e' \\t\\n\\r') AS claim, unnest(range(len(l))) AS n FROM x), "
    "o AS (SELECT query_id, claim, min_by(tier, doc_id * 100000 + n) AS tier, min(doc_id * 100000 + n) AS place FROM y WHERE length(claim) > 20 AND length(claim) < 300 GROUP BY 1, 2), "
    "st AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS claim_no, claim, CASE WHEN tier = 'P1' THEN 'experimental' ELSE 'unknown' END AS evidence FROM o QUALIFY claim_no <= 20)"
)


def _statements(spark: SparkSession, d: str) -> DataFrame:
    tail = F.expr("text || ' Use of ' || source || ' causes more work. It is known. We found that ' || lang || ' texts are long. So it is.'")
    return table(spark, d, "documents").select(F.expr("doc_id div 5").alias("query_id"), "doc_id", quality.corpus_tier(F.col("source")).alias("tier"), tail.alias("snippet"))


@query(f"WITH {_STATEMENTS_SQL} SELECT * FROM st")
def extract_statements(spark: SparkSession, d: str) -> DataFrame:
    return claims.extract_statements(_statements(spark, d), "query_id", "doc_id")


_SPLIT = "list_distinct(regexp_split_to_array({0}, '\\s+'))"


@query(
    f"WITH {_STATEMENTS_SQL}, m AS (SELECT query_id, claim_no, lower(left(claim, 50)) AS p, lower(snippet) AS l, tier FROM st JOIN s USING (query_id)), w AS (SELECT *, {_SPLIT.format('l')} AS a, {_SPLIT.format('p')} AS b FROM m), "
    "k AS (SELECT query_id, claim_no, tier, contains(l, p) OR len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.6 AS h FROM w), "
    "n AS (SELECT query_id, claim_no, count(*) FILTER (WHERE h) AS supporting, bool_or(tier = 'P1') AS p1 FROM k GROUP BY 1, 2) SELECT query_id, claim_no, supporting, "
    "CASE WHEN supporting >= 3 THEN 'ESTABLISHED' WHEN supporting = 2 THEN 'TENTATIVE' WHEN supporting = 1 THEN 'SPECULATIVE' ELSE 'UNVERIFIED' END AS status, "
    "round(CAST(CASE WHEN supporting >= 3 THEN 0.85 WHEN supporting = 2 THEN 0.65 ELSE 0.3 END + CASE WHEN p1 AND supporting > 0 THEN 0.1 ELSE 0 END AS DOUBLE), 2) AS confidence FROM n"
)
def statement_support(spark: SparkSession, d: str) -> DataFrame:
    sources = _statements(spark, d)
    return claims.count_support(claims.extract_statements(sources, "query_id", "doc_id"), sources, "query_id")


_SITES = ["arxiv.org", "www.nih.gov", "x.medium.com", "cs.ox.ac.uk", "notarxiv.org", "data.gov.uk", "mit.edu", "example.org"]


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' WHEN 3 THEN 'P2' WHEN 5 THEN 'P2' WHEN 6 THEN 'P2' ELSE {TIER_SQL} END AS tier FROM documents")
def url_tiers_narrow(spark: SparkSession, d: str) -> DataFrame:
    site = F.element_at(F.array(*map(F.lit, _SITES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", quality.source_tier_narrow(F.concat(F.lit("https://"), site, F.lit("/a")), quality.corpus_tier(F.col("source"))).alias("tier"))


@query(
    "SELECT doc_id, doc_id % 7 IN (0, 1, 2, 3) AS is_retracted, CASE doc_id % 7 WHEN 0 THEN source WHEN 1 THEN 'Retracted' WHEN 2 THEN 'RETRACTED: ' || lang WHEN 3 THEN 'Retraction of ' || lang ELSE '' END AS notice, "
    "CASE doc_id % 7 WHEN 1 THEN '2024-01-02' ELSE '' END AS retracted_at FROM documents"
)
def retraction_check(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr(
        "to_json(named_struct('message', named_struct('title', array(lang, CASE doc_id % 7 WHEN 2 THEN 'RETRACTED: ' || lang ELSE 'plain' END), "
        "'assertion', array(named_struct('name', CASE doc_id % 7 WHEN 0 THEN 'retracted' ELSE 'other' END, 'value', CASE doc_id % 7 WHEN 3 THEN 'Retraction of ' || lang ELSE source END)), "
        "'update-to', CASE WHEN doc_id % 7 IN (1, 4) THEN array(named_struct('type', CASE doc_id % 7 WHEN 1 THEN 'retraction' ELSE 'erratum' END, 'updated-date', '2024-01-02')) END)))"
    )
    return connectors.retractions(table(spark, d, "documents").select("doc_id", body.alias("body")), "doc_id")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(replace('--- Page 1 ---' || chr(10) || text, chr(12), chr(10)), '-\\n([\\p{L}\\p{N}_])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM (SELECT doc_id, replace(text, ' the ', ' th-' || chr(10) || 'e ' || chr(12) || chr(10) || chr(10)) AS text FROM documents)")
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit(" the "), F.lit(" th-\ne \f\n\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_pages(F.concat(F.lit("--- Page 1 ---\n"), broken))).alias("cleaned"))


_UPDATES_SQL = (
    "p AS (SELECT doc_id AS page_id, ['draft', 'active', 'stale', 'contradicted', 'archived'][CAST(doc_id % 5 AS INT) + 1] AS state, doc_id % 3 AS version FROM documents), "
    "u AS (SELECT doc_id AS update_id, doc_id // 2 * 2 + CASE WHEN doc_id % 11 = 0 THEN 100000000 ELSE 0 END AS page_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END AS base_version, (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 2 AS p1 FROM documents), "
    "j AS (SELECT u.*, state, version, version IS NOT NULL AND (base_version IS NULL OR base_version = version) AS fits FROM u LEFT JOIN p USING (page_id)), "
    "a AS (SELECT *, fits AND row_number() OVER (PARTITION BY page_id, fits ORDER BY update_id) = 1 AS accepted FROM j)"
)


def _page_updates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    pages = docs.selectExpr(
        "doc_id AS page_id", "element_at(array('draft', 'active', 'stale', 'contradicted', 'archived'), CAST(doc_id % 5 AS INT) + 1) AS state", "doc_id % 3 AS version", "'old' AS content", "0.0D AS confidence", "0L AS p1", "0L AS p2", "0L AS p3"
    )
    updates = docs.selectExpr(
        "doc_id AS update_id", "doc_id div 2 * 2 + CASE WHEN doc_id % 11 = 0 THEN 100000000 ELSE 0 END AS page_id", "CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END AS base_version", "source AS content",
        "(doc_id % 10) / 10.0D AS confidence", "doc_id % 2 AS p1", "1L AS p2", "0L AS p3",
    )
    return knowledge.update_pages(pages, updates)


@query(f"WITH {_UPDATES_SQL} SELECT page_id, update_id, accepted, CASE WHEN accepted THEN version END AS base_version, CASE WHEN accepted THEN version + 1 END AS result_version FROM a")
def page_update_log(spark: SparkSession, d: str) -> DataFrame:
    return _page_updates(spark, d)[1]


@query(
    f"WITH {_UPDATES_SQL} SELECT p.page_id, CASE WHEN a.page_id IS NOT NULL AND ((confidence >= 0.5 AND p1 > 0 AND p.state IN ('draft', 'stale', 'contradicted')) OR (p.state = 'stale' AND confidence >= 0.5) OR (p.state = 'contradicted' AND confidence >= 0.7)) "
    "THEN 'active' ELSE p.state END AS state, p.version + CASE WHEN a.page_id IS NULL THEN 0 ELSE 1 END AS version, coalesce(confidence, 0.0) AS confidence FROM p LEFT JOIN (SELECT * FROM a WHERE accepted) a USING (page_id)"
)
def page_updates(spark: SparkSession, d: str) -> DataFrame:
    return _page_updates(spark, d)[0].select("page_id", "state", "version", "confidence")


_WRITES_SQL = "SELECT doc_id // 3 AS page_id, count(*) AS writers, bool_or(2 > doc_id % 4) AS conflict, {0} AS write_id FROM documents GROUP BY 1"


@query(
    f"SELECT *, 'last_writer_wins' AS strategy FROM ({_WRITES_SQL.format('max(doc_id)')}) UNION ALL SELECT *, 'abort' FROM ({_WRITES_SQL.format('min(doc_id) FILTER (WHERE doc_id % 4 >= 2)')})"
)
def resolve_writes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    writes = docs.selectExpr("doc_id div 3 AS page_id", "doc_id AS write_id", "doc_id % 4 AS base_version")
    base = writes.select("page_id").distinct().withColumn("version", F.lit(2).cast("long"))
    both = [knowledge.resolve_writes(base, writes, "page_id", s).withColumn("strategy", F.lit(s)) for s in ("last_writer_wins", "abort")]
    return both[0].unionByName(both[1])


@query(
    f"WITH n AS (SELECT dst AS node, count(*) AS mentions FROM {_EDGES_SQL} GROUP BY 1 ORDER BY mentions DESC, node LIMIT 500), e AS (SELECT * FROM {_EDGES_SQL} ORDER BY src, dst LIMIT 1000) "
    "SELECT md5('<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">' || chr(10) || '  <graph id=\"KnowledgeGraph\" edgedefault=\"directed\">' || chr(10) || "
    "(SELECT string_agg('    <node id=\"' || node || '\">' || chr(10) || '      <data key=\"mentions\">' || mentions || '</data>' || chr(10) || '    </node>' || chr(10), '' ORDER BY mentions DESC, node) FROM n) || "
    "(SELECT string_agg('    <edge source=\"' || src || '\" target=\"' || dst || '\">' || chr(10) || '    </edge>' || chr(10), '' ORDER BY src, dst) FROM e) || '  </graph>' || chr(10) || '</graphml>') AS graph"
)
def kg_export_graphml(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    nodes = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("mentions"))
    return knowledge.graph_xml(nodes, edges).select(F.md5("graph").alias("graph"))


@query(
    "WITH s AS (SELECT user_id, max(ts) AS updated, count(*) AS sources, max_by(event_type, event_id) AS last_query FROM events GROUP BY 1), m AS (SELECT *, epoch(TIMESTAMP '2024-02-01' - updated) AS sec FROM s), "
    "t AS (SELECT *, floor(sec / 60 + 0.5) AS mi, floor(sec / 3600 + 0.5) AS ho FROM m), a AS (SELECT *, CASE WHEN mi < 60 THEN mi WHEN ho < 24 THEN ho ELSE floor(ho / 24 + 0.5) END AS n, CASE WHEN mi < 60 THEN 'minute' WHEN ho < 24 THEN 'hour' ELSE 'day' END AS unit FROM t) "
    "SELECT user_id, 'Welcome back. Last time you were researching: ' || last_query || '. ' || CAST(n AS BIGINT) || ' ' || unit || CASE WHEN n <> 1 THEN 's' ELSE '' END || ' ago. Topics explored: ' || last_query || '. ' || sources || ' sources consulted. Here''s where we left off...' AS said FROM a"
)
def resumption_texts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.count(F.lit(1)).alias("sources"), F.max_by("event_type", "event_id").alias("last_query"))
    said = reports.resumption(F.lit(""), F.col("last_query"), F.col("updated"), F.array("last_query"), F.col("sources"), F.lit("2024-02-01").cast("timestamp"))
    return s.select("user_id", said.alias("said"))

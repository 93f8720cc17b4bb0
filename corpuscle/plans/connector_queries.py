"""Queries over recorded answers of search services; the answers are written from ``documents``, ten items each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import connectors
from ..sources.tables import table
from .registry import query

#: An item of each service as the service writes it (Spark SQL over a document), and the results it stands for (DuckDB SQL).
#: Every seventh document has no year or date, every fifth no link, every third no authors.
_YEAR = "CASE WHEN doc_id % 7 <> 0 THEN 2000 + CAST(doc_id % 20 AS INT) END"
_LINK = "CASE WHEN doc_id % 5 <> 0 THEN 'https://' || source || '.example.org/' || doc_id END"
_HEAD = "substring(text, 1, 40)"
_NAMED = "CASE WHEN doc_id % 3 <> 0 THEN array(named_struct('name', source), named_struct('name', ''), named_struct('name', lang)) END"
_NAMES = "CASE WHEN doc_id % 3 <> 0 THEN source || '|' || lang ELSE '' END"
_DAY = "'2024-01-0' || (1 + doc_id % 9) || 'T00:00:00Z'"
ITEMS = {
    "semantic_scholar": (
        f"named_struct('paperId', 'p' || doc_id, 'title', {_HEAD}, 'url', {_LINK}, 'year', {_YEAR}, 'citationCount', n_chars, 'isOpenAccess', doc_id % 2 = 0, 'authors', {_NAMED}, 'externalIds', named_struct('DOI', '10.1/' || doc_id))",
        f"{_HEAD} AS title, coalesce({_LINK}, 'https://semanticscholar.org/paper/p' || doc_id) AS url, 'Cited ' || n_chars || ' times. ' || CASE WHEN doc_id % 2 = 0 THEN 'Open access available.' ELSE '' END AS snippet, "
        f"CAST({_YEAR} AS VARCHAR) AS published_date, {_NAMES} AS authors, n_chars AS citation_count, doc_id % 2 = 0 AS open_access, '10.1/' || doc_id AS doi",
    ),
    "crossref": (
        f"named_struct('DOI', CASE WHEN doc_id % 5 <> 0 THEN '10.1/' || doc_id END, 'URL', 'https://x.org/' || doc_id, 'title', array({_HEAD}, 'other'), 'abstract', CASE WHEN doc_id % 2 = 0 THEN text END, "
        f"'author', CASE WHEN doc_id % 3 <> 0 THEN array(named_struct('given', source, 'family', lang), named_struct('given', '', 'family', '')) END, 'published-print', named_struct('date-parts', array(array({_YEAR}))), "
        "'license', array(named_struct('content-version', CASE WHEN doc_id % 4 = 0 THEN 'vor' ELSE 'am' END)), 'is-referenced-by-count', n_chars)",
        f"{_HEAD} AS title, CASE WHEN doc_id % 5 <> 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'https://x.org/' || doc_id END AS url, "
        "CASE WHEN doc_id % 2 = 0 AND text <> '' THEN substring(text, 1, 300) WHEN doc_id % 5 <> 0 THEN 'DOI: 10.1/' || doc_id ELSE 'DOI: ' END AS snippet, "
        f"CAST({_YEAR} AS VARCHAR) AS published_date, CASE WHEN doc_id % 3 <> 0 THEN source || ' ' || lang ELSE '' END AS authors, n_chars AS citation_count, doc_id % 4 = 0 AS open_access, "
        "CASE WHEN doc_id % 5 <> 0 THEN '10.1/' || doc_id ELSE '' END AS doi",
    ),
    "openalex": (
        f"named_struct('title', {_HEAD}, 'doi', '10.1/' || doc_id, 'publication_year', {_YEAR}, 'cited_by_count', n_chars, 'open_access', named_struct('is_oa', doc_id % 2 = 0), 'primary_location', named_struct('landing_page_url', {_LINK}), "
        "'authorships', array(named_struct('author', named_struct('display_name', source)), named_struct('author', named_struct('display_name', ''))))",
        f"{_HEAD} AS title, coalesce({_LINK}, 'https://doi.org/10.1/' || doc_id) AS url, 'Cited ' || n_chars || ' times. ' || CASE WHEN doc_id % 2 = 0 THEN 'Open access.' ELSE '' END AS snippet, "
        f"CAST({_YEAR} AS VARCHAR) AS published_date, source AS authors, n_chars AS citation_count, doc_id % 2 = 0 AS open_access, '10.1/' || doc_id AS doi",
    ),
    "doaj": (
        f"named_struct('bibjson', named_struct('title', {_HEAD}, 'link', array(named_struct('url', {_LINK})), 'abstract', text, 'year', CAST({_YEAR} AS STRING), 'author', {_NAMED}, 'doi', '10.1/' || doc_id))",
        f"{_HEAD} AS title, coalesce({_LINK}, '') AS url, substring(text, 1, 300) AS snippet, CAST({_YEAR} AS VARCHAR) AS published_date, {_NAMES} AS authors, CAST(NULL AS BIGINT) AS citation_count, TRUE AS open_access, '10.1/' || doc_id AS doi",
    ),
    "clinical_trials": (
        f"named_struct('protocolSection', named_struct('identificationModule', named_struct('nctId', 'NCT' || doc_id, 'briefTitle', {_HEAD}), 'statusModule', named_struct('overallStatus', lang, 'startDateStruct', named_struct('date', CAST({_YEAR} AS STRING))), "
        "'designModule', named_struct('phases', CASE WHEN doc_id % 3 = 0 THEN array('PHASE1', 'PHASE2') WHEN doc_id % 3 = 1 THEN array('PHASE3') END)))",
        f"{_HEAD} AS title, 'https://clinicaltrials.gov/study/NCT' || doc_id AS url, 'Status: ' || lang || '. Phase: ' || CASE doc_id % 3 WHEN 0 THEN 'PHASE1, PHASE2' WHEN 1 THEN 'PHASE3' ELSE 'N/A' END || '. NCT: NCT' || doc_id AS snippet, "
        f"CAST({_YEAR} AS VARCHAR) AS published_date, '' AS authors, CAST(NULL AS BIGINT) AS citation_count, CAST(NULL AS BOOLEAN) AS open_access, CAST(NULL AS VARCHAR) AS doi",
    ),
}
_PLAIN = "'' AS authors, CAST(NULL AS BIGINT) AS citation_count, CAST(NULL AS BOOLEAN) AS open_access, CAST(NULL AS VARCHAR) AS doi"
ITEMS |= {
    "wikidata": (
        f"named_struct('id', 'Q' || doc_id, 'label', {_HEAD}, 'description', CASE WHEN doc_id % 5 <> 0 THEN lang END)",
        f"{_HEAD} AS title, 'https://www.wikidata.org/wiki/Q' || doc_id AS url, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE '' END AS snippet, CAST(NULL AS VARCHAR) AS published_date, {_PLAIN}",
    ),
    "github": (
        f"named_struct('full_name', {_HEAD}, 'html_url', {_LINK}, 'stargazers_count', n_chars, 'language', lang, 'description', text, 'created_at', {_DAY})",
        f"{_HEAD} AS title, coalesce({_LINK}, '') AS url, '⭐ ' || n_chars || ' | ' || lang || ' | ' || substring(text, 1, 200) AS snippet, substring({_DAY}, 1, 10) AS published_date, {_PLAIN}",
    ),
    "stackoverflow": (
        f"named_struct('title', {_HEAD}, 'link', {_LINK}, 'score', doc_id % 9, 'answer_count', CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 END, 'body', '<p>' || lang || '</p><code a=\"1\">' || text || '</code>')",
        f"{_HEAD} AS title, coalesce({_LINK}, '') AS url, 'Score: ' || (doc_id % 9) || ' | Answers: ' || (doc_id % 4) || ' | ' || substring(lang || regexp_replace(text, '<[^>]+>', '', 'g'), 1, 300) AS snippet, CAST(NULL AS VARCHAR) AS published_date, {_PLAIN}",
    ),
    "hackernews": (
        f"named_struct('title', {_HEAD}, 'url', {_LINK}, 'objectID', CAST(doc_id AS STRING), 'points', CASE WHEN doc_id % 4 <> 0 THEN n_chars END, 'num_comments', doc_id % 9, 'created_at', {_DAY})",
        f"{_HEAD} AS title, coalesce({_LINK}, 'https://news.ycombinator.com/item?id=' || doc_id) AS url, 'Points: ' || CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END || ' | Comments: ' || (doc_id % 9) AS snippet, substring({_DAY}, 1, 10) AS published_date, {_PLAIN}",
    ),
    "brave": (
        f"named_struct('title', {_HEAD}, 'url', {_LINK}, 'description', text, 'age', CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 7) || ' days ago' END)",
        f"{_HEAD} AS title, coalesce({_LINK}, '') AS url, text AS snippet, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 7) || ' days ago' ELSE '' END AS published_date, {_PLAIN}",
    ),
    "tavily": (
        f"named_struct('title', {_HEAD}, 'url', {_LINK}, 'content', text, 'published_date', CAST({_YEAR} AS STRING))",
        f"{_HEAD} AS title, coalesce({_LINK}, '') AS url, substring(text, 1, 500) AS snippet, coalesce(CAST({_YEAR} AS VARCHAR), '') AS published_date, {_PLAIN}",
    ),
    "newsapi": (
        f"named_struct('title', CASE WHEN doc_id % 5 <> 0 THEN {_HEAD} ELSE '' END, 'url', {_LINK}, 'description', CASE WHEN doc_id % 2 = 0 THEN lang END, 'content', text, 'publishedAt', {_DAY}, 'author', CASE WHEN doc_id % 3 <> 0 THEN source END)",
        f"CASE WHEN doc_id % 5 <> 0 AND text <> '' THEN {_HEAD} ELSE 'Untitled' END AS title, coalesce({_LINK}, '') AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE substring(text, 1, 300) END AS snippet, "
        f"substring({_DAY}, 1, 10) AS published_date, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS authors, CAST(NULL AS BIGINT) AS citation_count, CAST(NULL AS BOOLEAN) AS open_access, CAST(NULL AS VARCHAR) AS doi",
    ),
    "core": (
        f"named_struct('title', {_HEAD}, 'doi', '10.1/' || doc_id, 'downloadUrl', {_LINK}, 'sourceFulltextUrls', CASE WHEN doc_id % 10 = 0 THEN array('https://full.org/' || doc_id) END, 'authors', {_NAMED}, 'abstract', text, 'yearPublished', {_YEAR})",
        f"{_HEAD} AS title, coalesce({_LINK}, CASE WHEN doc_id % 10 = 0 THEN 'https://full.org/' ELSE 'https://doi.org/10.1/' END || doc_id) AS url, substring(text, 1, 300) AS snippet, CAST({_YEAR} AS VARCHAR) AS published_date, "
        f"{_NAMES} AS authors, CAST(NULL AS BIGINT) AS citation_count, TRUE AS open_access, '10.1/' || doc_id AS doi",
    ),
}
_FROM = "(SELECT *, 'q' || (doc_id // 10) AS query, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS position FROM documents)"


def recorded(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Answers of one service: ten documents each, as the items of its JSON, and one broken body."""
    item = F.expr(f"struct(doc_id, {ITEMS[name][0]} AS item)")
    answers = table(spark, d, "documents").groupBy(F.concat(F.lit("q"), F.floor(F.col("doc_id") / 10)).alias("query")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.transform("items", lambda x: x["item"])
    for step in reversed(connectors.CONNECTORS[name].path.split(".")):
        body = F.struct(body.alias(step))
    answers = answers.select(F.lit(name).alias("source_name"), "query", F.to_json(body).alias("body"))
    return answers.union(spark.createDataFrame([(name, "broken", "<html>503</html>"), (name, "none", None)], answers.schema))


def _register(name: str) -> None:
    connector = connectors.CONNECTORS[name]
    sql = f"SELECT query, position, '{connector.category}' AS source_category, '{connector.tier}' AS source_tier, {ITEMS[name][1]} FROM {_FROM}"

    def results(spark: SparkSession, d: str) -> DataFrame:
        found = connectors.results_of(recorded(spark, d, name), name)
        return found.withColumn("authors", F.array_join("authors", "|")).drop("source_name")

    results.__name__ = f"connector_{name}"
    query(sql)(results)


for _name in ITEMS:
    _register(_name)


_TITLES = {n: s.split(" AS title")[0] for n, (_, s) in ITEMS.items()}


@query(
    " UNION ALL ".join(
        f"SELECT query, '{n}' AS source_name, count(*) AS results, min(t) AS least_title FROM (SELECT query, {_TITLES[n]} AS t FROM {_FROM}) GROUP BY query" for n in ("github", "brave", "doaj")
    )
)
def search_all_sources(spark: SparkSession, d: str) -> DataFrame:
    names = ["github", "brave", "doaj"]
    answers = recorded(spark, d, names[0]).union(recorded(spark, d, names[1])).union(recorded(spark, d, names[2]))
    grouped = connectors.by_source(connectors.search_results(answers, names))
    return grouped.select("query", "source_name", F.size("results").cast("long").alias("results"), F.array_min(F.transform("results", lambda r: r["title"])).alias("least_title"))

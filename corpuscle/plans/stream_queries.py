"""Queries that run as streams over files of ``events`` and ``documents``, and recorded answers of paper archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import papers
from ..sources.tables import shared_folder, table
from ..streaming import stores, windows
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, rows: DataFrame, batches: int, base: str) -> DataFrame:
    """``rows`` written to files that a stream takes in so many batches; a batch has several files, so that no task reads it alone."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(batches * tasks).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(f"{base}/in")


@query(
    "SELECT event_type AS type, 'user ' || user_id AS name, count(*) AS mentions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, "
    "arg_max(props, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS context FROM events GROUP BY 1, 2"
)
def entity_store_stream(spark: SparkSession, d: str) -> DataFrame:
    """Entities kept by a stream of four batches in no order of time."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), "event_id", F.col("ts").cast("timestamp").alias("seen_at"), F.lit(1).cast("long").alias("mentions"), F.col("props").alias("context")
    )
    base = _folder(spark)
    with stores.keyed_state(spark):
        stores.run_available(stores.entity_updates(_streamed(spark, rows, 4, base)), f"{base}/out", f"{base}/state", "update")
    found = stores.last_of_each(spark.read.parquet(f"{base}/out"), ["type", "name"])
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


_CACHE_SQL = """
WITH e AS (SELECT 'q' || (user_id % 40) AS key, event_id, event_type IN ('signup', 'error') AS put, ts FROM events),
r AS (SELECT *, max(CASE WHEN put THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(event_id::VARCHAR, 12, '0') END) OVER (PARTITION BY key ORDER BY ts, event_id) AS mark FROM e),
h AS (SELECT r.*, p.ts AS put_at, p.event_id AS put_id, coalesce(epoch_us(r.ts) - epoch_us(p.ts) < 6 * 3600 * 1000000::BIGINT, false) AS hit FROM r LEFT JOIN e p ON p.put AND p.event_id = right(mark, 12)::BIGINT WHERE NOT r.put)
SELECT key, event_id, hit, CASE WHEN hit THEN 'answer ' || put_id END AS answer, CASE WHEN hit THEN count(*) FILTER (hit) OVER (PARTITION BY key, put_id ORDER BY ts, event_id) ELSE 0 END AS hits FROM h
"""


@query(_CACHE_SQL)
def answer_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers cached for six hours: signups and errors put them, other events ask."""
    put = F.col("event_type").isin("signup", "error")
    rows = table(spark, d, "events").select(
        F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("key"), "event_id", F.when(put, "put").otherwise("get").alias("kind"), F.col("ts").cast("timestamp").alias("at"),
        F.when(put, F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("answer"),
    )
    base = _folder(spark)
    with stores.keyed_state(spark):
        stores.run_available(stores.cache_answers(_streamed(spark, rows, 1, base), 6 * 3600), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").drop("batch_no", "part")


@query(
    "WITH g AS (SELECT user_id, ts, value, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events, round(sum(value), 3) AS total FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed when the stream has taken all events."""
    base = _folder(spark)
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    with stores.keyed_state(spark):  # open sessions lie on disk
        stores.run_available(windows.session_totals(_streamed(spark, rows, 1, base), "6 hours", "1 hour"), f"{base}/out", f"{base}/state")
    found = spark.read.parquet(f"{base}/out")
    return found.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events", F.round("total", 3).alias("total"))


_PLAIN = "trim(regexp_replace({0}, '[^a-zA-Z0-9&<>.]+', ' '{1}))"


@query(
    f"SELECT 'http://arxiv.org/abs/' || doc_id AS source_url, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE 'Paper ' || doc_id END AS title, source || CASE WHEN doc_id % 2 = 0 THEN ',' || lang ELSE '' END AS authors, {_PLAIN.format('text', ', $$g$$')} AS abstract, "
    "CASE WHEN doc_id % 7 > 0 THEN '2021-03-0' || (1 + doc_id % 9) END AS published_date, 'cs.' || upper(lang) AS categories, CASE WHEN doc_id % 3 = 0 THEN 'http://arxiv.org/pdf/' || doc_id ELSE '' END AS pdf_url, FALSE AS malformed FROM documents".replace("$$g$$", "'g'")
)
def atom_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an entry of Atom files, read back."""
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    entry = docs.select(
        F.concat(F.lit("http://arxiv.org/abs/"), n.cast("string")).alias("id"),
        F.when(n % 5 > 0, F.concat(F.lit("Paper\n"), n.cast("string"))).alias("title"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.when(n % 2 == 0, F.col("lang")).alias("name"))).alias("author"),
        F.expr(_PLAIN.format("text", "")).alias("summary"),
        F.when(n % 7 > 0, F.concat(F.lit("2021-03-0"), (1 + n % 9).cast("string"), F.lit("T00:00:00Z"))).otherwise("soon").alias("published"),
        F.array(F.struct(F.concat(F.lit("cs."), F.upper("lang")).alias("_term"), none.alias("_VALUE"))).alias("category"),
        F.array(F.struct(F.lit("doi").alias("_title"), F.lit("x").alias("_href"), none.alias("_VALUE")), F.struct(F.when(n % 3 == 0, "pdf").otherwise("html").alias("_title"), F.concat(F.lit("http://arxiv.org/pdf/"), n.cast("string")).alias("_href"), none.alias("_VALUE"))).alias("link"),
    )
    base = _folder(spark)
    entry.write.format("xml").options(rootTag="feed xmlns='http://www.w3.org/2005/Atom'", rowTag="entry").save(f"{base}/atom")
    found = papers.read_atom(spark, f"{base}/atom")
    return found.withColumns({"authors": F.array_join("authors", ","), "categories": F.array_join("categories", ","), "published_date": F.col("published_date").cast("string")})


_ABSTRACT = "regexp_replace({0}, '[^a-zA-Z0-9 .]+', ' '{1})"


@query(
    f"SELECT CAST(doc_id AS VARCHAR) AS pmid, 'Title ' || doc_id || chr(10) || trim({_ABSTRACT.format('text', ', $$g$$')}) AS abstract FROM documents WHERE trim({_ABSTRACT.format('text', ', $$g$$')}) <> '' UNION ALL "
    f"SELECT CAST(doc_id AS VARCHAR), 'Title ' || doc_id FROM documents WHERE trim({_ABSTRACT.format('text', ', $$g$$')}) = ''".replace("$$g$$", "'g'")
)
def pubmed_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a record of plain-text files, read back."""
    n = F.col("doc_id").cast("string")
    body = F.expr(_ABSTRACT.format("text", ""))
    record = F.concat(F.lit("PMID: "), n, F.lit("  [indexed]\n\n  Title "), n, F.lit("\nDOI: 10.1/x\n"), body, F.lit("\n"))
    base = _folder(spark)
    table(spark, d, "documents").select(record.alias("value")).write.text(f"{base}/abstracts")
    return papers.read_abstracts(spark, f"{base}/abstracts")



@query(
    "SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE 'On ' || source END AS title, source || ',' || lang AS authors, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS source_url, "
    "['2023-12-15', '2023-12-01', '2023-01-01', NULL, NULL][1 + doc_id % 5] AS published_date, 'Journal of ' || lang AS journal, CASE WHEN doc_id % 2 = 0 THEN 'doi: ' || doc_id ELSE '' END AS doi FROM documents WHERE doc_id % 13 > 0"
)
def pubmed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all documents in answers of up to a hundred; every thirteenth is an error."""
    n = F.col("doc_id").cast("string")
    dates = F.get(F.array(*[F.lit(x) for x in ("2023 Dec 15", "2023 Dec", "2023", "Winter 2023", "")]), (F.col("doc_id") % 5).cast("int"))
    names = F.array(*[F.struct(c.alias("name")) for c in (F.col("source"), F.col("lang"), F.lit(""))])
    article = F.struct(
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("On "), "source")).alias("title"), names.alias("authors"), dates.alias("pubdate"), F.concat(F.lit("Journal of "), "lang").alias("fulljournalname"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doi: "), n)).alias("elocationid"), F.when(F.col("doc_id") % 13 == 0, "not found").alias("error"),
    )
    docs = table(spark, d, "documents").select((F.col("doc_id") / 100).cast("long").alias("answer"), n.alias("pmid"), article.alias("article"))
    grouped = docs.groupBy("answer").agg(F.map_from_entries(F.collect_list(F.struct("pmid", F.to_json("article").alias("article")))).alias("m"))
    body = F.concat(F.lit('{"result": {"uids": [], '), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}}"))
    found = papers.article_summaries(grouped.select(body.alias("body")))
    return found.withColumns({"authors": F.array_join("authors", ","), "published_date": F.col("published_date").cast("string")})

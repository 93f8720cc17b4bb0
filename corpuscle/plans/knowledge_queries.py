"""Queries of the knowledge layer, its logs, and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as k
from ..sources import tables
from ..sources.tables import table
from .registry import query

AS_OF = "2024-02-01 00:00:00"
_STATE = "CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'active' WHEN 'click' THEN 'active' WHEN 'error' THEN 'contradicted' ELSE 'stale' END"
_PAGES_SQL = (
    f"(SELECT user_id AS page_id, arg_max({_STATE}, event_id) AS state, max(ts) AS last_verified, min(ts) AS updated_at, count(*) AS access_count, count(*) % 7 AS version FROM events GROUP BY user_id)"
)


def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("page_id")).agg(
        F.max_by(F.expr(_STATE), "event_id").alias("state"), F.max("ts").alias("last_verified"), F.min("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("access_count"), (F.count(F.lit(1)) % 7).alias("version"),
    )


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    f"SELECT page_id, new_state, access_count FROM (SELECT *, CASE WHEN state = 'active' AND epoch(TIMESTAMP '{AS_OF}' - last_verified) > 20 * 3600 THEN 'stale' "
    f"WHEN state IN ('stale', 'contradicted') AND epoch(TIMESTAMP '{AS_OF}' - updated_at) > 29 * 86400 THEN 'archived' ELSE state END AS new_state FROM {_PAGES_SQL})"
)
def auto_transition(spark: SparkSession, d: str) -> DataFrame:
    return k.auto_transition(wiki_pages(spark, d), _as_of(), 20, 29).select("page_id", "new_state", "access_count")


_ALLOWED = " OR ".join(f"(state = '{a}' AND to_state IN ({', '.join(repr(b) for b in to.split())}))" for a, to in k.TRANSITIONS["wide"].items())
_ALLOWED_NARROW = " OR ".join(f"(state = '{a}' AND to_state IN ({', '.join(repr(b) for b in to.split())}))" for a, to in k.TRANSITIONS["narrow"].items() if to)
_TO = "(['active', 'archived', 'draft', 'stale'])[1 + page_id % 4]"


def _moves_sql(allowed: str) -> str:
    return (
        f"SELECT page_id, state AS from_state, to_state, {allowed} AS accepted, version + CAST({allowed} AS BIGINT) AS version FROM (SELECT *, {_TO} AS to_state FROM {_PAGES_SQL})"
    )


def _requests(pages: DataFrame) -> DataFrame:
    states = F.array(*map(F.lit, ["active", "archived", "draft", "stale"]))
    return pages.select("page_id", F.get(states, (F.col("page_id") % 4).cast("int")).alias("to_state"))


@query(_moves_sql(f"({_ALLOWED})"))
def lifecycle_transitions(spark: SparkSession, d: str) -> DataFrame:
    pages = wiki_pages(spark, d)
    return k.apply_transitions(_requests(pages), pages)


@query(_moves_sql(f"({_ALLOWED_NARROW})"))
def lifecycle_transitions_narrow(spark: SparkSession, d: str) -> DataFrame:
    pages = wiki_pages(spark, d)
    return k.apply_transitions(_requests(pages), pages, "narrow")


@query(
    f"SELECT page_id, epoch(TIMESTAMP '{AS_OF}' - last_verified) / 3600.0 > 168 * CASE WHEN access_count > 100 THEN 0.5 WHEN access_count > 10 THEN 0.75 ELSE 1.0 END AS reverify FROM {_PAGES_SQL}"
)
def reverify(spark: SparkSession, d: str) -> DataFrame:
    return wiki_pages(spark, d).select("page_id", k.should_reverify(F.col("last_verified"), F.col("access_count"), _as_of()).alias("reverify"))


@query(
    f"SELECT count(*) AS pages, {', '.join(f'count(*) FILTER (WHERE state = {s!r}) AS {s}' for s in k.TRANSITIONS['wide'])}, count(*) FILTER (WHERE state = 'active') * 500 AS saved_ms FROM {_PAGES_SQL}"
)
def wiki_stats(spark: SparkSession, d: str) -> DataFrame:
    return k.state_counts(wiki_pages(spark, d))


@query(
    f"SELECT page_id, coalesce(changed, 0) AS changed, coalesce(changed, 0) > 0 OR epoch(TIMESTAMP '{AS_OF}' - last_verified) / 3600.0 >= 168 AS is_stale FROM {_PAGES_SQL} p LEFT JOIN "
    "(SELECT user_id, count(*) FILTER (WHERE event_id % 97 = 0) AS changed FROM events GROUP BY user_id) c ON p.page_id = c.user_id"
)
def page_freshness(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    url = F.col("event_id").cast("string").alias("url")
    sources = events.select(F.col("user_id").alias("page_id"), url, F.lit("a").alias("hash"))
    current = events.select(url, F.when(F.col("event_id") % 97 == 0, "b").otherwise("a").alias("hash"))
    return k.freshness(wiki_pages(spark, d), sources, current, _as_of())


_MARKED = "text || ' [[tech:Vector Store]] and [[Person: Ada]] see [[page-' || (doc_id % 9) || ']] [[tech:Vector Store]] [[page-' || (doc_id % 9) || ']] [[overview]] [[Page One]] [[x]] [[ieee-iPhone]] [[a_b--c9]] [[-bad-]] [[OVERVIEW]] [[Page-' || (doc_id % 9) || ']]'"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("doc_id") % 9).cast("string")
    mark = F.concat(F.col("text"), F.lit(" [[tech:Vector Store]] and [[Person: Ada]] see [[page-"), n, F.lit("]] [[tech:Vector Store]] [[page-"), n, F.lit("]] [[overview]] [[Page One]] [[x]] [[ieee-iPhone]] [[a_b--c9]] [[-bad-]] [[OVERVIEW]] [[Page-"), n, F.lit("]]"))
    return table(spark, d, "documents").select("doc_id", mark.alias("text"))


@query(
    "SELECT doc_id, lower(t) AS type, trim(n) AS name, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(t0, '(?i)\\[\\[(person|org|tech|concept|location|event):([^\\]]+)\\]\\]', 1)) AS t, "
    f"unnest(regexp_extract_all(t0, '(?i)\\[\\[(person|org|tech|concept|location|event):([^\\]]+)\\]\\]', 2)) AS n FROM (SELECT doc_id, {_MARKED} AS t0 FROM documents)) GROUP BY 1, 2, 3"
)
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    return k.entities(_marked(spark, d), "doc_id")


_LINKS_SQL = (
    "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS link_no, slug FROM (SELECT doc_id, unnest(l) AS slug, unnest(range(len(l))) AS i FROM "
    f"(SELECT doc_id, regexp_extract_all(t0, '(?i)\\[\\[([a-z0-9][\\w-]*[a-z0-9])\\]\\]', 1) AS l FROM (SELECT doc_id, {_MARKED} AS t0 FROM documents))) GROUP BY doc_id, slug)"
)


@query(f"SELECT * FROM {_LINKS_SQL}")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return k.links(_marked(spark, d), "doc_id")


@query(
    f"SELECT DISTINCT slug, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, 'draft' AS state FROM {_LINKS_SQL} WHERE slug NOT IN (SELECT 'page-' || (doc_id % 9) FROM documents WHERE doc_id % 9 < 5)"
)
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").where("doc_id % 9 < 5").select(F.concat(F.lit("page-"), (F.col("doc_id") % 9).cast("string")).alias("slug")).distinct()  # four pages and the overview are missing
    return k.dangling_pages(k.links(_marked(spark, d), "doc_id"), known)


_EDGES_SQL = "(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _name(mark: str, column: str):
    return F.concat(F.lit(mark), F.col(column).cast("string"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(_name("n", "n_nationkey").alias("src"), _name("r", "n_regionkey").alias("dst"))
    b = table(spark, d, "customer").select(_name("c", "c_custkey").alias("src"), _name("n", "c_nationkey").alias("dst"))
    c = table(spark, d, "supplier").select(_name("s", "s_suppkey").alias("src"), _name("n", "s_nationkey").alias("dst"))
    return a.union(b).union(c)


_WALK = (
    f"WITH e AS (SELECT src AS a, dst AS b FROM {_EDGES_SQL} UNION SELECT dst, src FROM {_EDGES_SQL}), h1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 'r1'), "
    "h2 AS (SELECT DISTINCT e.b AS node FROM e JOIN h1 ON e.a = h1.node) "
)


@query(f"{_WALK} SELECT 'r1' AS node, 0::BIGINT AS distance UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 WHERE node <> 'r1' AND node NOT IN (SELECT node FROM h1)")
def kg_khop(spark: SparkSession, d: str) -> DataFrame:
    return k.neighbourhood(graph_edges(spark, d), spark.createDataFrame([("r1",)], "node string"), 2)


@query(f"{_WALK} SELECT DISTINCT src, dst FROM {_EDGES_SQL} WHERE src = 'r1' OR dst = 'r1' OR src IN (SELECT node FROM h1) OR dst IN (SELECT node FROM h1)")
def kg_subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    return k.subgraph_edges(edges, k.neighbourhood(edges, spark.createDataFrame([("r1",)], "node string"), 2), 2)


@query(
    "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), "
    "u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
    "walk(node, dist) AS (SELECT 'n0', 0::BIGINT UNION SELECT u.b, dist + 1 FROM walk JOIN u ON u.a = node WHERE dist < 8) SELECT min(dist) AS distance FROM walk WHERE node = 'n1'"
)
def kg_connect(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(_name("n", "n_nationkey").alias("src"), _name("r", "n_regionkey").alias("dst"))
    hub = table(spark, d, "region").select(_name("r", "r_regionkey").alias("src"), F.lit("world").alias("dst"))
    return k.shortest_distance(edges.union(hub), "n0", "n1")


@query(
    f"SELECT node, mentions, coalesce(degree, 0) AS degree FROM (SELECT 's' || l_suppkey AS node, count(*) AS mentions FROM lineitem GROUP BY 1) n LEFT JOIN (SELECT node, count(*) AS degree FROM "
    f"(SELECT src AS node FROM {_EDGES_SQL} UNION ALL SELECT dst FROM {_EDGES_SQL}) GROUP BY 1) g USING (node) WHERE mentions > 3 ORDER BY degree, mentions DESC, node LIMIT 10"
)
def kg_degree_sparse(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").groupBy(_name("s", "l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("mentions"))
    return k.sparse_entities(nodes, graph_edges(spark, d))


@query(
    f"WITH n AS (SELECT dst AS node, count(*) AS mentions FROM {_EDGES_SQL} GROUP BY 1 ORDER BY mentions DESC, node LIMIT 500), l AS (SELECT src, dst FROM {_EDGES_SQL} WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) ORDER BY src, dst LIMIT 1000) "
    """SELECT '{"nodes":[' || (SELECT string_agg('{"node":"' || node || '","mentions":' || mentions || '}', ',' ORDER BY node, mentions) FROM n) || '],"links":[' || """
    """(SELECT string_agg('{"src":"' || src || '","dst":"' || dst || '"}', ',' ORDER BY src, dst) FROM l) || ']}' AS graph"""
)
def kg_export_json(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d)
    nodes = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("mentions"))
    return k.graph_json(nodes, edges)


_CLAIM_STATUS = "CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'conflicted' ELSE 'unverified' END"


@query(
    f"SELECT l_suppkey AS page_id, count(*) AS claims, count(*) FILTER (WHERE s IN ('supported', 'resolved')) AS verified, count(*) FILTER (WHERE s = 'conflicted') AS conflicted, round(sum(c), 2) AS cost "
    f"FROM (SELECT l_suppkey, {_CLAIM_STATUS} AS s, l_quantity * 0.0001::DOUBLE * CASE l_linenumber WHEN 1 THEN 1.5 WHEN 2 THEN 1.2 ELSE 1.0 END AS c FROM lineitem) GROUP BY 1"
)
def provenance_audit(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("l_linenumber") == 1, "P1").when(F.col("l_linenumber") == 2, "P2").otherwise("P3")
    claims = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.expr(_CLAIM_STATUS).alias("status"), k.cost_to_produce(F.col("l_quantity"), tier).alias("cost"))
    return k.provenance_audit(claims)


@query("SELECT p_partkey AS claim_id, o AS other_id, p2 AS statement FROM (SELECT p_partkey, unnest([p_partkey - 1, p_partkey + 1]) AS o FROM part) JOIN (SELECT p_partkey AS k2, p_name AS p2 FROM part) ON o = k2")
def claim_lineage(spark: SparkSession, d: str) -> DataFrame:
    near = F.array(F.col("p_partkey") - 1, F.col("p_partkey") + 1)
    return k.claim_lineage(table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("statement"), near.alias("supports")))


@query("SELECT l_suppkey AS page_id, count(*) AS sources, count(*) FILTER (WHERE l_partkey % 50 = 0) AS retracted FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_partkey % 50 = 0) > 0")
def retraction_cascade(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_partkey").alias("url"))
    return k.retract(used, table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("url")))


_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(
    f"WITH e AS (SELECT unnest(list_distinct({_W})) AS word FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 < 2), n AS (SELECT word, count(*) AS matches FROM e GROUP BY 1), "
    f"m AS (SELECT item_id, list_filter({_W}, lambda w: length(w) > 4)[1] AS word FROM benchmark) SELECT item_id AS claim_id, coalesce(matches, 0) AS matches FROM m LEFT JOIN n USING (word) WHERE word IS NOT NULL"
)
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.quality import corpus_tier

    evidence = table(spark, d, "documents").select(F.col("text").alias("statement"), corpus_tier(F.col("source")).alias("tier"))
    return k.corroboration(table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("statement")), evidence)


@query(
    "SELECT topic, \"at\", kind, detail, row_number() OVER (PARTITION BY topic ORDER BY \"at\", kind, detail) AS step FROM (SELECT user_id AS topic, ts AS \"at\", 'detected' AS kind, 'e' || event_id AS detail FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT user_id, ts, 'state', event_type FROM events WHERE event_type IN ('signup', 'purchase') UNION ALL SELECT user_id, max(ts), 'resolved', 'last' FROM events GROUP BY user_id)"
)
def contradiction_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("topic"), F.col("ts").alias("at"), "event_type", "event_id")
    found = e.where("event_type = 'error'").select("topic", "at", F.lit("detected").alias("kind"), _name("e", "event_id").alias("detail"))
    states = e.where("event_type in ('signup', 'purchase')").select("topic", "at", F.lit("state").alias("kind"), F.col("event_type").alias("detail"))
    ends = e.groupBy("topic").agg(F.max("at").alias("at")).select("topic", "at", F.lit("resolved").alias("kind"), F.lit("last").alias("detail"))
    return k.timeline(found, states, ends)


@query()
def session_topics(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", k.topics(F.col("text")).alias("topics"))
    return first.select("conv_id", "turn", F.array_join("topics", "; ").alias("topics"))


@query(f"SELECT user_id, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR GROUP BY user_id")
def prune_sessions(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "events").where(k.hours_since(F.col("ts"), _as_of()) <= k.SESSION_HOURS)
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "SELECT resource, min(ts) AS acquired_at, count(*) AS contenders FROM (SELECT user_id % 40 AS resource, ts, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE event_id % 3 <> 0) "
    "WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND expires_at > TIMESTAMP '2024-01-15 00:00:00' GROUP BY resource"
)
def active_locks(spark: SparkSession, d: str) -> DataFrame:
    released = F.when(F.col("event_id") % 3 == 0, F.col("ts"))
    locks = table(spark, d, "events").select((F.col("user_id") % 40).alias("resource"), F.col("ts").alias("acquired_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), released.alias("released_at"))
    return k.active_locks(locks, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


#: With the even documents this covers every row.
_NEW = "doc_id IS NULL OR doc_id % 2 <> 0 OR doc_id % 3 = 0"


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN source ELSE 'new' END AS source, n_chars FROM documents")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return tables.upsert(docs.where("doc_id % 2 = 0"), docs.where(_NEW).withColumn("source", F.lit("new")), ["doc_id"], ["source"])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'new' END AS source FROM documents")
def seed_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return tables.insert_missing(docs.where("doc_id % 2 = 0"), docs.where(_NEW).withColumn("source", F.lit("new")), ["doc_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query(
    "SELECT coalesce(event_type, 'all') AS route, coalesce(CAST(day AS VARCHAR), 'all') AS day, count(*) AS queries, round(avg(value), 6) AS mean FROM (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events) GROUP BY ROLLUP (event_type, day)"
)
def query_log_rollup(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    made = log.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("value"), 6).alias("mean"))
    return made.select(F.coalesce("event_type", F.lit("all")).alias("route"), F.coalesce(F.col("day").cast("string"), F.lit("all")).alias("day"), "queries", "mean")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query(
    "SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM "
    "(SELECT user_id, ts, CAST(CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 43200 THEN 0 ELSE 1 END AS BIGINT) AS n FROM events)) GROUP BY user_id, session_no"
)
def sessionized_events(spark: SparkSession, d: str) -> DataFrame:
    return k.sessionize(table(spark, d, "events").select("user_id", "ts"), 720)

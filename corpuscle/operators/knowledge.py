"""The knowledge layer: page states, links, entities, graph, provenance, contradictions, sessions, locks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.tables import durable

# Allowed moves between page states (two variants), and words that name no topic.
TRANSITIONS = {
    "wide": {
        "draft": "active archived", "active": "stale contradicted archived", "stale": "active contradicted archived",
        "contradicted": "active stale archived", "archived": "draft",
    },
    "narrow": {"draft": "active archived", "active": "stale contradicted archived", "stale": "active archived", "contradicted": "active archived", "archived": ""},
}
TOPIC_STOP_WORDS = (
    "what how why when where who which is are the a an of in on at to for with by does do did can could would should will shall about between from into through during before "
    "after and or but not no nor so yet both either this that these those it its my your their"
).split()
STALE_HOURS, ARCHIVE_DAYS, SESSION_HOURS, LOCK_SECONDS = 168, 90, 72, 60
ENTITY = r"(?i)\[\[(person|org|tech|concept|location|event):([^\]]+)\]\]"


def transition_table(spark: SparkSession, variant: str = "wide") -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS[variant].items() for b in to.split()], "from_state string, to_state string")


def apply_transitions(requests: DataFrame, pages: DataFrame, variant: str = "wide") -> DataFrame:
    """(page_id, from_state, to_state, accepted, version) of requests (page_id, to_state) against pages (page_id, state, version)."""
    allowed = transition_table(requests.sparkSession, variant).withColumn("ok", F.lit(True))
    met = requests.join(pages.select("page_id", F.col("state").alias("from_state"), "version"), "page_id", "left")
    accepted = F.coalesce("ok", F.lit(False))
    return met.join(F.broadcast(allowed), ["from_state", "to_state"], "left").select(
        "page_id", "from_state", "to_state", accepted.alias("accepted"), (F.col("version") + accepted.cast("long")).alias("version")
    )


def hours_since(then: Column, as_of: Column) -> Column:
    return (as_of.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 3600.0


def auto_transition(pages: DataFrame, as_of: Column, stale_hours: int = STALE_HOURS, archive_days: int = ARCHIVE_DAYS) -> DataFrame:
    """``pages`` (state, last_verified, updated_at) with ``new_state``: old active pages become stale, long untouched ones archived."""
    age = hours_since(F.col("last_verified"), as_of)
    idle = hours_since(F.col("updated_at"), as_of)
    stale = (F.col("state") == "active") & (age > stale_hours)
    gone = F.col("state").isin("stale", "contradicted") & (idle > archive_days * 24)
    return pages.withColumn("new_state", F.when(stale, "stale").when(gone, "archived").otherwise(F.col("state")))


def should_reverify(last_verified: Column, access_count: Column, as_of: Column, most_hours: int = STALE_HOURS) -> Column:
    """Whether a page is older than its limit; often read pages have a shorter one; never verified pages always."""
    limit = F.lit(float(most_hours)) * F.when(access_count > 100, 0.5).when(access_count > 10, 0.75).otherwise(1.0)
    return F.coalesce(hours_since(last_verified, as_of) > limit, F.lit(True))


def freshness(pages: DataFrame, sources: DataFrame, current: DataFrame, as_of: Column, stale_hours: int = STALE_HOURS) -> DataFrame:
    """(page_id, changed, is_stale): a source whose hash has changed, or an age, makes a page stale.

    ``sources`` has page_id, url, hash; ``current`` has url, hash as they are now.
    """
    now = current.select("url", F.col("hash").alias("now"))
    changed = sources.join(now, "url", "left").groupBy("page_id").agg(F.count_if(F.col("now") != F.col("hash")).alias("changed"))
    age = F.coalesce(hours_since(F.col("last_verified"), as_of) >= stale_hours, F.lit(True))
    met = pages.join(changed, "page_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    return met.select("page_id", "changed", ((F.col("changed") > 0) | age).alias("is_stale"))


def state_counts(pages: DataFrame, saved_ms: int = 500) -> DataFrame:
    """One row: pages in all and by state, and the time that active pages are taken to save."""
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    states = [n(s).alias(s) for s in TRANSITIONS["wide"]]
    return pages.agg(F.count(F.lit(1)).alias("pages"), *states, (n("active") * saved_ms).alias("saved_ms"))


def entities(texts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, type, name, mentions) of ``[[type:name]]`` marks."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(1)).alias("type"), F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(2)).alias("name"))
    flat = texts.select(ident, F.explode(pairs).alias("e")).select(ident, F.lower(F.col("e.type")).alias("type"), F.trim(F.col("e.name")).alias("name"))
    return flat.groupBy(ident, "type", "name").agg(F.count(F.lit(1)).alias("mentions"))


def links(texts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, link_no, slug) of ``[[slug]]`` marks, each once, in order.

    A slug has two or more letters, digits, underscores or hyphens, in either case, and begins and ends with a letter or digit.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\[\[([a-z0-9][\w-]*[a-z0-9])\]\]"), F.lit(1)))
    return texts.select(ident, F.posexplode(found).alias("link_no", "slug")).select(ident, F.col("link_no").cast("long").alias("link_no"), "slug")


def dangling_pages(found: DataFrame, pages: DataFrame, slug: str = "slug") -> DataFrame:
    """(slug, title, state): draft pages for links that lead nowhere; a title's words begin with capitals and stay as they are behind them."""
    missing = found.select("slug").distinct().join(pages.select(F.col(slug).alias("slug")), "slug", "left_anti")
    return missing.select("slug", F.array_join(F.transform(F.split("slug", "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ").alias("title"), F.lit("draft").alias("state"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, each once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, distance): nodes within ``depth`` steps of the seeds (node), breadth first.

    Each step joins the frontier to the edges and drops what is known; steps are
    written to the shared folder, so lineage doesn't grow and a lost executor costs one step.
    """
    both = durable(undirected(edges))
    seen = durable(seeds.select("node").distinct().withColumn("distance", F.lit(0).cast("long")))
    frontier = seen
    for d in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = durable(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(d).cast("long")))
        seen = seen.union(frontier)
    return seen


def subgraph_edges(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Distinct edges that leave or reach a node nearer than ``depth``."""
    inner = nodes.where(F.col("distance") < depth).select("node")
    out = edges.join(inner, edges.src == inner.node, "left_semi").union(edges.join(inner, edges.dst == inner.node, "left_semi"))
    return out.distinct()


def shortest_distance(edges: DataFrame, start: str | int, goal: str | int, most: int = 4) -> DataFrame:
    """One row (distance): steps between two nodes, null beyond ``most``."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(start,)], f"node {edges.schema['src'].dataType.simpleString()}")
    found = neighbourhood(edges, seed, most)
    return found.where(F.col("node") == F.lit(goal)).agg(F.min("distance").alias("distance"))


def sparse_entities(nodes: DataFrame, edges: DataFrame, least_mentions: int = 3, k: int = 10) -> DataFrame:
    """The k entities (node, mentions, degree) that are mentioned more than ``least_mentions`` times and linked least."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    met = nodes.where(F.col("mentions") > least_mentions).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return met.orderBy("degree", F.col("mentions").desc(), "node").limit(k)


def graph_json(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 1000) -> DataFrame:
    """One row (graph) of JSON with the most mentioned nodes and edges between them; a report with set limits."""
    top = nodes.orderBy(F.col("mentions").desc(), "node").limit(most_nodes)
    within = edges.join(top.select(F.col("node").alias("src")), "src", "left_semi").join(top.select(F.col("node").alias("dst")), "dst", "left_semi").orderBy("src", "dst").limit(most_edges)
    a = top.agg(F.sort_array(F.collect_list(F.struct("node", "mentions"))).alias("nodes"))
    b = within.agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("links"))
    return a.crossJoin(b).select(F.to_json(F.struct("nodes", "links")).alias("graph"))


def provenance_audit(claims: DataFrame, by: str = "page_id") -> DataFrame:
    """(by, claims, verified, conflicted, cost) of claims with status and cost."""
    return claims.groupBy(by).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("status").isin("supported", "resolved")).alias("verified"),
        F.count_if(F.col("status") == "conflicted").alias("conflicted"),
        F.round(F.sum("cost"), 2).alias("cost"),
    )


def cost_to_produce(latency_ms: Column, tier: Column) -> Column:
    return latency_ms * 1e-4 * F.when(tier == "P1", 1.5).when(tier == "P2", 1.2).otherwise(1.0)


def claim_lineage(claims: DataFrame, supports: str = "supports") -> DataFrame:
    """(claim_id, other_id, statement): the claims that an array of ids names."""
    named = claims.select("claim_id", F.explode(supports).alias("other_id"))
    return named.join(claims.select(F.col("claim_id").alias("other_id"), "statement"), "other_id").select("claim_id", "other_id", "statement")


def retract(provenance: DataFrame, retracted: DataFrame) -> DataFrame:
    """(page_id, sources, retracted): pages that rest on a retracted url; they turn contradicted."""
    marked = provenance.join(retracted.select("url").distinct().withColumn("__r", F.lit(1)), "url", "left")
    return marked.groupBy("page_id").agg(F.count(F.lit(1)).alias("sources"), F.count("__r").alias("retracted")).where("retracted > 0")


def timeline(*events: DataFrame) -> DataFrame:
    """Events (topic, at, kind, detail) of several logs with their place in each topic's time line."""
    every = reduce(DataFrame.unionByName, events)
    return every.withColumn("step", F.row_number().over(Window.partitionBy("topic").orderBy("at", "kind", "detail")).cast("long"))


def topics(query: Column, most: int = 5) -> Column:
    """A short query itself, then pairs of meaningful words, then words that none of these holds."""
    text = F.lower(query)
    meaningful = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*TOPIC_STOP_WORDS))
    whole = F.when(F.length(query) <= 60, F.array(F.trim(query))).otherwise(F.array().cast("array<string>"))
    pairs = F.when(F.size(meaningful) > 1, F.zip_with(F.slice(meaningful, F.lit(1), F.size(meaningful) - 1), F.slice(meaningful, F.lit(2), F.size(meaningful) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    start = F.concat(whole, F.coalesce(pairs, F.array().cast("array<string>")))
    extra = F.aggregate(meaningful, start, lambda a, w: F.when((F.length(w) > 3) & ~F.exists(a, lambda t: F.contains(t, w)), F.array_append(a, w)).otherwise(a))
    return F.slice(extra, 1, most)


def merged_topics(old: Column, new: Column, most: int = 10) -> Column:
    """What a session keeps: new before old, each once."""
    return F.slice(F.array_distinct(F.concat(new, old)), 1, most)


def active_locks(locks: DataFrame, as_of: Column) -> DataFrame:
    """Locks (resource, acquired_at, expires_at, released_at) in force; of several for a resource, the first acquired."""
    live = locks.where((F.col("acquired_at") <= as_of) & (F.col("expires_at") > as_of) & (F.col("released_at").isNull() | (F.col("released_at") > as_of)))
    return live.groupBy("resource").agg(F.min("acquired_at").alias("acquired_at"), F.count(F.lit(1)).alias("contenders"))


def sessionize(events: DataFrame, gap_minutes: int = 30, user: str = "user_id", at: str = "ts") -> DataFrame:
    """(user, session_no, started, ended, events): runs of events with no pause over ``gap_minutes``."""
    order = Window.partitionBy(user).orderBy(at)
    pause = (F.col(at).cast("timestamp").cast("double") - F.lag(at).over(order).cast("timestamp").cast("double")) > gap_minutes * 60
    numbered = events.withColumn("__new", F.coalesce(pause, F.lit(True)).cast("long"))
    numbered = numbered.withColumn("session_no", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session_no").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"))


def corroboration(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, matches): P1 and P2 statements that hold a claim's first long word.

    ``claims`` has claim_id, statement; ``evidence`` has statement, tier. Joined by word.
    """
    key = F.get(F.filter(words(F.col("statement")), lambda w: F.length(w) > 4), F.lit(0))
    mine = claims.select("claim_id", key.alias("word")).where("word is not null")
    theirs = evidence.where(F.col("tier").isin("P1", "P2")).select(F.explode(F.array_distinct(words(F.col("statement")))).alias("word"))
    counts = theirs.groupBy("word").agg(F.count(F.lit(1)).alias("matches"))
    return mine.join(counts, "word", "left").select("claim_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def update_pages(pages: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` after updates with optimistic locks, and the log (page_id, update_id, accepted, base_version, result_version).

    ``pages`` has page_id, state, version, content, confidence, p1, p2, p3; ``updates`` has
    update_id, page_id, base_version (null: any), content, confidence, p1, p2, p3. Of several
    updates of a page that fit its version the first by update_id is taken; the others
    conflict and may be sent again. A sure page with a P1 source turns active if its state
    may; a stale one from .5, a contradicted one from .7 on.
    """
    known = pages.select("page_id", "state", "version")
    met = updates.join(known, "page_id", "left")
    fits = F.col("version").isNotNull() & (F.col("base_version").isNull() | (F.col("base_version") == F.col("version")))
    turn = F.row_number().over(Window.partitionBy("page_id", "fits").orderBy("update_id"))
    judged = met.withColumn("fits", fits).withColumn("accepted", F.col("fits") & (turn == 1))
    log = judged.select(
        "page_id", "update_id", "accepted", F.when(F.col("accepted"), F.col("version")).alias("base_version"), F.when(F.col("accepted"), F.col("version") + 1).alias("result_version")
    )
    may = F.col("state").isin([a for a, to in TRANSITIONS["wide"].items() if "active" in to.split()])
    sure = (F.col("confidence") >= 0.5) & (F.col("p1") > 0) & may
    active = sure | ((F.col("state") == "stale") & (F.col("confidence") >= 0.5)) | ((F.col("state") == "contradicted") & (F.col("confidence") >= 0.7))
    changed = ["content", "confidence", "p1", "p2", "p3"]
    new = judged.where("accepted").select(
        "page_id", F.lit(True).alias("__new"), F.when(active, "active").otherwise(F.col("state")).alias("__state"), *[F.col(c).alias(f"__{c}") for c in changed]
    )
    took = F.coalesce("__new", F.lit(False))
    after = pages.join(new, "page_id", "left").select(
        "page_id",
        F.when(took, F.col("__state")).otherwise(F.col("state")).alias("state"),
        (F.col("version") + took.cast("long")).alias("version"),
        *[F.when(took, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in changed],
    )
    return after, log


def resolve_writes(base: DataFrame, writes: DataFrame, key: str, strategy: str = "last_writer_wins") -> DataFrame:
    """(key, writers, conflict, write_id): which of the writes (key, write_id, base_version) to a row of ``base`` (key, version) holds.

    A write conflicts if the row has moved on since its base version. ``abort`` lets the
    first write that doesn't conflict hold, ``last_writer_wins`` the last of all.
    """
    met = writes.join(base.select(key, "version"), key, "left").withColumn("late", F.coalesce(F.col("version") > F.col("base_version"), F.lit(False)))
    chosen = F.min(F.when(~F.col("late"), F.col("write_id"))) if strategy == "abort" else F.max("write_id")
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("writers"), F.bool_or("late").alias("conflict"), chosen.alias("write_id"))


def xml_escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), text)


def graph_xml(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 1000) -> DataFrame:
    """One row (graph) of GraphML with the most mentioned nodes and the first edges; a report with set limits."""
    top = nodes.orderBy(F.col("mentions").desc(), "node").limit(most_nodes)
    first = edges.orderBy("src", "dst").limit(most_edges)
    node = F.concat(F.lit('    <node id="'), xml_escape(F.col("node")), F.lit('">\n      <data key="mentions">'), F.col("mentions").cast("string"), F.lit("</data>\n    </node>\n"))
    edge = F.concat(F.lit('    <edge source="'), xml_escape(F.col("src")), F.lit('" target="'), xml_escape(F.col("dst")), F.lit('">\n    </edge>\n'))

    def joined(rows: DataFrame, order: Column, part: Column, name: str) -> DataFrame:
        return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("p")))), lambda x: x["p"]), "").alias(name))

    a = joined(top, F.struct(-F.col("mentions"), F.col("node")), node, "nodes")
    b = joined(first, F.struct("src", "dst"), edge, "links")
    start = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <graph id="KnowledgeGraph" edgedefault="directed">\n'
    return a.crossJoin(b).select(F.concat(F.lit(start), "nodes", "links", F.lit("  </graph>\n</graphml>")).alias("graph"))

"""Knowledge layer, tables and streams on small inputs; plans of scans and joins."""

from pyspark.sql import functions as F

from corpuscle.operators import knowledge as k
from corpuscle.sources import tables
from corpuscle.streaming import ingest


def test_neighbourhood_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d")], "src string, dst string")
    got = {r["node"]: r["distance"] for r in k.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert k.shortest_distance(edges, "a", "y").first()["distance"] is None


def test_transitions(spark):
    pages = spark.createDataFrame([(1, "draft", 1), (2, "archived", 4)], "page_id long, state string, version long")
    asked = spark.createDataFrame([(1, "active"), (1, "stale"), (2, "draft"), (3, "active")], "page_id long, to_state string")
    got = {(r["page_id"], r["to_state"]): (r["accepted"], r["version"]) for r in k.apply_transitions(asked, pages).collect()}
    assert got == {(1, "active"): (True, 2), (1, "stale"): (False, 1), (2, "draft"): (True, 5), (3, "active"): (False, None)}
    assert not k.apply_transitions(asked, pages, "narrow").where("page_id = 2 and accepted").count()


def test_topics(spark):
    df = spark.createDataFrame([("What is retrieval augmented generation?",), ("a the",), (None,)], "q string")
    got = [r[0] for r in df.select(k.topics(F.col("q"))).collect()]
    assert got[0] == ["What is retrieval augmented generation?", "retrieval augmented", "augmented generation?"] and got[1] == ["a the"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, t string, kept string")
    new = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "id long, t string, kept string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"], ["t"]).collect())) == [(1, "a", "x"), (2, "B", None), (3, "C", "new")]
    assert sorted(r["t"] for r in tables.insert_missing(old, new, ["id"]).collect()) == ["C", "a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    from corpuscle.operators.chunking import fixed

    docs = spark.createDataFrame([(i, f"sentence {i}. " * 30) for i in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_available(ingest.chunk_stream(spark, f"{tmp_path}/in", docs.schema, 20), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert got.count() == fixed(docs, 20).count() and not got.exceptAll(fixed(docs, 20)).count()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id user_id", "id % 5 page_id", "'x' state", "1 version").write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").where("page_id = 3").select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,3)]" in plan and "state" not in plan


def test_registry_names_every_oracle():
    from corpuscle.plans import registry

    queries, oracles = registry.load()
    assert set(oracles) <= set(queries) and len(queries) > 60

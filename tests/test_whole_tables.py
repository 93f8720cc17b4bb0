"""Queries that cover every row and whole texts."""

import re

import pytest

from corpuscle.plans import registry

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    late = "Plain words without any claim in them. " * 10 + "A later trial showed the measure {} gains by {}%. "
    docs = [(i, late.format("increases" if i % 2 else "does not change", 10 + i), "en", f"src{i % 4}", 1) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    items = [(1, "Plain title"), (2, "Über die  Größe_der Flüsse!\nzweite Zeile"), (3, "Река и камень 12"), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def slow_slug(t):
    kept = re.sub(r"[^\w\s-]", "", t.lower().strip(" "))
    return re.sub("-+", "-", re.sub(r"[\s_]+", "-", kept))[:80].rstrip("-")


def test_slugs_of_every_item(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    got = {r["item_id"]: r["slug"] for r in QUERIES["slugify_benchmark"](spark, folder).collect()}
    assert got == {r["item_id"]: slow_slug(r["text"]) for r in items}
    assert got[2] == "über-die-größe-der-flüsse-zweite-zeile"


def test_claims_after_the_300th_character(spark, folder):
    found = [r["claim"] for r in QUERIES["extract_claims"](spark, folder).collect()]
    assert sum("later trial" in c for c in found) >= 10


@pytest.mark.parametrize("name", ["upsert_documents", "seed_insert_missing"])
def test_every_document_is_on_a_side(spark, folder, name):
    got = {r["doc_id"]: r["source"] for r in QUERIES[name](spark, folder).collect()}
    kept = {i for i in range(24) if i % 2 == 0 and (name.startswith("seed") or i % 3)}
    assert got == {i: f"src{i % 4}" if i in kept else "new" for i in range(24)}


@pytest.mark.parametrize("name", ["extract_claims", "verify_claims", "verification_summary", "upsert_documents", "seed_insert_missing"])
def test_queries_equal_their_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))

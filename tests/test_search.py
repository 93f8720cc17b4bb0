"""Vector search in tiles and rankings of groups of any size, against slow versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import vectors
from corpuscle.operators import search


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def slow_nearest(rows, k, least=-2.0):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    out = set()
    for q in (i for i in unit if i % 20 == 0):
        near = sorted((-round(float(unit[q] @ u), 12), i) for i, u in unit.items())
        out |= {(q, i) for s, i in near[:k] if -s >= least}
    return out


@pytest.mark.parametrize("tile", [1, 700, 4_000_000])
def test_nearest_with_many_ties(spark, points, monkeypatch, tile):
    rows, df = points
    monkeypatch.setattr(search, "TILE", tile)
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["vec_id"]) for r in search.vector_topk(df, asked, 7).collect()}
    assert got == slow_nearest(rows, 7)
    met = {(r["query_id"], r["vec_id"]) for r in search.vectors_within(df, asked, 0.7).collect()}
    assert met == slow_nearest(rows, 1000, 0.7)
    plain = df.crossJoin(asked.withColumnRenamed("embedding", "wanted")).where(vectors.cosine(F.col("wanted"), F.col("embedding")) >= 0.7)
    assert met == {(r["query_id"], r["vec_id"]) for r in plain.collect()}


@pytest.fixture(scope="module")
def uneven(spark):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", i, "word " * rng.choice([0, 1, 5, 40]), rng.choice("abc")) for i in range(900)]
    return rows, spark.createDataFrame(rows, "source string, doc_id long, text string, tier string")


def test_running_total_of_a_hot_group(uneven):
    rows, df = uneven
    got = {r["doc_id"]: r["n"] for r in search.running_total(df, "source", [F.col("tier").desc(), F.col("doc_id")], F.lit(1), "n").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-ord(r[3]), r[1])), 1):
            want[r[1]] = n
    assert got == want


@pytest.mark.parametrize("limit", [0, 60, 100_000])
def test_budget_of_a_hot_group(uneven, limit):
    _, df = uneven
    slow = search.token_budget(df, limit, "doc_id", by="source").collect()
    fast = search.token_budget(search.before_budget(df, limit, "doc_id", by="source"), limit, "doc_id", by="source").collect()
    assert sorted(map(repr, slow)) == sorted(map(repr, fast))


def test_tiers_of_sets(spark):
    rows = [("a", i, "P1" if i % 4 == 0 else "P2") for i in range(40)] + [("b", i, "P3" if i % 2 else "UNV") for i in range(9)] + [("c", 1, "UNV"), ("c", 2, "P3"), (None, 5, "P2")]
    df = spark.createDataFrame(rows, "lang string, doc_id long, tier string")
    got = sorted((r["lang"] or "", r["doc_id"], r["flagged"]) for r in search.tier_filter(df, "lang", "doc_id").collect())
    assert got == [("", 5, False)] + [("a", i, False) for i in (0, 4, 8, 12, 16)] + [("b", i, True) for i in (1, 3, 5)] + [("c", 1, False), ("c", 2, True)]
    weighed = search.weigh_by_tier(df.withColumn("s", F.lit(1.0)), "s", "tier", "lang")
    assert {(r["lang"], r["tier"]): r["weighted"] for r in weighed.collect()} == {("a", "P1"): 1.5, ("a", "P2"): 1.0, ("b", "P3"): 1.0, ("b", "UNV"): 1.0, ("c", "UNV"): 1.0, ("c", "P3"): 1.0, (None, "P2"): 1.0}

"""Stored indexes, stems, SQL functions, paths and replayed logs against slow versions and SQL."""

import itertools
import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.functions.stem import stem as stem_of
from corpuscle.operators import graph_paths, inverted_index, replay, search, table_functions, trigrams, vector_index

# The algorithm's published examples.
STEMS = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan "
    "falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform "
    "radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous "
    "formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow "
    "inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog "
    "communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener "
    "oscillators:oscil as:as été:été x2ing:x2ing"
)


def test_stems(spark):
    pairs = [tuple(p.split(":")) for p in STEMS.split()]
    got = spark.createDataFrame([*pairs, (None, None)], "term string, want string").withColumn("term", stem_of())
    assert got.where("NOT term <=> want").collect() == []


def slow_bm25(docs, queries, stem, k, every=False):
    words = {d: [stem[w] for w in re.findall(r"[^\W_]+", (t or "").lower())] for d, t in docs}
    lengths = [len(w) for w in words.values() if w]
    mean, n = sum(lengths) / len(lengths), len(lengths)
    df = Counter(w for x in words.values() for w in set(x))
    out = []
    for q, text in queries:
        asked = {stem[w] for w in re.findall(r"[^\W_]+", (text or "").lower())}
        scored = []
        for d, x in words.items():
            tf = Counter(x)
            met = [w for w in asked if tf[w]]
            if met and (not every or len(met) == len(asked)):
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in met)
                scored.append((-round(score, 6), d))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    vocabulary = "walk walks walking walked talk talker house houses housing relational relate the of and a river rivers stone".split()
    docs = [(i, " ".join(rng.choice(vocabulary[: 4 + i % 15]) for _ in range(rng.randint(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "zebra"), (503, "Zebra, zebras!")]
    queries = [(1, "zebra walking"), (2, "the houses of relation"), (3, ""), (4, None), (5, "unknownword"), (6, "river and stone and walks"), (7, "the the THE")]
    every = sorted({w for _, t in docs + queries for w in re.findall(r"[^\W_]+", (t or "").lower())})
    stem = {r["word"]: r["stem"] for r in spark.createDataFrame([(w,) for w in every], "word string").withColumn("stem", stem_of("word")).collect()}
    return docs, queries, stem


@pytest.mark.parametrize("seed_postings, k", [(10_000, 3), (0, 3), (30, 1), (10_000, 200)])
def test_index_equals_bm25(spark, library, monkeypatch, seed_postings, k):
    docs, queries, stem = library
    monkeypatch.setattr(inverted_index, "SEED_POSTINGS", seed_postings)
    table = spark.createDataFrame([(d, t, "en" if d % 2 else "fr") for d, t in docs], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    index = inverted_index.create_index(spark, f"t{uuid.uuid4().hex}", table, ["lang"], buckets=4)
    assert inverted_index.add_documents(index, table.where("doc_id < 60"), 0) == 60
    assert inverted_index.add_documents(index, table.union(table.where("doc_id = 7")), 1) == 64
    got = sorted(tuple(r) for r in inverted_index.search_index(index, asked, k).collect())
    assert got == slow_bm25(docs, queries, stem, k)
    got = sorted(tuple(r) for r in inverted_index.search_index(index, asked, k, every_term=True).collect())
    assert got == slow_bm25(docs, queries, stem, k, every=True)
    english = [r["doc_id"] for r in inverted_index.search_index(index, asked, 200, where=F.col("lang") == "en").collect()]
    assert english and all(d % 2 for d in english)
    again = inverted_index.create_index(spark, f"t{uuid.uuid4().hex}", table, ["lang"], folder=index.folder, written=True, buckets=4)
    assert sorted(tuple(r) for r in inverted_index.search_index(again, asked, k).collect()) == slow_bm25(docs, queries, stem, k)


def test_postings_are_not_shuffled(spark, library):
    """The plan has no exchange between the files of postings and the sums per document."""
    docs = library[0]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = inverted_index.create_index(spark, f"t{uuid.uuid4().hex}", table, buckets=4)
    inverted_index.add_documents(index, table, 0)
    asked = spark.createDataFrame([(1, "zebra", 0, 1.0, True)], "query_id long, term string, folder int, idf double, essential boolean")
    plan = inverted_index._scores(index, asked, True, 10.0, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    above = plan[: plan.index("Bucketed: true")].splitlines()
    path = [line for line in above if "Exchange hashpartitioning(doc_id" in line]
    assert path == []


def test_vector_index_recall_and_exactness(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.25) for c in centres[i % 12]]) for i in range(900)] + [(2000, None), (2001, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build_vector_index(vectors, lists=12, probes=4, sample_rows=300)
    assert index.table().count() == 900
    exact = search.vector_topk(vectors, asked, 10)
    found = vector_index.search_vectors(index, asked, 10)
    assert vector_index.recall(found, exact).first()["recall"] >= 0.9
    every = vector_index.search_vectors(index, asked, 10, probes=12)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in every.collect()) == sorted((r["query_id"], r["vec_id"], r["rank"]) for r in exact.collect())
    plan = vector_index.search_vectors(index, asked.where("query_id = 0"), 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    empty = vector_index.build_vector_index(vectors.limit(0))
    assert vector_index.search_vectors(empty, asked, 3).count() == 0


def slow_grams(text):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def test_trigrams_equal_scans(spark):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("abAB ") for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(900, None), (901, ""), (902, "x"), (903, "École é")]
    patterns = [(1, "aba"), (2, "A"), (3, "b "), (4, ""), (5, None), (6, "abab a"), (7, "zzz"), (8, "éc"), (9, "École"), (10, "%a_")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = trigrams.search_substrings(trigrams.build_trigram_index(table), table, spark.createDataFrame(patterns, "query_id long, pattern string"))
    want = [(q, d) for q, p in patterns for d, t in docs if p is not None and t is not None and p.lower() in t.lower()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    index = trigrams.build_trigram_index(table, padded=True)
    for least in (0.3, 0.75, 1.0):
        got = trigrams.search_similar(index, table.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), least)
        want = []
        for (q, a), (d, b) in itertools.product([x for x in docs if x[0] % 20 == 0], docs):
            x, y = slow_grams(a), slow_grams(b)
            if x and y and len(x & y) / len(x | y) >= least:
                want.append((q, d, round(len(x & y) / len(x | y), 9)))
        assert sorted((r[0], r[1], round(r[2], 9)) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        trigrams.search_similar(trigrams.build_trigram_index(table), table)


def test_sql_functions(spark):
    from corpuscle.operators import chunking

    texts = [(1, "First part. Second part! " * 30), (2, "# Head\nbody text here\n## Two\n" + "word " * 90), (3, None), (4, "  \n"), (5, "no header")]
    rows = [(d, "P1" if d % 2 else "P2", "x", "paper", t, [float(d), 1.0]) for d, t in texts] + [(6, "P1", "x", "paper", "null vector", None), (7, "P1", "x", "paper", "zero", [0.0, 0.0])]
    spark.createDataFrame(rows, "doc_id long, source_tier string, domain string, doc_type string, text string, embedding array<float>").createOrReplaceTempView("corpus_t")
    table_functions.register(spark, "corpus_t")
    docs = spark.table("corpus_t")
    for strategy in ("fixed", "semantic", "markdown"):
        columns = ["doc_id", "chunk_index", "total_chunks", "chunk", "token_count"] + ["header"] * (strategy == "markdown")
        got = spark.sql(f"SELECT doc_id, c.* FROM corpus_t, LATERAL chunk_text(text, '{strategy}', 20, 0.2) c").select(*columns)
        want = chunking.chunk_text(docs, strategy, size=20, overlap=0.2).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="unknown chunking strategy"):
        spark.sql("SELECT * FROM chunk_text('a', 'nonexistent')").collect()
    one = spark.sql("SELECT doc_id, source_tier FROM search_documents(array(CAST(1 AS FLOAT), CAST(0 AS FLOAT)), 0.5D, 2)").collect()
    assert [tuple(r) for r in one] == [(5, "P1"), (4, "P2")]
    assert spark.sql("SELECT doc_id FROM search_documents(array(CAST(1 AS FLOAT), CAST(0 AS FLOAT)), 0.5D, 9, filter_tier => 'P2') ORDER BY 1").collect() == [(2,), (4,)]


def test_short_patterns_equal_few_or_many(spark, monkeypatch):
    table = spark.createDataFrame([(1, "Ab ab"), (2, "b"), (3, None), (4, "xaB")], "doc_id long, text string")
    index = trigrams.build_trigram_index(table)
    asked = spark.createDataFrame([(1, "AB"), (2, "b"), (3, None), (4, "zz")], "query_id long, pattern string")
    want = [(1, 1), (1, 4), (2, 1), (2, 2), (2, 4)]
    for few in (trigrams.FEW, 0):
        monkeypatch.setattr(trigrams, "FEW", few)
        assert sorted(map(tuple, trigrams.search_substrings(index, table, asked).collect())) == want


def test_buckets_grow_with_the_text(spark, library, monkeypatch):
    docs, queries, _ = library
    table = spark.createDataFrame([(d, t, "P1" if d % 2 else "P2") for d, t in docs], "doc_id long, text string, source_tier string")
    assert inverted_index.buckets_for(table) == inverted_index.DOC_BUCKETS
    monkeypatch.setattr(inverted_index, "BUCKET_CHARS", 900)
    wanted = inverted_index.buckets_for(table)
    assert wanted == -(-sum(len(t or "") for _, t in docs) // 900) > inverted_index.DOC_BUCKETS
    index = inverted_index.create_index(spark, f"t{uuid.uuid4().hex}", table, ["source_tier"], buckets=wanted)
    inverted_index.add_documents(index, table, 0)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = table_functions.keyword_asked(index, asked, 4).select("query_id", "doc_id", "score")
    want = inverted_index.search_index(index, asked, 4).select("query_id", "doc_id", "keyword_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_queries_of_a_table_are_searched_in_blocks(spark, monkeypatch):
    """A table of queries gives what LATERAL gives row by row, without a join of all pairs."""
    rng = random.Random(4)
    rows = [(i, f"P{i % 3}", "x", "paper", "t", [rng.choice([0.0, 1.0, -1.0]) for _ in range(4)]) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, source_tier string, domain string, doc_type string, text string, embedding array<float>").createOrReplaceTempView("corpus_b")
    table_functions.register(spark, "corpus_b")
    asked = spark.table("corpus_b").where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    asked.createOrReplaceTempView("asked_b")
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    got = table_functions.search_asked(spark, "corpus_b", asked, 0.2, 3, filter_tier="P1")
    want = spark.sql("SELECT query_id, s.* FROM asked_b, LATERAL search_documents(embedding, 0.2D, 3, NULL, 'P1', NULL) s")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    rounded = [sorted((*r[:6], round(r[6], 9)) for r in x.collect()) for x in (got, want)]
    assert rounded[0] == rounded[1] and len(rounded[0]) > 20


def test_similarity_hands_on_pairs_only_that_are_alike(spark, monkeypatch):
    """No step holds a row for each common gram of a query and a text; blocks of queries give the same."""
    docs = [(i, f"http www example com item{i % 17} page{i % 5}") for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = table.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    index = trigrams.build_trigram_index(table, padded=True)
    want = {(q, d) for (q, a), (d, b) in itertools.product(docs[::20], docs) if 10 * len(slow_grams(a) & slow_grams(b)) >= 9 * len(slow_grams(a) | slow_grams(b))}
    for block in (trigrams.BLOCK, 40):
        monkeypatch.setattr(trigrams, "BLOCK", block)
        got = trigrams.search_similar(index, asked, 0.9)
        assert sorted((r[0], r[1]) for r in got.collect()) == sorted(want)


def slow_path(edges, a, b, depth):
    def distances(step, seed):
        seen, frontier = {seed: 0}, [seed]
        for i in range(depth):
            frontier = sorted({y for x in frontier for y in step.get(x, ()) if y not in seen})
            seen |= dict.fromkeys(frontier, i + 1)
        return seen

    ahead, back = {}, {}
    for s, t, _ in edges:
        ahead.setdefault(s, set()).add(t)
        back.setdefault(t, set()).add(s)
    x, y = distances(ahead, a), distances(back, b)
    return min((x[n] + y[n] for n in x if n in y), default=None)


def test_paths(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", f"r{i}") for i in range(60)] + [("n1", "n1", "loop"), (None, "n2", "x"), ("n1", None, "y")]
    pairs = [(i, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for i in range(60)] + [(100, "n3", "n3"), (101, "nowhere", "n1"), (102, None, "n1"), (103, "out", "out")]
    got = graph_paths.connections(spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame(pairs, "pair_id long, start string, goal string"), 3)
    found = {r["pair_id"]: r for r in got.collect()}
    known = [e for e in edges if None not in e]
    for i, a, b in pairs:
        want = None if a is None else slow_path(known, a, b, 3)
        assert (found[i]["distance"] if i in found else None) == want
        if want is not None:
            nodes, relations = found[i]["nodes"], found[i]["relations"]
            assert nodes[0] == a and nodes[-1] == b and len(relations) == want == len(nodes) - 1
            assert all((x, y, r) in known for x, y, r in zip(nodes, nodes[1:], relations))
            assert found[i]["meeting"] in nodes


def test_pairs_share_the_search_of_an_end(spark, monkeypatch):
    """200 pairs with one goal that 300 nodes lead to: no step writes a row for each pair and node."""
    written = []
    plain = graph_paths.durable

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph_paths, "durable", counted)
    edges = [(f"in{i}", "goal", "to") for i in range(300)] + [(f"s{i}", "mid", "a") for i in range(200)] + [("mid", "far", "b"), ("far", "in7", "c")]
    pairs = [(i, f"s{i}", "goal") for i in range(200)]
    got = graph_paths.connections(spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame(pairs, "pair_id long, start string, goal string"))
    assert {(r["pair_id"], tuple(r["nodes"])) for r in got.collect()} == {(i, (f"s{i}", "mid", "far", "in7", "goal")) for i in range(200)}
    assert max(written) <= 300


def test_replay_applies_updates_in_order(spark):
    rng = random.Random(6)
    pages = [(i, ["draft", "active", "stale", "contradicted", "archived"][i % 5], 1, "old", 0.0, 0, 0, 0) for i in range(10)]
    updates = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 77, None]), rng.choice([None, 1, 2, 3, 4]), f"c{i}", rng.random(), rng.randint(0, 1), 0, 0) for i in range(300)]
    shape = "state string, version long, content string, confidence double, p1 long, p2 long, p3 long"
    after, log = replay.replay_updates(
        spark.createDataFrame(pages, f"page_id long, {shape}"), spark.createDataFrame(updates, "update_id long, page_id long, base_version long, content string, confidence double, p1 long, p2 long, p3 long")
    )
    may = {"draft", "stale", "contradicted"}
    state = {p[0]: [p[1], p[2], p[3]] for p in pages}
    want = {}
    for update_id, page, base, content, sure, p1, *_ in updates:
        now = state.get(page)
        took = now is not None and base in (None, now[1])
        want[update_id] = (took, now[1] if took else None)
        if took:
            active = sure >= 0.5 and p1 > 0 and now[0] in may or now[0] == "stale" and sure >= 0.5 or now[0] == "contradicted" and sure >= 0.7
            state[page] = ["active" if active else now[0], now[1] + 1, content]
    assert {r["update_id"]: (r["accepted"], r["base_version"]) for r in log.collect()} == want
    assert {r["page_id"]: [r["state"], r["version"], r["content"]] for r in after.collect()} == state
    assert sum(t for t, _ in want.values()) > 50


def test_replay_keeps_a_page_in_one_task(spark, tmp_path):
    """Updates of one page from several files, joined with pages so few that the plan is changed while it runs."""
    at = str(tmp_path / "updates")
    spark.range(0, 4000, 1, 8).selectExpr("id AS update_id", "id % 5 AS page_id", "CAST(NULL AS BIGINT) AS base_version", "'c' AS content", "0.9D AS confidence", "1L AS p1", "0L AS p2", "0L AS p3").write.parquet(at)
    pages = spark.read.parquet(at).select("page_id").distinct().selectExpr("page_id", "'draft' AS state", "0L AS version", "'old' AS content", "0D AS confidence", "0L AS p1", "0L AS p2", "0L AS p3")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in changed}
    try:
        for c, value in changed.items():
            spark.conf.set(c, value)
        after, log = replay.replay_updates(pages, spark.read.parquet(at))
        assert [r["version"] for r in after.collect()] == [800] * 5
        assert log.groupBy("page_id").agg(F.count_distinct("result_version").alias("n")).where("n = 800").count() == 5
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_sources_that_share_an_author_or_domain_count_once(spark):
    from corpuscle.operators import claims

    rng = random.Random(9)
    rows = []
    for group in range(40):
        for i in range(rng.randint(1, 25)):
            rows.append((group, i % 3, rng.choice(["a.org", "b.org", "c.org", "", None]), rng.choice([None, [], ["x"], ["x", "y"], ["z"], [f"own{i}"], [None, "w"]]), i))
    got = claims.independent_counts(spark.createDataFrame(rows, "query_id long, claim_no long, base_domain string, authors array<string>, source_no long"), ["query_id", "claim_no"])
    want = {}
    for group, claim, domain, authors, i in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        chosen = want.setdefault((group, claim), [])
        own = {a for a in authors or [] if a}
        if all(not (domain and domain == d) and not own & a for d, a in chosen):
            chosen.append((domain, own))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: len(v) for k, v in want.items()}


def test_shared_authors_change_what_is_established(spark):
    from corpuscle.operators import claims

    text = "the vaccine significantly reduced infection among adults"
    given = spark.createDataFrame([(1, 1, text)], "query_id long, claim_no long, claim string")
    rows = [(1, "https://a.org/1", "P1", "a.org", text, "", ["Ada"], 1), (1, "https://b.org/1", "P2", "b.org", text, "", ["Ada", "Bob"], 2)]
    sources = spark.createDataFrame(rows, "query_id long, url string, tier string, base_domain string, title string, snippet string, authors array<string>, source_no long")
    told = claims.verify_claims(given, sources).first()
    plain = claims.verify_claims(given, sources.drop("authors")).first()
    assert (told["independent"], told["status"]) == (1, "TENTATIVE") and (plain["independent"], plain["status"]) == (2, "ESTABLISHED")


def test_keyword_search_in_sql_equals_the_index(spark, library):
    docs, queries, _ = library
    table = spark.createDataFrame([(d, t, "P1" if d % 2 else "P2", "x", "y", [1.0]) for d, t in docs], "doc_id long, text string, source_tier string, domain string, doc_type string, embedding array<float>")
    table.createOrReplaceTempView("corpus_k")
    index = inverted_index.create_index(spark, f"t{uuid.uuid4().hex}", table, ["source_tier"], buckets=4)
    inverted_index.add_documents(index, table, 0)
    table_functions.register(spark, "corpus_k", index)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    asked.createOrReplaceTempView("asked_k")
    got = spark.sql("SELECT query_id, s.doc_id, s.score FROM asked_k, LATERAL keyword_search(query, 4) s")
    want = inverted_index.search_index(index, asked, 4).select("query_id", "doc_id", "keyword_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = spark.sql("SELECT doc_id FROM keyword_search('zebra', filter_tier => 'P1')").collect()
    assert [r[0] for r in one] == [503]


def test_research_cycles(spark):
    from corpuscle.operators import cycles

    rng = random.Random(12)
    first = [(q, f"u{rng.randrange(30)}", rng.choice("st"), i) for q in range(8) for i in range(rng.randint(1, 4))] + [(0, None, "s", 9)]
    gaps = [(q, c, g, f"gap {rng.randrange(12)}") for q in range(8) for c in (1, 2, 3) for g in range(4) if rng.random() < 0.8]
    answers = [(f"gap {g}", s, p, f"u{rng.randrange(60)}") for g in range(10) for s in "st" for p in range(4)] + [("gap 1", "s", 0, None)]
    found = cycles.research_cycles(
        spark.createDataFrame(first, "question_id long, url string, source string, pos long"),
        spark.createDataFrame(gaps, "question_id long, cycle long, gap_no long, gap string"),
        spark.createDataFrame(answers, "gap string, source string, pos long, url string"),
    )
    want = {}
    for q in range(8):
        urls = {}
        for _, u, s, p in sorted((r for r in first if r[0] == q and r[1]), key=lambda r: (r[2], r[3])):
            urls.setdefault(u, 0)
        for cycle in (1, 2):
            new = set()
            for _, _, _, gap in sorted(g for g in gaps if g[0] == q and g[1] == cycle)[:3]:
                for source in "st":
                    hits = sorted((p, u) for g, s, p, u in answers if g == gap and s == source and u)[:2]
                    new |= {u for _, u in hits} - set(urls)
            if not new:
                break
            urls |= dict.fromkeys(new, cycle)
        want[q] = urls
    got = {}
    for r in found.collect():
        assert r["url"] not in got.setdefault(r["question_id"], {})
        got[r["question_id"]][r["url"]] = r["cycle"]
    assert got == want
    assert {r["question_id"]: (r["cycles"], r["sources"]) for r in cycles.cycle_counts(found).collect()} == {q: (max(u.values()) + 1, len(u)) for q, u in want.items()}

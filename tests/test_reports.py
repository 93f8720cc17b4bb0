"""Citations, answers, reports, statements, page updates and exports on small inputs, nulls and empty texts among them."""

import re

from pyspark.sql import functions as F

from corpuscle.functions import quality, text
from corpuscle.operators import claims, knowledge, reports
from corpuscle.sources import connectors

CHUNK = "query_id long, rank long, similarity double, author string, arxiv string, domain string, tier string, url string, title string, text string"


def chunks(spark):
    long = ". ".join(["one two three four five six seven eight nine ten"] * 20)
    return spark.createDataFrame(
        [
            (1, 2, 0.9, None, None, "x.org", "P2", "https://x.org/a", "T", "second"),
            (1, 1, 0.85, "Lewis, P.", "2312.1", "y.org", "P1", "https://y.org/2023/b", "T", long),
            (2, 1, 0.6, "Lewis, P.", None, "", None, None, None, None),
        ],
        CHUNK,
    )


def test_answers(spark):
    asked = spark.createDataFrame([(1, False), (2, True), (3, False)], "query_id long, needs_table boolean")
    got = {r["query_id"]: r for r in reports.answers(chunks(spark), asked).collect()}
    ten = "one two three four five six seven eight nine ten"
    assert got[1]["answer"] == f"{ten}. {ten}. {ten}. [Lewis 2312, P1]" and got[1]["method"] == "pass_through" and got[1]["mean_similarity"] == 0.875
    assert (got[2]["method"], got[2]["answer"]) == ("raw_context", "[Source 1 [unknown, UNV]]: ")
    assert (got[3]["answer"], got[3]["token_count"], got[3]["mean_similarity"]) == ("", 1, None)
    whole = {r["query_id"]: r["context"] for r in reports.context(chunks(spark)).collect()}
    assert whole[1].endswith("\n\n[Source 2 [x.org, P2]]: second") and whole[1].startswith("[Source 1 [Lewis 2312, P1]]: one")
    shown = {r["query_id"]: r["rendered"] for r in reports.render(chunks(spark)).collect()}
    assert "--- Result 1 [Lewis 2023, P1] ---\nTitle: T\nSource: https://y.org/2023/b\nTier: P1 | Similarity: 0.850\n\n" in shown[1]


def slow_cap(t, most=150):
    if max(1, len(t) // 4) <= most:
        return t
    head = " ".join(t.split()[:most])
    dot = head.rfind(".")
    return head[: dot + 1] if dot > len(head) * 0.7 else head


def test_word_caps(spark):
    texts = ["", "short.", "word " * 400, "A sentence of words. " * 100, "w" * 100 + ". " + "more " * 300]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reports.cap_words(F.col("t"))).collect()]
    assert got == [slow_cap(t) for t in texts]


def test_reports_and_gaps(spark):
    raw = "## EXECUTIVE SUMMARY\n All  well. \n\n## KEY FINDINGS\n|Finding|b|c|\n|---|\n| a | | b | c |\n## Active Debates\n- x\n\n# no\ny\n## SPECULATIVE\nz"
    df = spark.createDataFrame([(1, raw), (2, ""), (3, None), (4, "no heading")], "id long, text string")
    got = sorted((r["id"], r["section"], r["line_no"], r["cells"]) for r in reports.report_lines(df, "id").collect())
    assert got == [(1, "debates", 0, ["- x"]), (1, "debates", 1, ["y"]), (1, "findings", 0, ["Finding", "b", "c"]), (1, "findings", 1, ["a", "b", "c"]), (1, "speculative", 0, ["z"]), (1, "summary", 0, ["All  well."])]
    lists = spark.createDataFrame([("1. short\n2) long enough item\n- also long enough\n3. third good item\n4. fourth good item",), ("",), (None,)], "t string")
    assert [r[0] for r in lists.select(reports.gaps(F.col("t"))).collect()] == [["long enough item", "also long enough", "third good item"], [], None]


def slow_statements(snippet):
    out = []
    for verbs in claims.CAUSAL:
        out += [m.strip() for m in re.findall(rf"(?is)([^.]*?(?:{verbs})[^.]*?\.)[^.]*\.", snippet or "")]
    return [s for s in dict.fromkeys(out) if 20 < len(s) < 300][:20]


def test_statements_equal_the_pattern(spark):
    base = "Smoking causes a lot of harm. It leads to more of the same thing. Plain words. The trial showed that it reduces the risk by much. End"
    snippets = [base, base + ".", "", None, "A cause increases the number of things. " * 7, "no stop causes nothing at all to be told", ". .. Work improves the people who do it well.."]
    df = spark.createDataFrame([(i, 1, "P1" if i % 2 else "P3", s) for i, s in enumerate(snippets)], "q long, n long, tier string, snippet string")
    got = {}
    for r in claims.extract_statements(df, "q", "n").orderBy("q", "claim_no").collect():
        got.setdefault(r["q"], []).append(r["claim"])
    assert got == {i: slow_statements(s) for i, s in enumerate(snippets) if slow_statements(s)}
    made = claims.extract_statements(df, "q", "n")
    support = claims.count_support(made, df, "q")
    assert support.count() == made.count() and {r["supporting"] for r in support.collect()} == {1}


def test_page_updates(spark):
    pages = spark.createDataFrame([(1, "draft", 1, "a", 0.0, 0, 0, 0), (2, "stale", 3, "b", 0.0, 0, 0, 0), (3, "archived", 1, "c", 0.0, 0, 0, 0)], "page_id long, state string, version long, content string, confidence double, p1 long, p2 long, p3 long")
    asked = [(10, 1, 1, "A", 0.9, 1, 0, 0), (11, 1, 1, "B", 0.9, 1, 0, 0), (12, 2, 2, "late", 0.9, 1, 0, 0), (13, 3, None, "C", 0.9, 1, 0, 0), (14, 9, None, "gone", 0.9, 1, 0, 0)]
    updates = spark.createDataFrame(asked, "update_id long, page_id long, base_version long, content string, confidence double, p1 long, p2 long, p3 long")
    after, log = knowledge.update_pages(pages, updates)
    assert {r["page_id"]: (r["state"], r["version"], r["content"]) for r in after.collect()} == {1: ("active", 2, "A"), 2: ("stale", 3, "b"), 3: ("archived", 2, "C")}
    assert {r["update_id"]: (r["accepted"], r["result_version"]) for r in log.collect()} == {10: (True, 2), 11: (False, None), 12: (False, None), 13: (True, 2), 14: (False, None)}


def test_small_expressions(spark):
    row = spark.range(1).select(
        text.clean_pages(F.lit("a hyphen-\nated\fword\n\n\n\nend-\n.")).alias("page"),
        quality.source_tier_narrow(F.lit("https://sub.who.int/x"), F.lit("UNV")).alias("tier"),
        quality.source_tier_narrow(F.lit(None).cast("string"), F.lit("UNV")).alias("none"),
        knowledge.xml_escape(F.lit("<a b=\"c\">'&")).alias("xml"),
        reports.ago(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 00:00:30")).alias("a"),
        reports.ago(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-02 12:00:00")).alias("b"),
    ).first()
    assert tuple(row) == ("a hyphenated\nword\n\nend-\n.", "P2", "UNV", "&lt;a b=&quot;c&quot;&gt;&apos;&amp;", "1 minute ago", "2 days ago")
    bodies = spark.createDataFrame([("a", "{}"), ("b", "broken"), ("c", None), ("d", '{"message":{"assertion":[{"name":"retracted"}]}}')], "doi string, body string")
    assert {r["doi"]: (r["is_retracted"], r["notice"]) for r in connectors.retractions(bodies).collect()} == {"a": (False, ""), "b": (False, ""), "c": (False, ""), "d": (True, "")}


def test_words_of_a_source_are_split_once(spark):
    """The words of texts are split below the join with claims; long texts have none to compare."""
    from corpuscle.operators import claims

    start = " ".join("abcdefghijklmnopqrstuvwxy")
    rows = [(1, "P2", " ".join(reversed(start.split()))), (1, "P2", " ".join(f"w{i}" for i in range(200))), (1, "P1", None)]
    sources = spark.createDataFrame(rows, "q long, tier string, snippet string")
    made = spark.createDataFrame([(1, 1, start)], "q long, claim_no long, claim string")
    found = claims.count_support(made, sources, "q")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, "SPECULATIVE", 0.4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not any("split(" in line for line in plan.splitlines() if "Aggregate" in line)

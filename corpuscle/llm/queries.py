"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, html_extract, importance, line_dedup, lm_score, mixing, pii, prefix_join, quality_rules, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Production rules; the longest that fits a URL decides.
URL_RULES = [urls.Rule("net/", False), urls.Rule("example.net/en/", True), urls.Rule("example.com/de/", False), urls.Rule("org/fr/", True)]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(urls.label_by_words(pages))
    return urls.filter_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "bad_probability")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_report(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))


#: A conversation that says what the template says.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_table(turns.union(spark.createDataFrame(CONTROL_TURNS, turns.schema))))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # the text is not kept beside the signals
    judged = quality_rules.judge_signals(quality_rules.with_votes(quality_rules.with_signals(docs).drop("text")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


#: Production parameters of the mix: parts of 100 by source.
MIX_WEIGHTS = {"src0": 24} | {f"src{i}": 4 for i in range(1, 20)}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_pool", "mix_block", "mix_slot", "mix_row", "mix_exact")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_report(pii.find_private(_table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.join_similar(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_url_filter, op2_line_dedup, op3_html_extraction, op4_benchmark_decontamination, op5_chat_formatting, op6_simhash_near_dedup,
        op7_quality_rules, op8_lm_scoring, op9_mix_sources, op10_pii, op11_filter_audit, op12_importance_resampling,
        op13_ngram_jaccard_join,
    )
    return {f.__name__: f for f in every}


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS words
  FROM b WHERE len(w) > 0
),
places AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
),
hits AS (SELECT DISTINCT p.r, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = x.words),
hit_words AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_OP11_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_OP11_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
),
f AS (
  SELECT r, doc_id, part, unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)]) AS fails
  FROM d
),
s AS (SELECT r, doc_id, part, coalesce(string_agg(filter, '') FILTER (fails), '') AS failed FROM f GROUP BY ALL),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM s LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
),
p AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, filter_order[:step - 1] AS earlier FROM o, unnest(range(1, 6)) AS u(step)),
e AS (
  SELECT part, filter_order, step, filter, n, good, toxic, failed, contains(failed, filter) AS fails, length(failed) > 0 AND regexp_matches(failed, '[' || earlier || '0]') AS gone FROM m, p
),
y AS (SELECT part, filter, sum(n) FILTER (fails AND NOT gone) AS shapley FROM e GROUP BY 1, 2)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = filter), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost, coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM e JOIN y USING (part, filter) GROUP BY part, filter_order, step
"""
_SHINGLES = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: hash(array_to_string(w[i:i + 3], ' ')))) AS h FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
"""
OP13_SQL = f"""{_SHINGLES}
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(reach.b)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY 1, 2
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can say: the others fit models, hash with XXH64, parse HTML or build trees; tests compare them with slow versions."""
    return {"op4_benchmark_decontamination": OP4_SQL, "op11_filter_audit": OP11_SQL, "op13_ngram_jaccard_join": OP13_SQL}

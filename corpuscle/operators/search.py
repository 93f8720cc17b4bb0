"""Retrieval for batches of queries: vectors, words, fusion, source hierarchy, budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import decayed, tier_boost, tier_order
from ..functions.text import CHARS_PER_TOKEN, estimate_tokens, words
from ..sources.tables import durable

RRF_K = 60
LEAST_PART = 50
#: Numbers of query vectors that are broadcast at once; more queries take more passes.
QUERY_BLOCK = 2_000_000
#: Cells of the similarity matrix that a task holds at once.
TILE = 4_000_000


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest vectors of every query by cosine, exactly.

    Queries (query_id, embedding) are broadcast in blocks of bounded size; every
    batch of vectors gives its own k best by matrix products of bounded size, so only
    those are shuffled. Vectors or queries without length match nothing. Ties go by vec_id.
    """
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("v is not null")
    found = reduce(DataFrame.unionByName, [_nearest(slim, ids, block, k, least) for ids, block in _blocks(queries)])
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    held: list[np.ndarray] = []
    for row in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():  # the stated query set, block by block
        if held and len(held) * len(held[0]) >= QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(held)
            ids, held = [], []
        ids.append(row[0])
        held.append(np.array(row[1], np.float64))
    yield np.array(ids, np.int64), np.array(held)


def vectors_within(vectors: DataFrame, queries: DataFrame, least: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity): every vector of cosine ``least`` or more to a query of a stated set."""
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("v is not null")
    parts = [_nearest(slim, ids, block, None, least) for ids, block in _blocks(queries)]
    return reduce(DataFrame.unionByName, parts)


def _nearest(vectors: DataFrame, ids: np.ndarray, block: np.ndarray, k: int | None, least: float | None) -> DataFrame:
    sizes = np.linalg.norm(block, axis=1) if len(ids) else np.zeros(0)
    ids, block = ids[sizes > 0], block[sizes > 0] / sizes[sizes > 0, None] if len(ids) else block
    given = vectors.sparkSession.sparkContext.broadcast((ids, block))

    def run(batches):
        ids_of, unit = given.value
        for batch in batches:
            if not batch.num_rows or not len(ids_of):
                continue
            own = np.array(batch.column(0).to_pylist(), np.int64)
            rows = np.array(batch.column(1).to_pylist(), np.float64)
            size = np.linalg.norm(rows, axis=1)
            own, rows = own[size > 0], rows[size > 0] / size[size > 0, None]
            if not len(own):
                continue
            step = max(1, TILE // len(own))
            for at in range(0, len(ids_of), step):
                q, r, score = _best(unit[at : at + step] @ rows.T, own, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of[at + q]), pa.array(own[r]), pa.array(score)], names=["query_id", "vec_id", "similarity"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, similarity double")


def _best(near: np.ndarray, own: np.ndarray, k: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (query, row) and scores of each query's k best and of those that tie with the last of them by id."""
    fits = near >= least if least is not None else np.ones(near.shape, bool)
    rounded = np.round(near, 12)
    if k is not None and k < near.shape[1]:
        fits &= rounded >= np.partition(rounded, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
    q, r = np.nonzero(fits)
    if k is not None:
        order = np.lexsort((own[r], -rounded[q, r], q))
        q, r = q[order], r[order]
        first = np.searchsorted(q, q)
        q, r = q[np.arange(len(q)) - first < k], r[np.arange(len(q)) - first < k]
    return q, r, near[q, r]


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl): the word index of a corpus, or of the terms in ``only`` (term)."""
    flat = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    if only is not None:
        flat = flat.join(only, "term", "left_semi")
    return flat.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """(docs, mean_dl) of the documents that have words: one row, from their word counts alone."""
    return docs.select(F.size(words(F.col(text))).alias("dl")).where("dl > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean_dl"))


def keyword_topk(index: DataFrame, queries: DataFrame, k: int, every_term: bool = False, corpus: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, keyword_score, rank): BM25 over postings for queries (query_id, query).

    ``every_term`` keeps documents that hold all of a query's words. ``corpus`` is
    ``corpus_size``; without it the whole index is counted.
    """
    if corpus is None:
        corpus = index.groupBy("doc_id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean_dl"))
    terms = query_terms(queries)
    wanted = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    frequency = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = terms.join(frequency, "term").join(index, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(idf * weight), 6).alias("keyword_score"), F.count(F.lit(1)).alias("matched"))
    if every_term:
        scored = scored.join(wanted, "query_id").where("matched = n_terms").drop("n_terms")
    order = Window.partitionBy("query_id").orderBy(F.col("keyword_score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("matched")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))


def search_words(docs: DataFrame, queries: DataFrame, k: int, every_term: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keyword_topk`` over texts without a stored index.

    Only postings of the queries' own words leave the scan; they are written once
    and read for the frequencies and the scores.
    """
    index = durable(postings(docs, doc_id, text, query_terms(queries).select("term").distinct()))
    return keyword_topk(index, queries, k, every_term, corpus_size(docs, text))


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, constant: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, similarity, keyword_score, fused, fused_rank) of two ranked lists.

    A row in both lists keeps both scores. Ties go by list (vectors first), then rank in it.
    """
    lists = vector.select("query_id", F.col("vec_id").alias("doc_id"), "similarity", F.lit(0.0).alias("keyword_score"), "rank", F.lit(0).alias("list")).unionByName(
        keyword.select("query_id", "doc_id", F.lit(0.0).alias("similarity"), "keyword_score", "rank", F.lit(1).alias("list"))
    )
    fused = lists.groupBy("query_id", "doc_id").agg(
        F.max("similarity").alias("similarity"),
        F.max("keyword_score").alias("keyword_score"),
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"),
        F.min(F.struct("list", "rank")).alias("tie"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "tie")
    return fused.withColumn("fused_rank", F.row_number().over(order).cast("long")).drop("tie")


def running_total(rows: DataFrame, by: str, order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row of its group, in groups of any size.

    Rows are cut into ranges of (by, order), written once, and summed range by range; a
    range's total is added to those after it. No task sorts more than a range. ``order``
    must set every row's place in its group; a null group is a group.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(rows.withColumn("__value", value).repartitionByRange(ranges, by, *order).withColumn("__range", F.spark_partition_id()))
    sums = cut.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__of")).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__by", "__of", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    met = cut.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    own = F.sum("__value").over(Window.partitionBy(by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn(name, own + F.col("__before")).drop("__value", "__range", "__by", "__of", "__before")


def weigh_by_tier(rows: DataFrame, score: str, tier: str = "source_tier", by: str = "query_id") -> DataFrame:
    """``rows`` with the tier-weighted score; weights apply where the set, of any size, has a P1 source."""
    first = rows.where(F.col(tier) == "P1").select(F.col(by).alias("__by")).distinct()
    met = rows.join(first.withColumn("__p1", F.lit(True)), F.col(by).eqNullSafe(F.col("__by")), "left")
    return met.withColumn("weighted", F.round(F.col(score) * tier_boost(F.col(tier), F.col("__p1").isNotNull()), 9)).drop("__by", "__p1")


def source_hierarchy(rows: DataFrame, score: str = "fused", tier: str = "source_tier", by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Top-k lists with the tier-weighted score and its rank; weights apply where the list has a P1 source."""
    every = Window.partitionBy(by)
    any_p1 = F.max((F.col(tier) == "P1").cast("int")).over(every) == 1
    weighed = rows.withColumn("weighted", F.round(F.col(score) * tier_boost(F.col(tier), any_p1), 9))
    return weighed.withColumn("weighted_rank", F.row_number().over(every.orderBy(F.col("weighted").desc(), tie)).cast("long"))


def before_budget(rows: DataFrame, limit: int, order: str, by: str = "query_id", text: str = "text") -> DataFrame:
    """Those rows of groups of any size that ``token_budget`` can keep: up to the first that doesn't fit.

    Only token counts are ordered; texts are read again for the rows that stay, at most
    ``limit`` + 1 in a group, as a row counts one token at least.
    """
    slim = rows.select(by, order, estimate_tokens(F.col(text)).alias("__n"))
    summed = running_total(slim, by, [order], F.col("__n"), "__sum")
    last = summed.where(F.col("__sum") - F.col("__n") <= limit).groupBy(F.col(by).alias("__by")).agg(F.max(order).alias("__last"))
    return rows.join(last, F.col(by).eqNullSafe(F.col("__by")) & (F.col(order) <= F.col("__last"))).drop("__by", "__last")


def token_budget(rows: DataFrame, limit: int, order: str, by: str = "query_id", text: str = "text", least: int = LEAST_PART) -> DataFrame:
    """The rows that fit ``limit`` tokens in order; the first that doesn't is cut if over ``least`` tokens are left.

    Adds ``token_count`` (of what is kept) and ``partial``.
    """
    run = Window.partitionBy(by).orderBy(order)
    tokens = estimate_tokens(F.col(text))
    counted = rows.withColumn("__n", tokens).withColumn("__sum", F.sum("__n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(limit) - (F.col("__sum") - F.col("__n"))
    first = F.coalesce(F.max("__sum").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= limit
    partial = F.col("__sum") > limit
    kept = counted.withColumn("__left", left).withColumn("__first", first).where((~partial) | (F.col("__first") & (F.col("__left") > least)))
    cut = F.when(partial, F.left(F.col(text), (F.col("__left") * CHARS_PER_TOKEN).cast("int"))).otherwise(F.col(text))
    return (
        kept.withColumn("partial", partial)
        .withColumn("token_count", F.when(partial, F.col("__left")).otherwise(F.col("__n")).cast("long"))
        .withColumn(text, cut)
        .drop("__n", "__sum", "__left", "__first")
    )


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 5, final_k: int = 3, budget: int = 2000, least: float = 0.5) -> DataFrame:
    """Hybrid retrieval: vectors and words, fused, weighed by tier, cut to ``final_k`` and to the budget.

    ``docs`` has doc_id, text, source_tier; ``queries`` has query_id, query, embedding.
    Texts are joined last, for chosen rows only.
    """
    near = vector_topk(vectors, queries, top_k, least)
    found = search_words(docs, queries, top_k)
    fused = reciprocal_rank_fusion(near, found).join(docs.select("doc_id", "source_tier"), "doc_id")
    best = source_hierarchy(fused).where(F.col("weighted_rank") <= final_k)
    return token_budget(best.join(docs.select("doc_id", "text"), "doc_id"), budget, "weighted_rank")


def merge_sources(results: DataFrame, limit: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Search results of several connectors in one list: no empty URL, the first of each URL, best tier first.

    ``results`` has url, tier, source_pos and pos (order of connectors, order in one).
    """
    by = by or []
    first = Window.partitionBy(*by, "url").orderBy("source_pos", "pos")
    kept = results.where("url is not null and url <> ''").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if limit is None:
        return kept
    order = [tier_order(F.col("tier")), F.col("source_pos"), F.col("pos")]
    if not by:
        return kept.orderBy(*order).limit(limit)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def tier_filter(sources: DataFrame, by: str, order: str, tier: str = "tier") -> DataFrame:
    """The sources of the best tier of each set: five of P1, else five of P2, else three of P3 (flagged) and others.

    Adds ``flagged``. Each task hands on its own five best of a set, so a set may have any size.
    """
    first = Window.partitionBy(by).orderBy("__o", order)
    top = sources.withColumn("__o", tier_order(F.col(tier))).withColumn("__n", F.row_number().over(first)).where("__n <= 5")
    best = F.min("__o").over(Window.partitionBy(by))
    kept = top.withColumn("__best", best).where("__best < 2 and __o = __best or __best >= 2 and __n <= 3")
    return kept.withColumn("flagged", F.col(tier) == "P3").drop("__o", "__n", "__best")


def temporal_rank(sources: DataFrame, by: str, current_year: int, score: str = "score", date: str = "date", tie: str = "id") -> DataFrame:
    """``sources`` with the age-weighed score and its rank in each set; ``tie`` tells the rows of a set apart."""
    aged = sources.withColumn("decayed", F.round(decayed(F.col(score), F.col(date), current_year), 6))
    return running_total(aged, by, [F.col("decayed").desc(), F.col(tie)], F.lit(1).cast("long"), "decayed_rank")


def should_escalate(similarity: Column, has_p1: Column, least: float = 0.72, least_plain: float = 0.80) -> Column:
    return (similarity < least) | ((similarity < least_plain) & ~has_p1)

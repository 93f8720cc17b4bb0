"""The library's operators as SQL: table functions for chunking and search that queries call by LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql import types as T

from ..functions.text import BLANKS, CHARS_PER_TOKEN
from ..functions.stem import stem_sql
from .chunking import OVERLAP, SIZE, STRATEGIES, _packed, checked_step, windows
from .inverted_index import B, K1, InvertedIndex, search_index
from .search import vector_topk

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SECTION = re.compile(r"(?m)(?=^#{1,6}\s+\S)")
_HEADER = re.compile(r"^(#{1,6}\s+[^\n]+)")


def _fixed(text: str, size: int, overlap: float) -> list[tuple[str | None, str]]:
    return [(None, piece) for _, _, piece in windows(text, size, overlap)]


def _semantic(text: str, size: int, overlap: float) -> list[tuple[str | None, str]]:
    found = [s for s in (x.strip(BLANKS) for x in _SENTENCE.split(text)) if s]
    return [(None, c) for c in _packed(found, size * CHARS_PER_TOKEN, overlap)] if found else []


def _markdown(text: str, size: int, overlap: float) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for part in _SECTION.split(text):
        header = m[1] if (m := _HEADER.match(part)) else ""
        body = (re.sub(r"^#{1,6}\s+[^\n]+\n?", "", part) if header else part).strip(BLANKS)
        if body:
            whole = f"{header}\n{body}" if header else body
            out += [(header, whole)] if len(whole) <= size * CHARS_PER_TOKEN else [(header, piece) for _, _, piece in windows(whole, size, overlap)]
    return out


_CHUNKERS = {"fixed": _fixed, "semantic": _semantic, "markdown": _markdown}


class ChunkText:
    """``chunk_text(text, strategy, size, overlap)``: chunk_index, total_chunks, chunk, token_count, and header with ``markdown``.

    What the strategy is decides the columns, so it must be a constant; it is checked, as are size and overlap, before
    the query runs. A null text has no chunks.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("chunk_text takes a string")
        chosen = strategy.value if strategy is not None else "fixed"
        if chosen not in STRATEGIES:
            raise ValueError(f"unknown chunking strategy: {chosen}")
        checked_step(int(size.value) if size is not None else SIZE, float(overlap.value) if overlap is not None else OVERLAP)
        columns = [T.StructField("chunk_index", T.LongType()), T.StructField("total_chunks", T.LongType()), T.StructField("chunk", T.StringType()), T.StructField("token_count", T.LongType())]
        return AnalyzeResult(T.StructType(columns + [T.StructField("header", T.StringType())] * (chosen == "markdown")))

    def eval(self, text: str | None, strategy: str = "fixed", size: int = SIZE, overlap: float = OVERLAP) -> Iterator[tuple]:
        found = _CHUNKERS[strategy](text, int(size), float(overlap)) if text else []
        for i, (header, chunk) in enumerate(found):
            row = (i, len(found), chunk, max(1, len(chunk) // CHARS_PER_TOKEN))
            yield (*row, header) if strategy == "markdown" else row


def search_asked(
    spark: SparkSession, corpus: str, asked: DataFrame, match_threshold: float = 0.72, match_count: int = 5, filter_domain: str | None = None, filter_tier: str | None = None, filter_doc_type: str | None = None
) -> DataFrame:
    """What ``search_documents`` gives for each row of ``asked`` (query_id, embedding), with its query_id.

    LATERAL compares pair by pair and ranks whole rows; this compares blocks of queries and vectors by matrix products
    and ranks each batch's best. The attributes are joined for what is found only.
    """
    docs = spark.table(corpus).select("doc_id", "source_tier", "domain", "doc_type", "text", "embedding")
    for column, value in (("domain", filter_domain), ("source_tier", filter_tier), ("doc_type", filter_doc_type)):
        docs = docs if value is None else docs.where(F.col(column) == value)
    near = vector_topk(docs, asked.select("query_id", "embedding"), match_count, match_threshold, "doc_id").withColumnRenamed("vec_id", "doc_id")
    return near.join(docs.drop("embedding"), "doc_id").select("query_id", "doc_id", "source_tier", "domain", "doc_type", "text", "similarity")


def keyword_asked(index: InvertedIndex, asked: DataFrame, match_count: int = 5, filter_tier: str | None = None) -> DataFrame:
    """What ``keyword_search`` gives for each row of ``asked`` (query_id, query), with its query_id.

    LATERAL carries the query's text through every sum and ranks all documents of a query in one task; here sums stay
    in the document's bucket, and each bucket hands on its best.
    """
    found = search_index(index, asked.select("query_id", "query"), match_count, where=None if filter_tier is None else F.col("source_tier") == filter_tier)
    tiers = index.table("members").select("doc_id", "source_tier")
    return found.join(tiers, "doc_id").select("query_id", "doc_id", "source_tier", F.col("keyword_score").alias("score"))


def register(spark: SparkSession, corpus: str = "corpus", index: InvertedIndex | None = None) -> None:
    """Enters ``chunk_text``, ``search_documents`` and, over a stored word index, ``keyword_search``.

    ``corpus`` is a table or view with doc_id, source_tier, domain, doc_type, text and embedding; its vectors are
    compared one by one. ``search_documents(query_vector, match_threshold, match_count, filter_domain, filter_tier, filter_doc_type)`` gives doc_id, source_tier,
    domain, doc_type, text, similarity; ``keyword_search(search_query, match_count, filter_tier)`` gives doc_id,
    source_tier and score. Null filters let all pass; ties go to the smaller id. The search functions may be called with constants or, by LATERAL, with
    the columns of a small query table; ``search_asked`` and ``keyword_asked`` give the same for a table of any size. ``keyword_search`` scores by BM25 over stems, like ``search_index``, and reads
    the folders of the asked words; its index must keep source_tier.
    """
    spark.udtf.register("chunk_text", F.udtf(ChunkText))
    tier = spark.table(corpus).schema
    kinds = {c: tier[c].dataType.simpleString() for c in ("doc_id", "source_tier", "domain", "doc_type", "text")}
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_documents(query_vector ARRAY<FLOAT>, match_threshold DOUBLE DEFAULT 0.72, match_count INT DEFAULT 5,
            filter_domain STRING DEFAULT NULL, filter_tier STRING DEFAULT NULL, filter_doc_type STRING DEFAULT NULL)
        RETURNS TABLE ({', '.join(f'{c} {kinds[c]}' for c in kinds)}, similarity DOUBLE)
        RETURN SELECT {', '.join(kinds)}, similarity FROM (
            SELECT *, row_number() OVER (ORDER BY round(similarity, 12) DESC, doc_id) AS place FROM (
                SELECT {', '.join(kinds)}, {dot.format('embedding', 'search_documents.query_vector')}
                    / nullif(sqrt({dot.format('embedding', 'embedding')}) * sqrt({dot.format('search_documents.query_vector', 'search_documents.query_vector')}), 0D) AS similarity
                FROM {corpus}
                WHERE (search_documents.filter_domain IS NULL OR domain = search_documents.filter_domain)
                    AND (search_documents.filter_tier IS NULL OR source_tier = search_documents.filter_tier)
                    AND (search_documents.filter_doc_type IS NULL OR doc_type = search_documents.filter_doc_type))
            WHERE similarity >= search_documents.match_threshold)
        WHERE place <= search_documents.match_count"""
    )
    if index is not None:
        kind = index.id_type
        asked = f"explode(array_distinct(transform(regexp_extract_all(lower(keyword_search.search_query), '[\\\\p{{L}}\\\\p{{N}}]+', 0), term -> {stem_sql('term')})))"
        spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION keyword_search(search_query STRING, match_count INT DEFAULT 5, filter_tier STRING DEFAULT NULL)
            RETURNS TABLE (doc_id {kind}, source_tier STRING, score DOUBLE)
            RETURN SELECT doc_id, source_tier, score FROM (
                SELECT doc_id, source_tier, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (
                    SELECT p.doc_id, m.source_tier, round(sum(ln(1 + (n.docs - f.df + 0.5D) / (f.df + 0.5D)) * p.tf * {K1 + 1}D / (p.tf + {K1}D * ({1 - B}D + {B}D * p.dl / n.mean_dl))), 6) AS score
                    FROM (SELECT term, CAST(pmod(xxhash64(term), {index.folders}) AS INT) AS folder FROM (SELECT {asked} AS term)) q
                    JOIN (SELECT term, folder, sum(df) AS df FROM {index.name}_words GROUP BY term, folder) f ON q.term = f.term AND q.folder = f.folder
                    JOIN {index.name}_postings p ON q.term = p.term AND q.folder = p.folder
                    JOIN {index.name}_members m ON m.doc_id = p.doc_id
                    CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(dl) AS mean_dl FROM {index.name}_members WHERE dl > 0) n
                    WHERE keyword_search.filter_tier IS NULL OR m.source_tier = keyword_search.filter_tier
                    GROUP BY p.doc_id, m.source_tier))
            WHERE place <= keyword_search.match_count"""
        )

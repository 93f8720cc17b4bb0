"""What is said of retrieved chunks: citations, direct answers, contexts, rendered lists, parsed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, host, strip

ANSWER_WORDS, TABLE_WORDS = 150, 300
DIRECT_SIMILARITY = 0.85
#: The section of a report under a heading, up to the next heading.
SECTION = r"(?is)##\s*{}\s*\n(.*?)(?=\n##|\z)"
SECTIONS = {"summary": r"EXECUTIVE\s+SUMMARY", "findings": r"KEY\s+FINDINGS", "debates": r"ACTIVE\s+DEBATES?", "speculative": r"SPECULATIVE\s*(?:FINDINGS?)?"}


def word_list(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def chunk_citation(author: Column, arxiv: Column, domain: Column, tier: Column) -> Column:
    """``[Author yymm, Tier]`` with the start of an arXiv number, else ``[domain, Tier]``; blank parts have stand-ins."""
    name = strip(F.substring_index(author, ",", 1))
    stamp = F.left(arxiv, F.lit(4))
    place = F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown"))
    dated = author.isNotNull() & (F.coalesce(stamp, F.lit("")) != "")
    return F.concat(F.lit("["), F.when(dated, F.trim(F.concat_ws(" ", name, stamp))).otherwise(place), F.lit(", "), F.coalesce(F.nullif(tier, F.lit("")), F.lit("UNV")), F.lit("]"))


def source_citation(url: Column, tier: Column, author: Column) -> Column:
    """``[Author Year, Tier]`` with a year of this century found in the URL, else ``[host, Tier]``."""
    name = strip(F.substring_index(author, ",", 1))
    year = F.regexp_extract(F.coalesce(url, F.lit("")), r"(20\d{2})", 1)
    who = F.when(author.isNotNull(), F.concat(name, F.lit(" "), year)).otherwise(host(url))
    return F.concat(F.lit("["), who, F.lit(", "), tier, F.lit("]"))


def direct_answer(chunks: DataFrame, by: str = "query_id", order: str = "rank", least: float = DIRECT_SIMILARITY, most_words: int = ANSWER_WORDS) -> DataFrame:
    """(by, answer): the text of each list's first chunk with its citation, where it is similar enough.

    ``chunks`` has similarity, text, author, arxiv, domain, tier. A text of more than
    ``most_words`` words is cut to its first three sentences.
    """
    first = chunks.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("__n = 1").where(F.col("similarity") >= least)
    text = F.coalesce("text", F.lit(""))
    head = F.array_join(F.slice(F.split(text, r"\. "), 1, 3), ". ")
    closed = F.when(head.endswith("."), head).otherwise(F.concat(head, F.lit(".")))
    said = F.when(F.size(word_list(text)) > most_words, closed).otherwise(text)
    return first.select(by, F.concat_ws(" ", said, chunk_citation(F.col("author"), F.col("arxiv"), F.col("domain"), F.col("tier"))).alias("answer"))


def context(chunks: DataFrame, by: str = "query_id", order: str = "rank", most: int | None = None) -> DataFrame:
    """(by, context): the numbered, cited texts of each top-k list in order; ``most`` characters of it if set."""
    text = F.coalesce("text", F.lit(""))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    cite = chunk_citation(F.col("author"), F.col("arxiv"), F.col("domain"), F.col("tier"))
    part = F.concat(F.lit("[Source "), F.col("__n").cast("string"), F.lit(" "), cite, F.lit("]: "), text if most is None else F.left(text, F.lit(most)))
    listed = chunks.withColumn("__n", place).select(by, "__n", part.alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "part"))), lambda p: p["part"]), "\n\n")
    return listed.groupBy(by).agg((joined if most is None else F.left(joined, F.lit(most))).alias("context"))


def answers(chunks: DataFrame, queries: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, method, answer, token_count, mean_similarity) of every query (by, needs_table) when no model can be reached.

    A chunk that answers directly passes through; else the start of the context is
    given. A query without chunks gets an empty context.
    """
    most = F.when(F.col("needs_table"), TABLE_WORDS).otherwise(ANSWER_WORDS) * 4
    met = queries.join(direct_answer(chunks, by), by, "left").join(context(chunks, by, most=TABLE_WORDS * 4), by, "left").join(chunks.groupBy(by).agg(F.round(F.avg("similarity"), 6).alias("mean_similarity")), by, "left")
    direct = F.col("answer").isNotNull()
    said = F.when(direct, F.col("answer")).otherwise(F.left(F.coalesce("context", F.lit("")), most))
    return met.select(by, F.when(direct, "pass_through").otherwise("raw_context").alias("method"), said.alias("answer"), estimate_tokens(said).alias("token_count"), "mean_similarity")


def cap_words(text: Column, most: int = ANSWER_WORDS) -> Column:
    """A text of more than ``most`` tokens cut to ``most`` words, back to the last full stop if that is in the last 30 %."""
    head = F.array_join(F.slice(word_list(text), 1, most), " ")
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    snapped = F.when((F.instr(head, ".") > 0) & (stop - 1 > F.length(head) * 0.7), F.left(head, stop)).otherwise(head)
    return F.when(estimate_tokens(text) > most, snapped).otherwise(text)


def render(chunks: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """(by, rendered): each top-k list as numbered blocks of citation, title, source, tier, similarity and text."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    block = F.format_string(
        "--- Result %d %s ---\nTitle: %s\nSource: %s\nTier: %s | Similarity: %.3f\n\n%s\n",
        F.col("__n"), source_citation(F.col("url"), F.col("tier"), F.col("author")), F.coalesce("title", F.lit("")), F.col("url"), F.col("tier"), F.col("similarity"), F.coalesce("text", F.lit("")),
    )
    listed = chunks.withColumn("__n", place).select(by, "__n", block.alias("part"))
    return listed.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "part"))), lambda p: p["part"]), "\n").alias("rendered"))


def report_lines(reports: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, section, line_no, cells): what the four sections of a report hold.

    The summary is one line; findings are table rows of three cells or more, blank
    cells dropped; debates and speculative findings are lines that aren't headings.
    """
    parts = {name: F.regexp_extract(F.col(text), SECTION.format(title), 1) for name, title in SECTIONS.items()}
    split = reports.select(ident, *[p.alias(name) for name, p in parts.items()])
    lines = {name: F.filter(F.transform(F.split(strip(F.col(name)), "\n"), strip), lambda s: (s != "") & ~s.startswith("#")) for name in ("debates", "speculative")}
    rows = F.filter(F.split("findings", "\n"), lambda s: F.contains(s, F.lit("|")) & ~strip(s).startswith("|-") & ~strip(s).startswith("| Finding"))
    cells = F.filter(F.transform(rows, lambda s: F.filter(F.transform(F.split(s, r"\|"), strip), lambda c: c != "")), lambda c: F.size(c) >= 3)
    whole = F.filter(F.array(strip(F.col("summary"))), lambda s: s != "")

    def single(line: Column) -> Column:
        return F.array(line)

    every = {"summary": F.transform(whole, single), "findings": F.transform(cells, lambda c: F.slice(c, 1, 5)), **{n: F.transform(x, single) for n, x in lines.items()}}
    found = [split.select(ident, F.lit(name).alias("section"), F.posexplode(x).alias("line_no", "cells")) for name, x in every.items()]
    out = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return out.withColumn("line_no", F.col("line_no").cast("long"))


def gaps(text: Column, most: int = 3) -> Column:
    """Up to ``most`` items of a numbered or dashed list; items of ten characters or fewer don't count."""
    lines = F.transform(F.split(text, "\n"), strip)
    numbered = r"^\d+[.)]\s*(.+)$"
    items = F.transform(lines, lambda s: F.when(s.rlike(numbered), strip(F.regexp_extract(s, numbered, 1))).when(s.startswith("- ") & (F.length(s) > 12), strip(F.substring(s, 3, 1_000_000_000))))
    return F.slice(F.filter(items, lambda s: F.length(s) > 10), 1, most)


def claim_status(said: Column) -> Column:
    """The status that a free text names."""
    upper = F.translate(F.upper(said), "[]", "")
    return (
        F.when(F.contains(upper, F.lit("ESTABLISHED")), "ESTABLISHED").when(F.contains(upper, F.lit("TENTATIVE")), "TENTATIVE")
        .when(upper.rlike("DEBATE|CONTESTED"), "ACTIVE_DEBATE").when(F.contains(upper, F.lit("SPECULATIVE")), "SPECULATIVE").otherwise("UNVERIFIED")
    )


def ago(then: Column, as_of: Column) -> Column:
    """Time since in words: minutes under an hour, hours under a day, then days; halves round up."""
    seconds = as_of.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")
    minutes, hours = F.floor(seconds / 60 + 0.5), F.floor(seconds / 3600 + 0.5)

    def said(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""), F.lit(" ago"))

    return F.when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).otherwise(said(F.floor(hours / 24 + 0.5), "day"))


def resumption(summary: Column, last_query: Column, updated: Column, topics: Column, sources: Column, as_of: Column) -> Column:
    """The text that takes up a session again: what it was about, when, five topics, how many sources."""
    about = F.coalesce(F.nullif(summary, F.lit("")), last_query, F.lit(""))
    named = F.when(F.size(topics) > 0, F.concat(F.lit("Topics explored: "), F.array_join(F.slice(topics, 1, 5), ", "), F.lit("."))).otherwise("")
    seen = F.when(sources > 0, F.concat(sources.cast("string"), F.lit(" sources consulted."))).otherwise("")
    return F.concat(F.lit("Welcome back. Last time you were researching: "), about, F.lit(". "), ago(updated, as_of), F.lit(". "), named, F.lit(" "), seen, F.lit(" Here's where we left off..."))

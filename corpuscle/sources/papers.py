"""Recorded answers of paper archives as tables: Atom feeds, article summaries in JSON, abstracts in plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

ATOM = (
    "title string, author array<struct<name:string>>, summary string, published string, id string, category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>, broken string"
)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """(source_url, title, authors, abstract, published_date, categories, pdf_url, malformed): the entries of Atom feeds, one row each.

    Files are read by entry, whatever their size, and only the elements that a query takes are parsed. A missing title is "Untitled", line ends in it are blanks;
    authors and categories without a name go; a date is the first ten characters of ``published`` if they are one; the
    PDF link is the first link of that title, else empty. An entry that isn't well-formed is a row of its own with
    ``malformed`` set and no other value but the defaults; what stands outside entries is ignored.
    """
    rows = spark.read.format("xml").schema(ATOM).options(rowTag="entry", ignoreNamespace="true", mode="PERMISSIVE", columnNameOfCorruptRecord="broken").load(path)

    def named(column: str, field: str) -> Column:
        return F.filter(F.transform(F.coalesce(column, F.array()), lambda x: strip(x[field])), lambda x: x.isNotNull() & (x != ""))

    def or_empty(column: str) -> Column:
        return F.coalesce(strip(F.col(column)), F.lit(""))

    links = F.filter(F.coalesce("link", F.array()), lambda x: x["_title"] == "pdf")
    return rows.select(
        or_empty("id").alias("source_url"),
        F.coalesce(F.replace(strip(F.col("title")), F.lit("\n"), F.lit(" ")), F.lit("Untitled")).alias("title"),
        named("author", "name").alias("authors"),
        or_empty("summary").alias("abstract"),
        F.try_to_timestamp(F.left("published", F.lit(10)), F.lit("yyyy-MM-dd")).cast("date").alias("published_date"),
        named("category", "_term").alias("categories"),
        F.coalesce(F.get(links, F.lit(0))["_href"], F.lit("")).alias("pdf_url"),
        F.col("broken").isNotNull().alias("malformed"),
    )


def published(text: Column) -> Column:
    """The day of "2023 Dec 15", "2023 Dec" or "2023"; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(shape)) for shape in ("yyyy MMM d", "yyyy MMM", "yyyy")]).cast("date")


def article_summaries(answers: DataFrame, body: str = "body") -> DataFrame:
    """(pmid, title, authors, source_url, published_date, journal, doi) of recorded summary answers, one JSON object per row.

    ``result`` holds an object for each article beside their list; articles with an error, and answers that aren't JSON,
    have no row.
    """
    parsed = answers.select(F.try_parse_json(F.col(body)).alias("__v"))
    found = parsed.select(F.explode(F.from_json(F.to_json(F.try_variant_get("__v", "$.result", "variant")), "map<string,string>")).alias("pmid", "article")).where("pmid <> 'uids'")
    shape = "title string, authors array<struct<name:string>>, pubdate string, fulljournalname string, elocationid string, error string"
    rows = found.select("pmid", F.from_json("article", shape).alias("a")).where("a is not null and a.error is null")
    names = F.filter(F.transform(F.coalesce("a.authors", F.array()), lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    return rows.select(
        "pmid",
        F.coalesce("a.title", F.lit("Untitled")).alias("title"),
        names.alias("authors"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("source_url"),
        published(F.col("a.pubdate")).alias("published_date"),
        F.coalesce("a.fulljournalname", F.lit("")).alias("journal"),
        F.coalesce("a.elocationid", F.lit("")).alias("doi"),
    )


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, abstract) of recorded plain-text answers, in which a line ``PMID: number`` begins each record.

    Records are cut by the reader, so a file of any size is split among tasks. An abstract is the record's other lines,
    stripped, without blank lines and those that begin with ``DOI:``. Records without a number or without lines have no row.
    """
    rows = spark.read.option("lineSep", "\nPMID:").text(path)
    value = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), r"^PMID:", "")  # a file may begin with the mark
    pmid = F.regexp_extract("record", r"^\s*(\d+)", 1)
    raw = F.filter(F.slice(F.split("record", "\n"), 2, 1_000_000_000), lambda x: ~F.startswith(x, F.lit("DOI:")))
    kept = F.filter(F.transform(raw, strip), lambda x: x != "")
    out = rows.select(value.alias("record")).select(pmid.alias("pmid"), F.array_join(kept, "\n").alias("abstract"))
    return out.where("pmid <> '' and abstract <> ''").select("pmid", "abstract")

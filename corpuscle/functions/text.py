"""Text expressions: cleaning, tokens, sentences, hashes, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
WORD_SPLIT = r"[^\p{L}\p{N}]+"

#: Unicode's white space, as ``strip`` takes it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Boilerplate lines of scraped pages, and the elements that never hold a page's text.
BOILERPLATE = (
    r"Cookie\s+Policy",
    r"Accept\s+all\s+cookies",
    r"Sign\s+up\s+for[^\n]*?newsletter",
    r"Subscribe\s+to",
    r"Share\s+this\s+article",
    r"Related\s+articles?:",
    r"Comments?\s*\(\d+\)",
)
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "header")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def estimate_tokens(text: Column) -> Column:
    """One token per four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def ceil_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, stripped; empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def long_words(text: Column) -> Column:
    """Distinct words of four letters or more, what claims and sources are compared by."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= 4))


def clean_markdown(text: Column) -> Column:
    """Drops boilerplate up to the end of its line, collapses blank lines, strips."""
    out = reduce(lambda t, p: F.regexp_replace(t, rf"(?i){p}[^\n]*\n", ""), BOILERPLATE, F.coalesce(text, F.lit("")))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip_html(html: Column) -> Column:
    """Tags out, the common entities decoded, white space collapsed."""
    out = reduce(lambda t, e: F.regexp_replace(t, rf"(?is)<{e}[\s\S]*?</{e}>", ""), DROPPED_ELEMENTS, F.coalesce(html, F.lit("")))
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([\s\S]*?)</title>", 1))


def slugify(title: Column, limit: int = 80) -> Column:
    """Lower-case words joined by single hyphens."""
    kept = F.regexp_replace(F.trim(F.lower(title)), r"(?U)[^\w\s-]", "")
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-+", "-"), 1, limit), F.lit("-"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_key(query: Column, mode: Column, tier: Column) -> Column:
    return F.sha2(F.concat_ws("|", strip(F.lower(query)), mode, tier), 256)


def claim_key(claim: Column) -> Column:
    return F.sha2(strip(F.lower(claim)), 256)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def base_domain(name: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(name, ".", -2)


def cut_to_budget(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, back to the last full stop if that is in the last fifth."""
    head = F.substring(text, 1, limit)
    dot = limit - F.instr(F.reverse(head), ".") + 1
    snapped = F.when((F.instr(head, ".") > 0) & (dot - 1 > limit * 0.8), F.left(head, dot)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(snapped)


def arxiv_id(text: Column) -> Column:
    """The paper number in a URL or an ``arXiv:`` mark, or a bare number; null if none."""
    found = [
        F.regexp_extract(text, r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})", 1),
        F.regexp_extract(text, r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5})", 1),
        F.regexp_extract(text, r"^([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1),
    ]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def clean_pages(text: Column) -> Column:
    """Text of scanned pages: form feeds as line ends, hyphens at line ends joined, blank lines collapsed."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n")), r"(?U)-\n(\w)", "$1"), r"\n{3,}", "\n\n")

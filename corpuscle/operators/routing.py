"""Query routing by rules, and the choice of a model chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Word lists and patterns of the rules.
LIVE = r"\b(latest|today|breaking|just announced|yesterday|this week|this month|current|now|recent|update)\b"
KNOWN_SOURCES = sorted("arxiv pubmed nature science nejm lancet acm ieee springer wiley semanticscholar openreview biorxiv medrxiv".split())
RESEARCH = (
    r"\b(rag|retrieval.augmented|vector.search|embedding|transformer|language.model|llm|gpt|bert|fine.tun|prompt.engineer|"
    r"attention.mechanism|neural.network|deep.learning)\b"
)
TEMPORAL = "latest|recent|today|yesterday|this week|this month|this year|current|now|2024|2025|2026|breaking|update|new".split("|")
ACADEMIC = "paper study research arxiv pubmed doi citation journal conference preprint thesis dissertation methodology findings abstract peer-reviewed".split()
CLINICAL = "clinical trial|treatment|diagnosis|prognosis|side effects|fda|drug|therapy|patient|randomized|cochrane".split("|")
TABLE = r"\b(compare|vs|versus|differences?|types|methods|approaches|alternatives|options|rankings?)\b"
COMPARED = r"\b(effective|efficacy|safety|treatment|therapy|outcome|compared to|versus|vs|in patients with|for the treatment of)\b"


def classify(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with route, domain_hint, confidence and method by whole-word rules.

    Of several known names in a query the alphabetically first is the hint.
    """
    low = F.lower(F.col(query))
    known = F.get(F.filter(F.array(*map(F.lit, KNOWN_SOURCES)), lambda d: F.contains(low, d)), F.lit(0))
    live = low.rlike(LIVE)
    confidence = F.when(live, 0.9).when(known.isNotNull(), 0.85).when(low.rlike(RESEARCH), 0.75).otherwise(0.5)
    return queries.withColumns(
        {
            "route": F.when(live, "live").otherwise("rag"),
            "domain_hint": F.when(~live, known),
            "confidence": confidence,
            "method": F.lit("rules"),
        }
    )


def _any(low: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda w: F.contains(low, w))


def classify_by_substring(queries: DataFrame, query: str = "query") -> DataFrame:
    """The other rule set: substrings, so that words inside words count too; short queries go to the corpus."""
    low = F.lower(F.col(query))
    few = F.size(F.split(strip(F.col(query)), r"\s+")) <= 4
    live, academic, clinical = _any(low, TEMPORAL), _any(low, ACADEMIC), _any(low, CLINICAL)
    return queries.withColumns(
        {
            "route": F.when(live, "live").otherwise("rag"),
            "domain_hint": F.when(live, "").when(academic, "academic").when(clinical, "clinical").otherwise(""),
            "confidence": F.when(live, 0.9).when(academic | clinical, 0.85).when(few, 0.7).otherwise(0.5),
        }
    )


def decide(classified: DataFrame, similarity: str = "similarity", least: float = 0.72, sure: float = 0.6) -> DataFrame:
    """``classified`` after the similarity check; without a model an unsure query stays with the corpus at .8."""
    far = F.col(similarity) < least
    unsure = F.col("confidence") < sure
    return classified.withColumns(
        {
            "final_route": F.when(far, "live").when(unsure, "rag").otherwise(F.col("route")),
            "final_confidence": F.when(far, 0.95).when(unsure, 0.8).otherwise(F.col("confidence")),
            "final_method": F.when(far, "similarity").when(unsure, "llm").otherwise("rules"),
        }
    )


def needs_table(query: Column, domains: Column) -> Column:
    """Comparing words in the query, or results from three domains or more."""
    return F.lower(query).rlike(TABLE) | (domains >= 3)


def needs_decomposition(query: Column) -> Column:
    low = F.lower(query)
    long_ = F.size(F.split(strip(query), r"\s+")) >= 8
    return long_ & (low.rlike(COMPARED) | F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(" or ")))


def model_tier(similarity: Column, table: Column, classification: Column) -> Column:
    """Which models may be asked: none (pass-through), cheap, cheap and mid, mid and capable, or all."""
    return (
        F.when(classification, "cheap")
        .when(similarity > 0.85, "passthrough")
        .when(table, "mid,capable")
        .when(similarity < 0.72, "cheap,mid,capable")
        .otherwise("cheap,mid")
    )


def model_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call, with prices by million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


@dataclass(frozen=True)
class Model:
    """A model of the chain; the first one of a chain is the pass-through."""

    name: str
    tier: str
    enabled: bool = True


def model_chain(models: list[Model], similarity: Column, table: Column, classification: Column, forced: Column) -> Column:
    """Names of the models to try, in order, as an array.

    A forced model goes alone, or the pass-through if it can't be had. Where no
    enabled model is of the tiers wanted, a range of the enabled ones is tried.
    Null similarity means an ordinary query. The chain is configuration, a few
    models by nature.
    """
    usable = [m for m in models if m.enabled]

    def names(chosen: list[Model]) -> Column:
        return F.array(*[F.lit(m.name) for m in chosen]).cast("array<string>")

    def of(tiers: set[str], start: int, stop: int | None = None, limit: int | None = None) -> Column:
        return names([m for m in usable if m.tier in tiers][:limit] or usable[start:stop])

    first = names(models[:1])
    return (
        F.when(forced != "", F.when(forced.isin(*[m.name for m in usable]), F.array(forced)).otherwise(first))
        .when(classification, of({"cheap", "free"}, 1, 3, 3))
        .when(similarity > 0.85, first)
        .when(table, of({"mid", "capable", "cloud"}, 3))
        .when(similarity < 0.72, names(usable))
        .otherwise(of({"cheap", "mid", "free"}, 1, 6))
    )

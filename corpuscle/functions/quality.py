"""Source quality: tiers, trust, age, suspicious hosts, injected instructions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host

# Domains by tier, by trust, and the patterns of unsafe sources.
TIER_DOMAINS = {
    "P1": (
        "arxiv.org pubmed.ncbi.nlm.nih.gov ncbi.nlm.nih.gov nejm.org nature.com science.org lancet.com cell.com pnas.org bmj.com who.int cdc.gov nih.gov fda.gov "
        "sec.gov eur-lex.europa.eu gov.uk doi.org dl.acm.org ieeexplore.ieee.org jmlr.org aclanthology.org openreview.net biorxiv.org medrxiv.org chemrxiv.org "
        "springer.com wiley.com oxfordacademic.com cambridge.org plos.org"
    ).split(),
    "P2": (
        "reuters.com bloomberg.com economist.com ft.com wsj.com nytimes.com bbc.com apa.org ieee.org acm.org mit.edu stanford.edu harvard.edu semanticscholar.org "
        "openalex.org clinicaltrials.gov cochrane.org ourworldindata.org pewresearch.org nber.org ssrn.com hbr.org mckinsey.com"
    ).split(),
    "P3": (
        "medium.com towardsdatascience.com wikipedia.org wikidata.org stackoverflow.com github.com reddit.com hackernews.com youtube.com substack.com quora.com "
        "researchgate.net academia.edu"
    ).split(),
}
TRUST_DOMAINS = {
    "verified": (
        "arxiv.org pubmed.ncbi.nlm.nih.gov nature.com science.org nejm.org lancet.com dl.acm.org ieee.org springer.com wiley.com semanticscholar.org openreview.net "
        "biorxiv.org medrxiv.org"
    ).split(),
    "internal": "nih.gov nasa.gov cdc.gov who.int nist.gov gov.uk gov.cn europa.eu oecd.org worldbank.org".split(),
    "partner": "reuters.com apnews.com bbc.com nytimes.com".split(),
    "external": "medium.com substack.com wikipedia.org stackoverflow.com reddit.com twitter.com x.com youtube.com".split(),
}
TRUST_TIER = {"verified": "P1", "internal": "P2", "external": "P3"}
SUSPICIOUS = (r"\.xyz$", r"\.tk$", r"\.ml$", r"\.ga$", r"\.cf$", "free-", "cheap-", "discount", "-review", "-scam")
INJECTIONS = (
    (r"ignore\s+(all\s+)?previous\s+(instructions?|prompts?)", "instruction_override"),
    (r"forget\s+(all\s+)?previous\s+(instructions?|context)", "instruction_override"),
    (r"you\s+are\s+now\s+(?:a\s+)?(?:different|new|evil|malicious)", "role_hijack"),
    (r"system\s*:\s*", "system_prompt_injection"),
    (r"<\|im_start\|>", "token_injection"),
    (r"\[INST\]", "token_injection"),
    (r"```system", "code_block_injection"),
    (r"(?:exfiltrate|extract|send|transmit|upload)\s+(?:the\s+)?(?:data|information|secrets?|keys?|passwords?)", "data_exfiltration"),
    (r"(?:curl|wget|fetch|http\.get|axios)\s*\(", "network_request_injection"),
    (r"eval\s*\(|Function\s*\(|setTimeout\s*\(\s*['\"]", "code_execution_injection"),
    (r"process\.env|import\s+os|require\s*\(\s*['\"]child_process", "environment_access"),
    (r"/etc/passwd|/proc/self|\\windows\\system", "file_system_access"),
)
MULTIPLIERS = {"P1": 1.5, "P2": 1.2, "P3": 1.0, "UNV": 0.3}
TIER_ORDER = {"P1": 0, "P2": 1, "P3": 2, "UNV": 3}


def tier_order(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(o)) for t, o in TIER_ORDER.items()], F.lit(4))


def _listed(name: Column, domains: dict[str, list[str]]) -> Column:
    """The class of the longest listed domain that is ``name`` or a parent of it; else null."""
    table = F.create_map(*[F.lit(x) for c, names in domains.items() for d in names for x in (d, c)])
    parts = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.get(F.filter(F.transform(parents, lambda p: F.try_element_at(table, p)), lambda t: t.isNotNull()), F.lit(0))


def source_tier(url: Column, current: Column) -> Column:
    """The tier that a URL's domain has by list; else the one it comes with."""
    return F.coalesce(_listed(host(url), TIER_DOMAINS), current)


# The short list of the narrow tier rule.
NARROW_TIERS = {
    "P1": "arxiv.org pubmed.ncbi.nlm.nih.gov nature.com science.org nejm.org lancet.com dl.acm.org ieee.org springer.com wiley.com semanticscholar.org openreview.net biorxiv.org medrxiv.org".split(),
    "P2": "nih.gov nasa.gov cdc.gov who.int nist.gov gov.uk".split(),
    "P3": "medium.com substack.com wikipedia.org stackoverflow.com reddit.com".split(),
}


def source_tier_narrow(url: Column, current: Column) -> Column:
    """The first tier whose short list holds the URL's domain; P2 for academic ones; else the one it comes with."""
    name = host(url)
    out = F.when(F.lit(False), current)
    for tier, domains in NARROW_TIERS.items():
        out = out.when(name.rlike(r"(^|\.)(" + "|".join(domains).replace(".", r"\.") + ")$"), tier)
    return out.when(name.rlike(r"\.(edu|ac\.uk|ac\.jp)$"), "P2").otherwise(current)


def trust_tier(url: Column, content: Column, safe_before: Column | None = None) -> Column:
    """Trust by listed domain, kind of domain, marks in the content, then earlier safe sources of the domain."""
    name = host(url)
    academic = F.substring(content, 1, 2000).rlike("(?i)doi:|arxiv:|pmid:|isbn:")
    references = F.substring(content, 1, 5000).rlike("(?i)references|bibliography|cited by")
    reviewed = F.substring(content, 1, 3000).rlike("(?i)peer.?reviewed|accepted for publication|journal of")
    out = (
        F.when(name.rlike(r"\.(edu|ac\.uk|ac\.jp|ac\.de)$"), "verified")
        .when(name.rlike(r"\.gov(\.uk|\.cn)?$"), "internal")
        .when(name.endswith(".org"), "external")
        .when(academic & reviewed, "verified")
        .when(references & academic, "internal")
        .when(references, "external")
    )
    if safe_before is not None:
        out = out.when(safe_before > 3, "partner")
    return F.coalesce(_listed(name, TRUST_DOMAINS), out.otherwise("untrusted"))


def trust_to_tier(trust: Column) -> Column:
    return F.coalesce(*[F.when(trust == a, F.lit(b)) for a, b in TRUST_TIER.items()], F.lit("UNV"))


def is_suspicious(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(SUSPICIOUS))


def injections(content: Column) -> Column:
    """Kinds of instruction patterns that the content holds, in list order, repeats kept."""
    return F.array_compact(F.array(*[F.when(content.rlike(f"(?i){p}"), F.lit(k)) for p, k in INJECTIONS]))


def safety_score(content: Column, name: Column, scanned: bool = False) -> Column:
    """1, less .3 for each kind of instruction, .1 for over 500,000 characters, .2 for a suspicious host.

    Without a scanning model, a text of over 200 characters that still has over .5
    loses .2 more (``scanned`` is False): an unavailable scanner counts as a threat.
    """
    score = 1.0 - 0.3 * F.size(injections(content)) - F.when(F.length(content) > 500_000, 0.1).otherwise(0.0) - F.when(is_suspicious(name), 0.2).otherwise(0.0)
    if not scanned:
        score = score - F.when((score > 0.5) & (F.length(content) > 200), 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def decayed(score: Column, published: Column, current_year: int) -> Column:
    """The score times .95 for each year of age; times .9 where the date names no year after 1900."""
    year = F.expr("null").cast("int") if published is None else F.substring(published.cast("string"), 1, 4).try_cast("int")
    age = F.greatest(F.lit(0), F.lit(current_year) - year)
    return F.when(year > 1900, score * F.pow(F.lit(0.95), age)).otherwise(score * 0.9)


def tier_boost(tier: Column, any_p1: Column, counter_evidence: Column | None = None) -> Column:
    """Multipliers of a result set: in force only where it holds a P1 source."""
    third = F.lit(0.5) if counter_evidence is None else F.when(counter_evidence, 1.0).otherwise(0.5)
    return F.when(~any_p1, 1.0).when(tier == "P1", 1.5).when(tier == "P3", third).when(tier == "UNV", 0.3).otherwise(1.0)


def corpus_tier(source: Column) -> Column:
    """Tier of a numbered source of the local corpus."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).cast("int") % 4
    return F.when(number == 0, "P1").when(number == 1, "P2").when(number == 2, "P3").otherwise("UNV")



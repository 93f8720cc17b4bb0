"""Claims: extraction, citations, and verification against sources."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_words, sentences, strip

# Patterns of claims and citations, signs of conflict and of support.
CLAIM_WORDS = (
    r"(?i)\b(found|showed|demonstrated|indicates|suggests|reveals|proves|confirmed|associated with|linked to|increases?|decreases?|improves?|reduces?|"
    r"prevents?|causes?|\d+%|\d+ percent|significant|effective|ineffective)\b"
)
FACTS = (
    r"\d+\.?\d*%",
    r"\$[\d,]+\.?\d*",
    r"\d{4}",
    r"(?i)(?:increased|decreased|improved|reduced|achieved|found|showed|demonstrated)\s",
    r"\d+x\b",
)
CITATION = r"\[([^\]]+?),\s*(P[123]|UNV)\]|\[UNVERIFIED\]"
AGAINST = (
    "does not|did not|no evidence|not associated|contradicts|refutes|fails to|unable to replicate|not supported|disputed|controversial|debated|however,|in contrast,|conversely,"
).split("|")
FOR = (
    "found that|shows that|demonstrated|confirmed|evidence suggests|results indicate|significantly|associated with|linked to|supports|proves|established|meta-analysis|systematic review"
).split("|")


def extract_claims(sources: DataFrame, by: str, order: str, text: str = "snippet", per_source: int = 10, most: int = 15) -> DataFrame:
    """(by, claim_no, claim): sentences that assert something, of the first sources of each set, each claim once."""
    place = Window.partitionBy(by).orderBy(order)
    first = sources.withColumn("__n", F.row_number().over(place)).where(f"__n <= {per_source}").where(F.length(text) >= 50)
    flat = first.select(by, F.col("__n").alias("source_no"), F.posexplode(sentences(F.col(text))).alias("sentence_no", "claim"))
    fits = flat.where((F.length("claim") > 20) & F.col("claim").rlike(CLAIM_WORDS))
    once = fits.groupBy(by, "claim").agg(F.min(F.struct("source_no", "sentence_no")).alias("at"))
    numbered = once.withColumn("claim_no", F.row_number().over(Window.partitionBy(by).orderBy("at")).cast("long"))
    return numbered.where(F.col("claim_no") <= most).select(by, "claim_no", "claim")


def _holds(text: Column, signs: list[str]) -> Column:
    return reduce(lambda a, s: a | F.contains(text, F.lit(s)), signs, F.lit(False))


def match_sources(claims: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, claim_no, url, tier, base_domain, overlap, supports, conflicts): sources that share a claim's words.

    Sources have ``by``, url, tier, base_domain, title, snippet. Claim and source
    words are joined by word, so a pair costs its common words and never a
    product of all claims with all sources.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    c = claims.withColumn("terms", long_words(F.col("claim")))
    c = c.withColumn("n_terms", F.greatest(F.lit(1), F.size("terms"))).select(by, "claim_no", "n_terms", F.explode("terms").alias("term"))
    s = sources.select(by, "url", "tier", "base_domain", text.alias("text"))
    s = s.withColumns({"negative": _holds(F.col("text"), AGAINST), "positive": _holds(F.col("text"), FOR), "terms": long_words(F.col("text"))})
    s = s.select(by, "url", "tier", "base_domain", "negative", "positive", F.explode("terms").alias("term"))
    common = c.join(s, [by, "term"]).groupBy(by, "claim_no", "n_terms", "url", "tier", "base_domain", "negative", "positive").agg(F.count(F.lit(1)).alias("common"))
    ratio = F.col("common") / F.col("n_terms")
    conflicts = F.col("negative") & (ratio > 0.4)
    return common.where(ratio >= 0.3).select(
        by, "claim_no", "url", "tier", "base_domain", F.round(ratio, 6).alias("overlap"),
        (~conflicts & (F.col("positive") | (ratio > 0.5))).alias("supports"), conflicts.alias("conflicts"),
    )


def independent_counts(supporting: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, independent): how many sources of each group are independent, taken greedily in order of source_no.

    A source counts if it has neither the base domain nor an author of one that has counted before; no domain and no
    authors are shared by none. Rows are sorted by group and order and folded one by one; a task holds the domains and
    authors that count in one group, never the group. Ties of source_no go by domain.
    """
    slim = supporting.select(*keys, F.coalesce("base_domain", F.lit("")).alias("base_domain"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "source_no")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    count = len(keys)

    def fold(batches):
        group, domains, authors, n, types = None, set(), set(), 0, []
        for batch in batches:
            types = [f.type for f in batch.schema][:count]
            done = []
            for *key, domain, names, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group:
                    if group is not None:
                        done.append((*group, n))
                    group, domains, authors, n = key, set(), set(), 0
                own = {a for a in names if a}
                if domain not in domains and not own & authors:
                    n += 1
                    authors |= own
                    domains |= {domain} - {""}
            yield counted(done, types)
        if group is not None:
            yield counted([(*group, n)], types)

    def counted(done, types):
        columns = list(zip(*done)) or [()] * (count + 1)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns[:count], types), pa.array(columns[count], pa.int64())], names=[*keys, "independent"])

    ordered = slim.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "source_no", "base_domain")
    return ordered.mapInArrow(fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", independent long")


def verify_claims(claims: DataFrame, sources: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, claim_no, claim, status, confidence, evidence, supporting, conflicting, independent) of every claim.

    Sources are independent if their base domains differ; one without a domain always is. If ``sources`` has
    ``authors`` (a list) and ``source_no``, ``independent_counts`` decides, so that sources of one author count once.
    """
    met = match_sources(claims, sources, by)
    good = F.col("supports")
    named = good & (F.col("base_domain") != "")
    counts = met.groupBy(by, "claim_no").agg(
        F.count_if(good).alias("supporting"),
        F.count_if("conflicts").alias("conflicting"),
        F.count_if(good & F.col("tier").isin("P1", "P2")).alias("strong"),
        F.count_if(good & (F.col("tier") == "P1")).alias("first"),
        (F.count_distinct(F.when(named, F.col("base_domain"))) + F.count_if(good & (F.col("base_domain") == ""))).alias("independent"),
    )
    if "authors" in sources.columns:
        named = sources.select(by, "url", "authors", "source_no").dropDuplicates([by, "url"])
        told = met.where(good).join(named, [by, "url"]).select(by, "claim_no", "base_domain", "authors", "source_no")
        counts = counts.drop("independent").join(independent_counts(told, [by, "claim_no"]), [by, "claim_no"], "left")
    n = ["supporting", "conflicting", "strong", "first", "independent"]
    full = claims.join(counts, [by, "claim_no"], "left").fillna(0, n)
    sup, con, strong, ind = (F.col(x) for x in ("supporting", "conflicting", "strong", "independent"))
    both = (ind >= 2) & (strong >= 1)
    status = (
        F.when(both, "ESTABLISHED").when((con > 0) & (sup > 0), "ACTIVE_DEBATE").when((sup > 0) & (ind >= 2), "ESTABLISHED")
        .when(sup > 0, "TENTATIVE").when(con > 0, "ACTIVE_DEBATE").otherwise("UNVERIFIED")
    )
    confidence = (
        F.when(both, F.least(F.lit(0.95), 0.5 + 0.15 * ind)).when((con > 0) & (sup > 0), 0.3).when((sup > 0) & (ind >= 2), 0.7)
        .when((sup > 0) & (strong > 0), 0.5).when(sup > 0, 0.3).when(con > 0, 0.2).otherwise(0.0)
    )
    evidence = F.when(F.col("first") > 0, "peer-reviewed").when(sup > 0, "observation").otherwise("")
    return full.select(by, "claim_no", "claim", status.alias("status"), F.round(confidence, 2).alias("confidence"), evidence.alias("evidence"), "supporting", "conflicting", "independent")


def verification_summary(verified: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, claims, established, tentative, debated, unverified)."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return verified.groupBy(by).agg(
        F.count(F.lit(1)).alias("claims"), n("ESTABLISHED").alias("established"), n("TENTATIVE").alias("tentative"), n("ACTIVE_DEBATE").alias("debated"), n("UNVERIFIED").alias("unverified")
    )


def extract_citations(texts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, citation_no, source, tier) of every citation, in order; unverified marks have the tier UNV."""
    every = F.regexp_extract_all(F.col(text), F.lit(f"({CITATION})"), F.lit(1))
    flat = texts.select(ident, F.posexplode(every).alias("citation_no", "c"))
    plain = F.col("c") == "[UNVERIFIED]"
    return flat.select(
        ident,
        F.col("citation_no").cast("long").alias("citation_no"),
        F.when(plain, "UNVERIFIED").otherwise(F.regexp_extract("c", CITATION, 1)).alias("source"),
        F.when(plain, "UNV").otherwise(F.regexp_extract("c", CITATION, 2)).alias("tier"),
    )


def is_fact(sentence: Column) -> Column:
    return reduce(lambda a, p: a | sentence.rlike(p), FACTS[1:], sentence.rlike(FACTS[0]))


def citation_audit(texts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, claims, cited, uncited, is_valid, corrected): factual sentences without a citation get a mark."""
    parts = sentences(F.col(text))
    facts = F.filter("__s", is_fact)
    bare = F.filter("__f", lambda s: ~s.rlike(CITATION))

    def mark(t: Column, s: Column) -> Column:
        at = F.position(s, t)
        new = F.when(s.endswith("."), F.concat(F.left(s, F.length(s) - 1), F.lit(" [UNVERIFIED]."))).otherwise(F.concat(s, F.lit(" [UNVERIFIED]")))
        return F.when(at > 0, F.concat(F.left(t, at - 1), new, F.substring(t, at + F.length(s), F.length(t)))).otherwise(t)

    made = texts.withColumn("__s", parts).withColumn("__f", facts).withColumn("__b", bare)
    return made.select(
        ident,
        F.size("__f").cast("long").alias("claims"),
        (F.size("__f") - F.size("__b")).cast("long").alias("cited"),
        F.size("__b").cast("long").alias("uncited"),
        (F.size("__b") == 0).alias("is_valid"),
        F.aggregate("__b", F.col(text), mark).alias("corrected"),
    )


def format_citation(author: Column, year: Column, domain: Column, tier: Column) -> Column:
    """``[Author Year, Tier]``, or the domain where no author is known."""
    name = strip(F.substring_index(author, ",", 1))
    known = author.isNotNull() & (name != "")
    return F.concat(F.lit("["), F.when(known, F.concat_ws(" ", name, year)).otherwise(domain), F.lit(", "), tier, F.lit("]"))


# Verbs of statements about causes, findings and relations.
CAUSAL = (
    r"causes?|leads? to|results? in|increases?|decreases?|improves?|reduces?|prevents?|enhances?",
    r"found that|showed that|demonstrated that|revealed that|indicates? that|suggests? that",
    r"is associated with|is correlated with|is linked to|predicts?",
)


def extract_statements(sources: DataFrame, by: str, order: str, text: str = "snippet", most: int = 20) -> DataFrame:
    """(by, claim_no, claim, evidence): sentences with a causal verb that another sentence follows, each once.

    A sentence ends at a full stop, and the one that follows a statement isn't judged
    for the same group of verbs. Statements have 21 to 299 characters; the first
    ``most`` of a set count, and a source of tier P1 makes them experimental. ``order``
    tells the sources of a set apart.
    """
    pieces = F.split(F.col(text), r"\.")
    cut = sources.select(by, order, "tier", F.size(pieces).alias("pieces"), F.posexplode(pieces).alias("i", "s")).where("i + 2 < pieces")
    kinds = F.array_compact(F.array(*[F.when(F.col("s").rlike(f"(?i){verbs}"), F.lit(k)) for k, verbs in enumerate(CAUSAL)]))
    held = cut.select(by, order, "tier", "i", strip(F.concat("s", F.lit("."))).alias("claim"), F.explode(kinds).alias("kind"))
    source = Window.partitionBy(by, order, "kind")
    runs = held.withColumn("run", F.col("i") - F.row_number().over(source.orderBy("i")))  # neighbours that follow each other
    first = F.min("i").over(Window.partitionBy(by, order, "kind", "run"))
    flat = runs.withColumn("first", first).where("(i - first) % 2 = 0").withColumn("n", F.struct("kind", "i")).where((F.length("claim") > 20) & (F.length("claim") < 300))
    once = flat.groupBy(by, "claim").agg(F.min(F.struct(order, "n", "tier")).alias("at"))
    place = Window.partitionBy(by).orderBy("at")
    first = once.withColumn("claim_no", F.row_number().over(place)).where(F.col("claim_no") <= most)
    return first.select(by, F.col("claim_no").cast("long").alias("claim_no"), "claim", F.when(F.col("at.tier") == "P1", "experimental").otherwise("unknown").alias("evidence"))


def count_support(claims: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, claim_no, supporting, status, confidence): how many sources of a set hold a claim's first 50 characters.

    A source whose words are over .6 the same counts too. A set has few claims
    (``extract_statements``), so its sources are read once for each of them; their words are split once for all.
    """
    start = F.lower(F.left("claim", F.lit(50)))
    low = F.lower(F.coalesce("snippet", F.lit("")))
    # 50 characters are 51 words at most, so no source of 85 or more distinct words is over .6 the same.
    split = sources.select(by, low.alias("low")).withColumn("a", F.array_distinct(F.split("low", r"(?U)\s+"))).withColumn("a", F.when(F.size("a") < 85, F.col("a")))
    starts = claims.select(by, "claim_no", start.alias("start")).withColumn("b", F.split("start", r"(?U)\s+"))
    met = starts.join(split, by)
    alike = F.coalesce(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")) > 0.6, F.lit(False))
    counts = met.groupBy(by, "claim_no").agg(F.count_if(F.contains("low", F.col("start")) | alike).alias("supporting"))
    first = sources.groupBy(by).agg(F.bool_or(F.col("tier") == "P1").alias("any_p1"))
    n = F.col("supporting")
    status = F.when(n >= 3, "ESTABLISHED").when(n == 2, "TENTATIVE").when(n == 1, "SPECULATIVE").otherwise("UNVERIFIED")
    sure = F.when(n >= 3, 0.85).when(n == 2, 0.65).otherwise(0.3)
    raised = F.when(F.col("any_p1") & (n > 0), F.least(sure + 0.1, F.lit(0.95))).otherwise(sure)
    return counts.join(first, by).select(by, "claim_no", "supporting", status.alias("status"), F.round(raised, 2).alias("confidence"))

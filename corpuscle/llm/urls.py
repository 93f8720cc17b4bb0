"""URL filters: explicit host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, without

#: Labelled rows that teach the trees at most; the suffix statistics count all rows.
TRAIN_ROWS = 20_000
#: Suffix statistics of more rows are not broadcast but joined by suffix and salt.
BROADCAST_ROWS = 4 * TRAIN_ROWS
SALTS = 16
TREES, DEPTH = 12, 4
#: Words of a host name that label a URL as unwanted when no labelled table is given.
BAD_WORDS = (
    "casino bet bets betting poker slots jackpot lottery pills pharma viagra cialis cheap adult xxx porn sex escort "
    "dating spam ads adserver track tracker popunder clickbait torrent warez crack keygen loan payday replica"
).split()
FEATURES = (
    "url_chars host_chars path_chars depth host_labels host_hyphens host_digits url_digits host_entropy path_entropy "
    "params param_chars secure plain_ip suffix_rate suffix_known"
).split()


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path, as in ``example.net/en/``; ``allow`` is the verdict."""

    pattern: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The pattern of the longest rule that fits, else null. Rules are configuration, a few by nature."""
    order = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    return F.coalesce(*[F.when(r.fits(host, path), F.lit(r.pattern)) for r in order], F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits per character; 0 if empty. Costs the text once per distinct character."""
    chars = F.split(text, "")
    n = F.length(text)

    def part(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    bits = F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, bits).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def suffixes(host: Column) -> list[Column]:
    """The host and its last three, two and one labels."""
    return [host, *(F.substring_index(host, ".", -k) for k in (3, 2, 1))]


def with_lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the lexical features in columns of FEATURES (without the suffix statistics)."""
    u, h, p, q = (F.col(c) for c in ("__url", "__host", "__path", "__query"))
    return (
        without(urls, *FEATURES, "__url", "__host", "__path", "__query")
        .withColumn("__url", F.coalesce(F.col(url), F.lit("")))
        .withColumns({"__host": host_of(u), "__path": path_of(u), "__query": F.regexp_extract(u, r"(?s)\?([^#]*)", 1)})
        .withColumns(
            {
                "url_chars": F.length(u).cast("double"),
                "host_chars": F.length(h).cast("double"),
                "path_chars": F.length(p).cast("double"),
                "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")).cast("double"),
                "host_labels": F.size(F.split(h, r"\.")).cast("double"),
                "host_hyphens": (F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit("")))).cast("double"),
                "host_digits": _share(h, "[0-9]+"),
                "url_digits": _share(u, "[0-9]+"),
                "host_entropy": entropy(h),
                "path_entropy": entropy(p),
                "params": F.size(F.filter(F.split(q, "&"), lambda x: x != "")).cast("double"),
                "param_chars": F.length(q).cast("double"),
                "secure": ascii_lower(u).startswith("https:").cast("double"),
                "plain_ip": h.rlike(r"^[0-9.]+(:[0-9]+)?$").cast("double"),
            }
        )
        .drop("__url", "__path", "__query")
    )


def label_by_words(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, label): 1.0 if a word of the host is one of BAD_WORDS. The labelled table where none is at hand."""
    words = F.split(host_of(F.col(url)), "[^a-z0-9]+")
    return urls.select(F.col(url).alias("url"), F.arrays_overlap(words, F.array(*map(F.lit, BAD_WORDS))).cast("double").alias("label"))


@dataclass
class UrlModel:
    """Fitted trees (None if the labels know one class only), the suffix statistics (``small`` if they can be broadcast) and the share of bad labels."""

    trees: GBTClassificationModel | None
    suffix_rates: DataFrame
    prior: float
    small: bool = True

    def score(self, urls: DataFrame, url: str = "url", out: str = "bad_probability") -> DataFrame:
        """``urls`` with the probability that each is unwanted; features don't stay."""
        rows = without(urls, out)
        if self.trees is None:
            return rows.withColumn(out, F.lit(self.prior))
        packed = rows.select(F.struct("*").alias("__row"), F.col(url).alias("__given"))  # so that no name of theirs clashes
        ready = _assembled(_with_suffix_rate(with_lexical(packed, "__given"), self.suffix_rates, self.prior, self.small))
        return self.trees.transform(ready).select("__row.*", vector_to_array("probability")[1].alias(out))


def _with_suffix_rate(rows: DataFrame, rates: DataFrame, prior: float, small: bool = True) -> DataFrame:
    """The rate of bad labels of the longest known suffix. ``small`` rates are broadcast; others meet the rows of a suffix in SALTS groups."""
    found = []
    if not small:
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    for k, (suffix, labels) in enumerate(zip(suffixes(F.col("__host")), (None, 3, 2, 1))):
        found.append(f"__rate{k}")
        own = rates if labels is None else rates.where(F.size(F.split("suffix", r"\.")) <= labels)
        level = own.select(F.col("suffix").alias(f"__suffix{k}"), F.col("rate").alias(found[-1]))
        match = suffix == F.col(f"__suffix{k}")
        if small:
            rows = rows.join(F.broadcast(level), match, "left").drop(f"__suffix{k}")
        else:
            level = level.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.join(level, match & (F.col("__salt") == F.col("__deal")), "left").drop(f"__suffix{k}", "__deal")
    known = sum((F.col(c).isNotNull().cast("double") for c in found), F.lit(0.0))
    return rows.withColumns({"suffix_rate": F.coalesce(*found, F.lit(prior)), "suffix_known": known}).drop(*found, "__host", "__salt")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features", handleInvalid="keep").transform(rows)


def _tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def _by_suffix(hosts: DataFrame) -> DataFrame:
    """(suffix, bad, n) of (host, bad, n)."""
    return _tally(hosts.select("bad", "n", F.explode(F.array_distinct(F.array(*suffixes(F.col("host"))))).alias("suffix")), "suffix")


def _rate(bad: Column, n: Column, prior: float) -> Column:
    return (bad + prior) / (n + 1.0)


def train(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS) -> UrlModel:
    """Fits the filter to labelled URLs (label 1: unwanted, 0: wanted; null labels are left out).

    The suffix statistics count every distinct (url, label). The trees are taught
    by a sample of at most ``rows`` of them and at most half, chosen by hash; to
    the taught rows the statistics are shown without their own labels, so the
    trees learn how far to trust statistics of suffixes. With labels of one class
    only, or none, the model is that class's share alone.
    """
    pairs = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    pairs = pairs.where("url is not null and label is not null")
    by_host = materialize(_tally(pairs.distinct().select(host_of(F.col("url")).alias("host"), F.col("label").alias("bad"), F.lit(1).alias("n")), "host"))
    bad, n = by_host.agg(F.coalesce(F.sum("bad"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    prior = float(bad) / n if n else 0.0
    counts = materialize(_by_suffix(by_host))
    rates = counts.select("suffix", _rate(F.col("bad"), F.col("n"), prior).alias("rate"))
    small = counts.count() <= BROADCAST_ROWS
    chance = F.pmod(F.xxhash64("url", "label"), F.lit(1 << 20))
    drawn = pairs.where(chance < int((1 << 20) * min(0.5, rows / max(n, 1)))).distinct()
    taught = materialize(drawn.orderBy(chance, "url", "label").limit(rows).coalesce(1))
    if taught.select("label").distinct().count() < 2:
        return UrlModel(None, rates, prior, small)
    own = _by_suffix(taught.select(host_of(F.col("url")).alias("host"), F.col("label").alias("bad"), F.lit(1).alias("n")))
    own = own.select("suffix", F.col("bad").alias("own_bad"), F.col("n").alias("own_n"))
    others = counts.join(F.broadcast(own), "suffix").where("n > own_n")
    shown = others.select("suffix", _rate(F.col("bad") - F.col("own_bad"), F.col("n") - F.col("own_n"), prior).alias("rate"))
    table = _assembled(_with_suffix_rate(with_lexical(taught), materialize(shown.coalesce(1)), prior)).select("__features", "label")
    made = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32)
    return UrlModel(made.fit(materialize(table.coalesce(1))), rates, prior, small)


def filter_urls(urls: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (the longest that fits, else null), ``bad_probability`` and ``verdict``.

    The verdict (allow or block) is the rule's; without one it is block if the
    model's probability reaches ``threshold``. A null URL or one without ``://``
    has an empty host and path, which the model judges like any other. Repeated
    rows get equal verdicts; an empty table gives no rows; columns of the names
    made here are replaced.
    """
    scored = model.score(without(urls, "host", "path", "rule", "verdict"), url)
    rule = matching_rule(rules, F.col("host"), F.col("path"))
    allowed = F.col("rule").isin(*[r.pattern for r in rules if r.allow])
    judged = F.when(F.col("rule").isNotNull(), allowed).otherwise(F.col("bad_probability") < threshold)
    return (
        scored.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumn("rule", rule)
        .withColumn("verdict", F.when(judged, "allow").otherwise("block"))
    )

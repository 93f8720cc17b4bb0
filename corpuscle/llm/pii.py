"""Personal data by weak supervision: patterns, gazetteers and context vote; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, without
from .weak import VoteModel, fit_votes, vote_patterns

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")

# Each pattern finds the leftmost non-overlapping matches of its plain form. Possessive
# loops and the run-start guard (no character of the run before it, or the end of the
# last match) keep the search linear and off the call stack in very long texts.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}+(?:[\x20]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?:(?<![A-Za-z0-9_])|\G)(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
}
#: Phones without a country code; candidates only.
LOOSE_PHONE = r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Word lists of the context labelers and the gazetteers.
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write to|reach|correo|courriel)",
    "ip": r"(?i)(\bip\b|address|host|server|client|login|adresse)",
    "card": r"(?i)(card|visa|master|amex|credit|payment|tarjeta|carte|karte)",
    "phone": r"(?i)(phone|\btel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon)",
    "iban": r"(?i)(iban|account|bank|transfer|konto|compte|cuenta|\bbic\b)",
    "ssn": r"(?i)(ssn|social security|security (no|num)|tax ?id|identity|national id)",
    "secret": r"(?i)(passw(or)?d|passwd|secret|token|api[_ -]?key|\bkey|auth|credential)",
}
COUNTER_CUES = r"(?i)(isbn|issn|version|\bv[0-9. ]*$|invoice|order|sha-?[0-9]*|commit|build|uuid|section|chapter|build|doi)"
PUBLIC_SUFFIXES = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|br|mx|jp|cn|in)$"
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED_IPS = r"^(0|127|255|10|169\.254|192\.168|22[4-9]|23[0-9])\."
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN_COUNTRIES = r"^(AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MT|NL|NO|PK|PL|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA)"
UNUSED_SSN = r"^(000|666|9)|-00-|-0000$"
KEY_PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|glpat|AIza|eyJ)"
LABELERS = ("by_pattern", "by_gazetteer", "by_context", "by_shape")
#: What the classifier sees of a span and its context beside the votes, and the values each may have.
TRAITS = {"length_class": 6, "digit_class": 5, "set_off": 2, "after_mark": 2}
_MARK, _OTHER = "", ""
_CONTEXT = 40
#: Pieces of a text that are folded at once; even, so that each run starts outside a match.
_RUN = 128


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The check number of an account number; 1 if it is valid."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4)))

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, total * 100 + F.ascii(c) - 55).otherwise(total * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's own test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(kind == "email")


_SPAN = "struct<start:int,kind:int,end:int,base:boolean,match:string,before:string>"


def _spans(text: Column, kind: str, pattern: str, candidate) -> Column:
    """The matches of ``pattern`` that are base spans or ``candidate``, with positions in code points.

    Every match is set off by a mark that the text doesn't hold, the text is split
    at the marks, and the pieces' lengths give the positions. Pieces are folded in
    runs of ``_RUN``: no growing array is copied once per match.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast(f"array<{_SPAN}>")

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        span = F.struct(
            a["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"),
            _holds(kind, piece).alias("base"), piece.alias("match"), a["before"].alias("before"),
        )
        use = a["inside"] & (_holds(kind, piece) | candidate(piece))
        return F.struct(
            end.alias("at"),
            (~a["inside"]).alias("inside"),
            F.substring(piece, -_CONTEXT, _CONTEXT).alias("before"),
            F.when(use, F.concat(a["spans"], F.array(span.cast(_SPAN)))).otherwise(a["spans"]).alias("spans"),
        )

    def run(p: Column, k: Column) -> Column:
        return F.slice(p, k * _RUN + 1, F.lit(_RUN))

    def folded(p: Column, k: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"), none.alias("spans"))
        return F.aggregate(run(p, k), start, step, lambda a: a["spans"])

    def found(p: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN).cast("int"))
        sizes = F.transform(runs, lambda k: F.aggregate(run(p, k), F.lit(0), lambda n, piece: n + F.length(piece)))
        began = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            sizes, began, lambda a, n: F.struct((a["total"] + n).alias("total"), F.array_append(a["starts"], a["total"]).alias("starts")), lambda a: a["starts"]
        )
        return F.flatten(F.zip_with(runs, starts, lambda k, at: folded(p, k, at)))

    return F.get(F.transform(F.array(pieces), lambda p: F.when(F.size(p) == 1, none).otherwise(found(p))), F.lit(0))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``candidates``: base spans, and what else may be personal data, in page order."""
    docs = without(docs, "candidates", "__text")
    t = F.col("__text")
    maybe = {
        "email": lambda m: F.lit(False),
        "ip": lambda m: F.lit(False),
        "card": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(13, 19),
        "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
        "iban": lambda m: F.lit(True),
        "ssn": lambda m: F.lit(True),
        "secret": lambda m: F.lit(True),
    }
    arrays = [_spans(t, k, PATTERNS[k], maybe[k]) for k in KINDS]
    loose = F.transform(
        _spans(t, "phone", LOOSE_PHONE, lambda m: F.lit(True)), lambda s: s.withField("base", F.lit(False))
    )
    marked = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER)
    return (
        docs.withColumn("__text", marked)
        .withColumn("candidates", F.sort_array(F.concat(*arrays, loose)))
        .drop("__text")
    )


def _by_kind(kind: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(kind == KINDS.index(k), v).otherwise(out)
    return out


def with_votes(spans: DataFrame) -> DataFrame:
    """Candidates (one a row, in column ``span``) with the labelers' votes."""
    s = F.col("span")
    kind, match, before = s["kind"], s["match"], s["before"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    letters = F.regexp_replace(match, "[^A-Za-z0-9]", "")
    variety = F.size(F.array_distinct(F.split(ascii_lower(letters), "")))
    cue = reduce(lambda a, k: F.when(kind == KINDS.index(k), before.rlike(CUES[k])).otherwise(a), KINDS, F.lit(False))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    gazetteer = {
        "email": vote(match.rlike(PUBLIC_SUFFIXES), F.lit(False)),
        "ip": vote(~match.rlike(RESERVED_IPS), match.rlike(RESERVED_IPS)),
        "card": vote(digits.rlike(CARD_PREFIXES), ~digits.rlike(CARD_PREFIXES)),
        "phone": vote(match.rlike(COUNTRY_CODES), match.rlike(r"^\+") & ~match.rlike(COUNTRY_CODES)),
        "iban": vote(match.rlike(IBAN_COUNTRIES), ~match.rlike(IBAN_COUNTRIES)),
        "ssn": vote(~match.rlike(UNUSED_SSN), match.rlike(UNUSED_SSN)),
        "secret": vote(match.rlike(KEY_PREFIXES), match.rlike("^[a-z]+_[a-z_]+[0-9]{1,4}$")),
    }
    shape = {
        "secret": vote((variety >= 9) & (F.length(digits) >= 3), (variety < 6) | (F.length(digits) < 2)),
        "card": vote(s["base"] & (variety >= 4), variety <= 2),  # a number that fails its check looks like any other
        "phone": vote(variety >= 4, variety <= 2),
        "iban": vote(F.length(letters).between(15, 34), ~F.length(letters).between(15, 34)),
        "ssn": vote(variety >= 4, variety <= 2),
    }
    pattern = {
        "secret": vote(before.rlike("[=:]\\s*[\"']?$") | match.rlike(KEY_PREFIXES), F.lit(False)),
        "phone": vote(s["base"] | match.rlike(r"^\("), match.rlike(r"^\+")),
        "iban": F.when(kind == KINDS.index("iban"), vote(_mod97(match) == 1, _mod97(match) != 1)).otherwise(0),
        "ssn": F.lit(0),
    }
    return spans.withColumns(
        {
            "by_pattern": _by_kind(kind, pattern, vote(s["base"], ~s["base"])),
            "by_gazetteer": _by_kind(kind, gazetteer, F.lit(0)),
            "by_context": vote(cue, before.rlike(COUNTER_CUES)),
            "by_shape": _by_kind(kind, shape, F.lit(0)),
            "length_class": F.least((F.length(match) / 8).cast("int"), F.lit(5)),
            "digit_class": (4 * F.length(digits) / F.greatest(F.length(match), F.lit(1))).cast("int"),
            "set_off": (~before.rlike("[A-Za-z0-9]$")).cast("int"),
            "after_mark": before.rlike("[=:#]\\s*[\"']?$").cast("int"),
        }
    )


def _features() -> list[tuple[str, Column]]:
    out = [(f"f_{n}_{v}", (F.col(n) == (1 if v == "yes" else -1)).cast("double")) for n in LABELERS for v in ("yes", "no")]
    out += [(f"f_{k}", (F.col("kind") == i).cast("double")) for i, k in enumerate(KINDS)]
    return out + [(f"f_{t}_{v}", (F.col(t) == v).cast("double")) for t, n in TRAITS.items() for v in range(1, n)]


def train_classifier(spark: SparkSession, patterns: list, models: dict[int, VoteModel]) -> Column:
    """Probability that a span is private: logistic regression on votes, kind, span and context, taught by the posteriors.

    ``patterns`` are the distinct (kind, votes, traits) and their rows. The table has two
    weighted rows for each, so it is bounded (3 ** 4 * 7 * 120 * 2 rows at most)
    whatever the corpus. Without candidates the posterior itself is used.
    """
    voters = len(LABELERS)
    rows = [
        (*(int(v) for v in p), label, n * (q if label else 1 - q))
        for p, n in patterns
        for q in (models[p[0]].posterior(tuple(p[1 : 1 + voters])),)
        for label in (0.0, 1.0)
    ]
    if not rows or len({r[-2] for r in rows if r[-1] > 1e-3}) < 2:
        return reduce(lambda a, k: F.when(F.col("kind") == k, models[k].posterior_column()).otherwise(a), models, F.lit(0.0))
    names = ["kind", *LABELERS, *TRAITS, "label", "weight"]
    schema = ", ".join(f"{n} int" for n in names[:-2]) + ", label double, weight double"
    table = spark.createDataFrame(rows, schema).coalesce(1).select(*names, *[c.alias(n) for n, c in _features()])
    ready = VectorAssembler(inputCols=[n for n, _ in _features()], outputCol="features").transform(table)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(ready)
    score = F.lit(float(fitted.intercept))
    for w, (_, c) in zip(fitted.coefficients, _features()):
        score = score + F.lit(float(w)) * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


_TRIMMED = "array<struct<start:int,kind:int,end:int>>"


def _first_of_overlapping(spans: Column) -> Column:
    def step(a: Column, s: Column) -> Column:
        clear = s["start"] >= a["end"]
        return F.struct(F.when(clear, s["end"]).otherwise(a["end"]).alias("end"), F.when(clear, F.array_append(a["kept"], s)).otherwise(a["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(_TRIMMED).alias("kept"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["kept"])


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: ``base`` and ``spans``, arrays of (start, kind, end) in code points.

    Base spans are those of the four exact kinds and always stay; a further
    candidate (an account or social security number, a secret, a mistyped card number,
    a phone without country code) is added if the classifier gives it ``threshold`` or
    more and it doesn't touch a base span; of added spans that overlap the first stays,
    of those with one start the first kind. Labelers vote over all candidates of all documents; EM turns their
    agreement into reliabilities, for each kind its own (started from those of all
    kinds, which hold where a kind has few candidates); those teach the classifier. Null and empty
    texts have no spans; repeated rows get equal spans; an empty table gives no
    rows; other columns are left out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = materialize(with_candidates(slim).drop("text").withColumn("row", F.monotonically_increasing_id()))
    votes = with_votes(held.select("row", F.explode("candidates").alias("span"))).withColumn("kind", F.col("span.kind"))
    patterns = vote_patterns(votes, ["kind", *LABELERS, *TRAITS])
    by_votes: dict[tuple, int] = {}
    for p, n in patterns:
        cast = p[1 : 1 + len(LABELERS)]
        by_votes[cast] = by_votes.get(cast, 0) + n
    pooled = fit_votes(sorted(by_votes.items()), list(LABELERS))
    models = {}
    for kind in sorted({p[0] for p, _ in patterns}):
        own: dict[tuple, int] = {}
        for p, n in patterns:
            if p[0] == kind:
                cast = p[1 : 1 + len(LABELERS)]
                own[cast] = own.get(cast, 0) + n
        models[kind] = fit_votes(sorted(own.items()), list(LABELERS), prior=pooled)
    chance = train_classifier(spark, patterns, models)
    span = F.struct(F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"))
    more = votes.where(~F.col("span.base") & (chance >= threshold)).groupBy("row").agg(F.collect_set(span).alias("more"))
    trim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform(F.filter("candidates", lambda s: s["base"]), trim)
    apart = F.filter("more", lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return (
        held.join(more, "row", "left")
        .withColumn("base", base)
        .withColumn("more", _first_of_overlapping(F.coalesce(apart, F.array().cast(_TRIMMED))))
        .select(F.col("doc_id").alias(doc_id), "base", F.sort_array(F.concat("base", "more")).alias("spans"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def private_report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        doc_id, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )

"""Quality rules as weak supervision, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize, without
from .weak import VoteModel, fit_votes, vote_patterns

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on at from this are "
    "le la les de des du et en un une que qui dans pour sur est au par pas "
    "der die das und ist von mit zu den ein eine nicht sich auf im es "
    "el los las y del se por con no una su para al lo"
).split()
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop", "n_long")
RULES = ("rule_length", "rule_repeat", "rule_symbols", "rule_word_length", "rule_lines", "rule_case", "rule_stop_words", "rule_long_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside a ``window``-word sequence that the row holds twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def count(s: Column) -> Column:
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"]),
            )
            at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
            return F.aggregate(
                at,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct((a["n"] + i + window - F.greatest(i, a["end"])).alias("n"), (i + window).alias("end")),
                lambda a: a["n"],
            )

        return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(some)

    return _let(words, of)


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the columns of SIGNALS, computed over whole texts."""
    docs = without(docs, *SIGNALS, "__text", "__words")
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(raw, SPACE), "")
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t, w = F.col("__text"), F.col("__words")

    def without_chars(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")

    return (
        docs.withColumn("__text", raw)
        .withColumn("__words", words)
        .withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": F.length(F.array_join(w, "")).cast("long"),
                "n_symbols": without_chars(r"[#*$%&|<>]+"),
                "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
                "n_repeat_words": repeated_words(w),
                "n_upper": without_chars("[A-Z]+"),
                "n_stop": F.size(F.filter(w, lambda x: ascii_lower(x).isin(*STOP_WORDS))).cast("long"),
                "n_long": F.size(F.filter(w, lambda x: F.length(x) > 25)).cast("long"),
            }
        )
        .drop("__text", "__words")
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def with_votes(signals: DataFrame) -> DataFrame:
    """The rules' votes: -1 bad, 1 good, 0 abstain."""
    n, chars = F.col("n_words"), F.col("word_chars")
    few = n < MIN_WORDS

    def share(part: str, bad: Column, good: Column) -> Column:
        return F.when(few, 0).otherwise(_vote(bad, good))

    rep, sym, up, stop, long_ = (F.col(c) for c in ("n_repeat_words", "n_symbols", "n_upper", "n_stop", "n_long"))
    return without(signals, *RULES).withColumns(
        {
            "rule_length": _vote(few, n >= 40),
            "rule_repeat": share("rep", 100 * rep > 20 * n, 100 * rep <= 2 * n),
            "rule_symbols": share("sym", 100 * sym > 15 * n, 100 * sym <= 3 * n),
            "rule_word_length": share("len", (chars < 3 * n) | (chars > 9 * n), (chars >= 3.5 * n) & (chars <= 8 * n)),
            "rule_lines": share("lines", F.col("n_dup_lines") >= 3, F.col("n_dup_lines") == 0),
            "rule_case": share("case", 100 * up > 25 * chars, 100 * up <= 8 * chars),
            "rule_stop_words": share("stop", 100 * stop < 4 * n, 100 * stop >= 12 * n),
            "rule_long_words": share("long", 100 * long_ > 10 * n, 100 * long_ <= 2 * n),
        }
    )


def fit_quality(votes: DataFrame) -> VoteModel:
    """The rules' accuracies by EM; only the table of vote patterns (3 ** rules rows at most) reaches the driver."""
    return fit_votes(vote_patterns(votes, list(RULES)), list(RULES))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the signals, votes, ``quality`` (posterior), ``base_failed`` and ``kept``.

    Rules vote or abstain on each whole text; EM over all rows estimates how
    reliable each is, and a document is kept if its posterior probability of
    being good reaches ``threshold`` and it does not fail the base limits (fewer
    than 20 words, or over 30 % of its words repeated). Null and blank texts have
    no words and fail the base. Repeated rows get equal verdicts; an empty table
    gives no rows. Columns of the names made here are replaced.
    """
    return judge_signals(with_votes(with_signals(without(docs, "quality", "base_failed", "kept"), text)), threshold)


def judge_signals(votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``judge`` for rows that have signals and votes already; they are written once and read twice."""
    voted = materialize(votes)
    model = fit_quality(voted)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return (
        voted.withColumn("quality", model.posterior_column())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``docs``."""
    return judge(docs, text, threshold).where("kept").select(*docs.columns)

"""English stems (Porter, 1980) as SQL expressions, so that an index and its queries stem inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a stem has to look like: C is a run of consonants, V one of vowels; y is a vowel behind a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME = f"^({_C})?{_V}{_C}"
_TWO = f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"

# The published suffixes and what stands for them.
_PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
_DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_ENDINGS = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _rules(rules: dict[str, str], when: str | None) -> str:
    """The longest suffix that fits decides: it is replaced if what stands before it looks like ``when``."""
    cases = []
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        stem = f"left(w, length(w) - {len(suffix)})"
        put = f"concat({stem}, '{rules[suffix]}')"
        cases.append(f"WHEN right(w, {len(suffix)}) = '{suffix}' THEN " + (f"CASE WHEN {{match}}({stem}, '{when}') THEN {put} ELSE w END" if when else put))
    return f"CASE {' '.join(cases)} ELSE w END"


def _steps() -> list[str]:
    """Expressions over a word ``w``, each over the result of the one before; {match} is the regular expression test.

    A word that lost "ed" or "ing" carries a | until its end is mended.
    """
    lost = "left(w, length(w) - 1)"
    past = (
        f"CASE WHEN right(w, 3) = 'eed' THEN CASE WHEN {{match}}(left(w, length(w) - 3), '{_SOME}') THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN right(w, 2) = 'ed' AND {{match}}(left(w, length(w) - 2), '{_VOWEL}') THEN concat(left(w, length(w) - 2), '|') "
        f"WHEN right(w, 3) = 'ing' AND {{match}}(left(w, length(w) - 3), '{_VOWEL}') THEN concat(left(w, length(w) - 3), '|') ELSE w END"
    )
    mended = (
        f"CASE WHEN right(w, 1) <> '|' THEN w WHEN right(w, 3) IN ('at|', 'bl|', 'iz|') OR {{match}}({lost}, '{_SHORT}') THEN concat({lost}, 'e') "
        f"WHEN length(w) > 2 AND left(right(w, 2), 1) = left(right(w, 3), 1) AND left(right(w, 2), 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN left(w, length(w) - 2) ELSE {lost} END"
    )
    final_y = f"CASE WHEN right(w, 1) = 'y' AND {{match}}({lost}, '{_VOWEL}') THEN concat({lost}, 'i') ELSE w END"
    # "ion" goes behind s or t only.
    last = _rules(dict.fromkeys(_LAST, ""), _TWO).replace("WHEN right(w, 3) = 'ion' THEN", "WHEN right(w, 3) = 'ion' AND left(right(w, 4), 1) NOT IN ('s', 't') THEN w WHEN right(w, 3) = 'ion' THEN")
    final_e = f"CASE WHEN right(w, 1) = 'e' AND ({{match}}({lost}, '{_TWO}') OR {{match}}({lost}, '{_ONE}') AND NOT {{match}}({lost}, '{_SHORT}')) THEN {lost} ELSE w END"
    final_l = f"CASE WHEN right(w, 2) = 'll' AND {{match}}({lost}, '{_TWO}') THEN {lost} ELSE w END"
    return [_rules(_PLURALS, None), past, mended, final_y, _rules(_DOUBLE, _SOME), _rules(_ENDINGS, _SOME), last, final_e, final_l]


def stem_sql(word: str) -> str:
    """The stem of a column or lambda variable, as Spark SQL.

    Each step is a function of one element, so the expression's size is the sum of its steps' wherever it is moved.
    """
    made = word
    for step in _steps():
        made = f"element_at(transform(array({made}), w -> {step.format(match='regexp')}), 1)"
    return f"CASE WHEN {word} RLIKE '^[a-z]{{3,}}$' THEN {made} ELSE {word} END"


def stem(word: str = "term") -> Column:
    """The stem of the words in column ``word``.

    Words of three or more letters a to z have stems; others (shorter, with digits, accents or capitals) and nulls stay.
    """
    return F.expr(stem_sql(word))


def stems_sql(table: str, word: str = "term") -> str:
    """The same over a table or subquery with column ``word``, as a DuckDB subquery."""
    out = f"(SELECT *, {word} AS w, regexp_matches({word}, '^[a-z]{{3,}}$') AS stems FROM {table})"
    for step in _steps():
        out = f"(SELECT * EXCLUDE (w), CASE WHEN stems THEN {step.format(match='regexp_matches')} ELSE w END AS w FROM {out})"
    return f"(SELECT * EXCLUDE (w, stems) REPLACE (w AS {word}) FROM {out})"

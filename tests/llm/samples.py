"""Small tables with the awkward cases every operator must take."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    names = ["alpha", "beta", "gamma", "delta", "river", "stone", "house", "green", "walk", "light", "the", "of", "and", "to", "in", "is"]
    return " ".join(rng.choice(names) + rng.choice(["", "s", "ly", "ed", "ing"]) for _ in range(n))


def documents() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace("river", "brook", 1)
    rows = [(i, prose(i, 40 + i)) for i in range(20)]
    rows += [(100, base), (101, base), (102, near), (103, None), (104, ""), (105, " \t\n "), (106, LONG), (107, "one"), (107, "one")]
    rows += [(108, "Ünïcode wörds À la carte 😀 " * 9), (None, prose(5, 45)), (109, "<<< ### $$$ %%% " * 8), (110, "same words again and again " * 30)]
    return rows


def table(spark, rows=None, extra=True):
    """(doc_id, text) and columns whose names clash with those that operators make."""
    rows = documents() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(*r, "src0", "x", 0.5, "old") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host string, score double, fingerprint string")

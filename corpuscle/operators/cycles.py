"""Research in cycles: what is still missing selects recorded answers, until nothing new comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable

MOST_CYCLES, MOST_GAPS, MOST_PER_SOURCE = 3, 3, 2


def research_cycles(first: DataFrame, gaps: DataFrame, answers: DataFrame, most: int = MOST_CYCLES, most_gaps: int = MOST_GAPS, per_source: int = MOST_PER_SOURCE) -> DataFrame:
    """(question_id, url, cycle, gap_no, source, pos): all sources of each question, with the cycle that found them.

    ``first`` (question_id, url, source, pos) is what the first search found, cycle 0. ``gaps`` (question_id, cycle,
    gap_no, gap) are the recorded questions that each later cycle would ask, from cycle 1 on; the first ``most_gaps`` count.
    ``answers`` (gap, source, pos, url) are recorded results, of which the first ``per_source`` of each source count.
    A URL that a question has is not taken again; of repeated new ones the first by gap, source and position is. A
    question goes on while a cycle brings something new, for ``most`` cycles with the first; the job ends with the last question. Null URLs are no
    sources; questions without gaps keep what they have.

    Each cycle is a join of the open questions' gaps with the answers and an anti join with what is known, written to
    the shared folder; only the number of new rows reaches the driver.
    """
    names = ["question_id", "url", "cycle", "gap_no", "source", "pos"]
    seed = first.where("url is not null").withColumns({"cycle": F.lit(0).cast("long"), "gap_no": F.lit(0).cast("long"), "pos": F.col("pos").cast("long")})
    known = durable(_first_of(seed, ["source", "pos"]).select(*names))
    top = F.row_number().over(Window.partitionBy("gap", "source").orderBy("pos", "url"))
    offered = durable(answers.where("url is not null").withColumn("n", top).where(F.col("n") <= per_source).select("gap", "source", F.col("pos").cast("long").alias("pos"), "url"))
    turn = F.row_number().over(Window.partitionBy("question_id", "cycle").orderBy("gap_no"))
    asked = durable(gaps.withColumn("n", turn).where(F.col("n") <= most_gaps).select("question_id", F.col("cycle").cast("long").alias("cycle"), F.col("gap_no").cast("long").alias("gap_no"), "gap"))
    still = known.select("question_id").distinct()
    for cycle in range(1, most):
        met = asked.where(F.col("cycle") == cycle).join(still, "question_id", "left_semi").join(offered, "gap")
        new = met.join(known.select("question_id", "url"), ["question_id", "url"], "left_anti")
        added = durable(_first_of(new, ["gap_no", "source", "pos"]).select(*names))
        if added.isEmpty():
            break
        known = known.unionByName(added)
        still = added.select("question_id").distinct()
    return known


def _first_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each question and URL, the first in order: a partial aggregate, however often a URL comes up."""
    rest = [c for c in rows.columns if c not in ("question_id", "url", *order)]
    chosen = rows.groupBy("question_id", "url").agg(F.min(F.struct(*order, *rest)).alias("at"))
    return chosen.select("question_id", "url", "at.*")


def cycle_counts(found: DataFrame) -> DataFrame:
    """(question_id, cycles, sources): the last cycle that brought something, with the first search as one, and all sources."""
    return found.groupBy("question_id").agg((F.max("cycle") + 1).alias("cycles"), F.count(F.lit(1)).alias("sources"))

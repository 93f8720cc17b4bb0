"""A log of page updates replayed in order: each update sees the version that the one before it made."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knowledge import TRANSITIONS

_FIELDS = ["page_id", "update_id", "base_version", "confidence", "p1", "state", "version"]


def lifecycle_after(state: str | None, confidence: float | None, p1: int | None, allowed: frozenset[str]) -> str | None:
    """The state of a page that takes an update: active if the update is sure and backed, or mends what was stale or contradicted."""
    sure = confidence if confidence is not None else -1.0
    if sure >= 0.5 and (p1 or 0) > 0 and state in allowed:
        return "active"
    if state == "stale" and sure >= 0.5 or state == "contradicted" and sure >= 0.7:
        return "active"
    return state


def replay_updates(pages: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` after all ``updates`` in order of update_id, and the log of every update.

    ``pages`` has page_id, state, version, content, confidence, p1, p2, p3; ``updates`` has update_id, page_id,
    base_version (null: any), content, confidence, p1, p2, p3. An update is accepted if its page exists and its base
    version is null or the version that the page has by then; it raises the version by one. The log is (page_id,
    update_id, accepted, base_version, result_version, state): both versions are null for those turned down. Ids must be unique; a null page_id or update_id is
    turned down, the latter sorts first and is skipped.

    Only versions, states and what decides go through the fold: sorted by page and update, row after row, with one page's
    state held at a time, so a page with any number of updates streams through. Contents are joined at the end, for
    the last accepted update of a page.
    """
    known = pages.select("page_id", "state", "version")
    met = updates.select("page_id", "update_id", "base_version", "confidence", "p1").join(known, "page_id", "left")
    slim = met.select("page_id", "update_id", F.col("base_version").cast("long"), F.col("confidence").cast("double"), F.col("p1").cast("long"), "state", F.col("version").cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    allowed = frozenset(a for a, to in TRANSITIONS["wide"].items() if "active" in to.split())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, state, version = object(), None, None
        for batch in batches:
            columns = batch.to_pydict()
            accepted, bases, results, states = [], [], [], []
            for page_id, update_id, base, sure, p1, first_state, first_version in zip(*(columns[f] for f in _FIELDS)):
                if page_id != page:
                    page, state, version = page_id, first_state, first_version
                took = page_id is not None and update_id is not None and version is not None and (base is None or base == version)
                accepted.append(took)
                bases.append(version if took else None)
                if took:
                    state, version = lifecycle_after(state, sure, p1, allowed), version + 1
                results.append(version if took else None)
                states.append(state)
            made = [pa.array(accepted, pa.bool_()), pa.array(bases, pa.int64()), pa.array(results, pa.int64()), pa.array(states, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "update_id", "accepted", "base_version", "result_version", "state"])

    # By a hash: a shuffle by the bare page_id would be merged with the join's, which may be read where it was written
    # once the join turns out to be a broadcast. Then a page's updates would lie in several tasks.
    ordered = slim.repartition(F.xxhash64("page_id")).sortWithinPartitions("page_id", "update_id")
    log = ordered.mapInArrow(fold, f"page_id {kinds['page_id']}, update_id {kinds['update_id']}, accepted boolean, base_version long, result_version long, state string")
    last = log.where("accepted").groupBy("page_id").agg(F.max(F.struct("result_version", "update_id", "state")).alias("last"))
    changed = ["content", "confidence", "p1", "p2", "p3"]
    new = updates.select(F.col("update_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in changed])
    ends = last.select("page_id", F.col("last.result_version").alias("__version"), F.col("last.state").alias("__state"), F.col("last.update_id").alias("__id")).join(new, "__id")
    took = F.col("__id").isNotNull()
    after = pages.join(ends, "page_id", "left").select(
        "page_id",
        F.when(took, F.col("__state")).otherwise(F.col("state")).alias("state"),
        F.when(took, F.col("__version")).otherwise(F.col("version")).alias("version"),
        *[F.when(took, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in changed],
    )
    return after, log

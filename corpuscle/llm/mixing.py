"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, without

#: Rows that are ranked in one piece; larger sources are ranked in as many pieces as they need.
PIECE_ROWS = 2_000
BLOCK_ROWS = 64
REST = "__rest__"


def period_of(weights: dict[str, int]) -> tuple[int, dict[str, list[int]]]:
    """Slots of one period for whole-number weights: (length, slots of each source in order).

    Block i of a source with share w is released at slot floor(i / w) and due by
    ceil((i + 1) / w). In every slot the released block with the earliest deadline
    goes next (ties: the block whose successor's window overlaps, then the longer
    name order), so that before and after each slot every source is less than one
    block from its share. After ``length`` slots each source has had exactly its
    weight, and everything repeats. The work is the sum of the weights, which the
    caller's configuration bounds, not the data.
    """
    shares = {s: w for s, w in weights.items() if w > 0}
    scale = 0
    for w in shares.values():
        scale = gcd(scale, w)
    shares = {s: w // scale for s, w in shares.items()}
    length = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            due = -(-(i + 1) * length // shares[s])
            overlaps = (i + 1) * length % shares[s] != 0
            # With equal deadlines, a heavy source's run of overlapping windows ends later and goes first.
            group = _group_deadline(i, shares[s], length) if overlaps and 2 * shares[s] >= length else due
            heapq.heappush(ready, (due, -int(overlaps), -group, s, i))
        _, _, _, s, i = heapq.heappop(ready)
        slots[s].append(slot)
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * length // shares[s], s, i + 1))
    return length, slots


def _group_deadline(i: int, w: int, length: int) -> int:
    """The slot by which a cascade of two-slot windows that starts at block i must end."""
    while True:
        due = -(-(i + 1) * length // w)
        if (i + 1) * length % w == 0:
            return due
        following = -(-(i + 2) * length // w) - (i + 1) * length // w
        if following >= 3:
            return due
        i += 1


def ranked(rows: DataFrame, group: str, order: list[Column], out: str, piece: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with the 0-based rank in their ``group`` by a pseudo-random key and then ``order``.

    The key's range is cut into as many pieces as the largest group needs; rows
    are ranked within a piece and offset by the pieces before it, so a group with
    a third of all rows is dealt over many tasks. ``__key`` must be a long from 0
    to 2 ** 62 - 1.
    """
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-largest // piece))
    cut = F.floor(F.col("__key") / F.lit((1 << 62) / pieces)).cast("long")
    rows = rows.withColumn("__piece", cut)
    sizes = rows.groupBy(group, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    # One row per source and piece of it.
    before = F.sum("__n").over(_window([group], [F.col("__piece")]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(group).alias("__g"), F.col("__piece").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(_window([group, "__piece"], [F.col("__key"), *order]))
    return (
        rows.withColumn("__place", place)
        .join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__piece") == F.col("__p")))
        .withColumn(out, F.col("__place") - 1 + F.col("__before"))
        .drop("__piece", "__place", "__g", "__p", "__before")
    )


def _window(parts: list[str], order: list[Column]):
    return Window.partitionBy(*parts).orderBy(*order)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int],
    rest_weight: int = 1,
    block_rows: int = BLOCK_ROWS,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    piece: int = PIECE_ROWS,
) -> DataFrame:
    """``docs`` with their place in a mix of the sources: no row is dropped or repeated.

    Sources without a weight, and null, share the pool REST with ``rest_weight``.
    Each pool is put in a pseudo-random order that depends on ids and texts alone
    and cut into blocks of ``block_rows``. Added columns: ``mix_pool``,
    ``mix_block`` (the block's number in its pool), ``mix_slot`` (its slot in the
    schedule, counted from 0), ``mix_row`` (row in the block) and ``mix_exact``:
    whether the slot comes before the first pool runs out, that is, whether the
    blocks up to it have each pool within one block of its target. Slots of pools
    that have run out stay empty; ordering by (mix_slot, mix_row) gives the mix.

    A weight of zero or less counts as one part in the whole (rows are never
    dropped). Repeated rows take places of their own; null ids and texts sort
    first; an empty table gives no rows. Columns of the names made are replaced.
    ``docs`` is read twice, so it should be a table and not a costly plan.
    """
    made = ("mix_pool", "mix_block", "mix_slot", "mix_row", "mix_exact")
    docs = without(docs, *made)
    weights = {s: max(1, int(w)) for s, w in weights.items()} | {REST: max(1, int(rest_weight))}
    named = [F.lit(s) for s in weights if s != REST]
    pool = F.when(F.col(source).isin(*named), F.col(source)).otherwise(REST) if named else F.lit(REST)
    key = F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), 2)
    names = docs.columns
    rows = docs.withColumn("mix_pool", pool).withColumn("__key", key)
    # Only ids and keys are ranked; texts stay where they are until the last join. Key and id name a row, unless it is
    # repeated: then, and only then, the rows are written with numbers to name them by.
    rows = rows.withColumn("__id", F.col(doc_id))
    slim = materialize(rows.select("mix_pool", "__key", "__id").withColumn("__row", F.lit(0).cast("long")))
    if not slim.groupBy("__key", "__id").count().where("count > 1").isEmpty():
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
        slim = rows.select("mix_pool", "__key", "__id", "__row")
    else:
        rows = rows.withColumn("__row", F.lit(0).cast("long"))
    sizes = {r["mix_pool"]: r["count"] for r in slim.groupBy("mix_pool").count().collect()}  # one row per weight
    length, slots = period_of({s: w for s, w in weights.items() if s in sizes} or {REST: 1})
    ends = {s: _slot_of(-(-n // block_rows), slots[s], length) for s, n in sizes.items()}
    exact = min(ends.values(), default=0)
    table = docs.sparkSession.createDataFrame(
        [(s, i, slot, len(at)) for s, at in slots.items() for i, slot in enumerate(at)], "__s string, __i long, __slot long, __each long"
    )
    placed = ranked(slim, "mix_pool", [F.col("__id"), F.col("__row")], "__rank", piece).withColumn("mix_block", F.floor(F.col("__rank") / block_rows))
    each = {s: len(at) for s, at in slots.items()}
    per = F.coalesce(*[F.when(F.col("mix_pool") == s, F.lit(n)) for s, n in each.items()])
    placed = (
        placed.withColumn("__in", F.col("mix_block") % per)
        .join(F.broadcast(table), (F.col("mix_pool") == F.col("__s")) & (F.col("__in") == F.col("__i")))  # one row per slot of the period
        .withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("__each")) * length + F.col("__slot"))
        .select(
            F.col("__key").alias("__k"), F.col("__id").alias("__i"), F.col("__row").alias("__r"),
            "mix_block", "mix_slot", (F.col("__rank") % block_rows).alias("mix_row"),
        )
        .withColumn("mix_exact", F.col("mix_slot") < exact)
        .hint("merge")  # one row per document: too many to broadcast
    )
    same = (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r"))
    return rows.join(placed, same).select(*names, *made)


def _slot_of(block: int, slots: list[int], length: int) -> int:
    return block // len(slots) * length + slots[block % len(slots)]

"""Helpers the corpus operators share: durable tables, text expressions, Arrow streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see (``spark.checkpoint.dir``).

    Only where the session has none and runs on one machine (tests, a notebook)
    is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuscle-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession) -> str:
    """A new place for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corpuscle/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with its end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Add ``df`` to the Parquet table at ``path`` (in folders by column ``by``)."""
    with _shuffles_dropped(df.sparkSession):
        df.write.mode("append").parquet(path, partitionBy=by)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (in folders by column ``by``) and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    append(df, path, by)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only the steps of one operator read; they are deleted once no step needs them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def materialize(self, *parts: DataFrame, by: str | None = None) -> DataFrame:
        """``parts``, which have the same columns, written one after the other into one table (in folders by column ``by``)."""
        path = fresh_path(self.spark)
        for part in parts:
            append(part, path, by)
        return self.hold(path, parts[0].schema)

    def hold(self, path: str, schema) -> DataFrame:
        """The table that was written to ``path``."""
        self.held.append((self.spark.read.schema(schema).parquet(path), path))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all."""
        gone = [h for h in self.held if not tables or any(h[0] is t for t in tables)]
        self.held = [h for h in self.held if all(h is not g for g in gone)]
        for _, path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of those names, if it has any."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, hot: int = 2000) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``table`` (one row per key); the table's other columns but ``weight`` are added.

    ``weight`` is how many rows a key has, of ``total`` in all. Keys with more
    than one in ``hot`` of all rows are at most ``hot`` in number: they are
    broadcast, so no task gathers a frequent key. The rest are joined by key, and
    rows that have met a frequent one are dealt at random there.
    """
    added = [c for c in table.columns if c not in (key, weight)]
    many = F.col(weight) * hot > F.lit(total)
    often = table.where(many).select(F.col(key).alias("__k1"), F.lit(True).alias("__met"), *[F.col(c).alias(f"__1{c}") for c in added])
    rest = table.where(~many).select(F.col(key).alias("__k2"), F.lit(-1).alias("__d2"), *[F.col(c).alias(f"__2{c}") for c in added])
    met = rows.join(F.broadcast(often), F.col(key) == F.col("__k1"), "left")
    met = met.withColumn("__d", F.when(F.col("__met"), F.floor(F.rand(7) * 100_000).cast("int")).otherwise(-1))
    whole = met.join(rest, (F.col(key) == F.col("__k2")) & (F.col("__d") == F.col("__d2")), "left")
    return whole.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"__1{c}", f"__2{c}").alias(c) for c in added])


def text_chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list]]:
    """Ranges of a text column as ``text_chunks`` gives them, each with its texts; only one is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes), column.slice(start).to_pylist()


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one record batch into any number of them."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], unique: str | None = None, limit: int | None = None, min_rows: int = 1
) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Groups of consecutive rows with equal integer ``keys``, as numpy columns.

    The input is a stream sorted by ``keys`` (and ``unique``); a group may span
    batches. Rows that repeat ``unique`` within a group count once. A group of
    more than ``limit`` rows comes in pieces, each marked True, so no group is
    ever held whole; other groups come whole, marked False, and only if they
    have ``min_rows`` rows.
    """
    held: list[dict[str, np.ndarray]] = []
    hot = False

    def closed():
        whole = _joined(held)
        return [(whole, hot)] if hot or len(whole[keys[0]]) >= min_rows else []

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        if held:
            new[0] = any(held[-1][k][-1] != cols[k][0] for k in keys)
        if unique:
            fresh = new.copy()
            fresh[1:] |= cols[unique][1:] != cols[unique][:-1]
            if held and not new[0]:
                fresh[0] = held[-1][unique][-1] != cols[unique][0]
            cols, new = {n: c[fresh] for n, c in cols.items()}, new[fresh]
        starts = np.flatnonzero(new)
        rows = len(new)
        first = int(starts[0]) if len(starts) else rows
        if first:
            held.append({n: c[:first] for n, c in cols.items()})
        if len(starts):
            if held:
                yield from closed()
            hot = False
            sizes = np.diff(np.append(starts, rows))
            for g in np.flatnonzero(sizes[:-1] >= min_rows):
                piece = {n: c[starts[g] : starts[g] + sizes[g]] for n, c in cols.items()}
                if limit and sizes[g] > limit:
                    yield piece, True
                else:
                    yield piece, False
            held = [{n: c[starts[-1] :] for n, c in cols.items()}]
        if limit and sum(len(h[keys[0]]) for h in held) > limit:
            hot = True
            yield _joined(held), True
            held = [{n: c[-1:] for n, c in held[-1].items()}]
    if held:
        yield from closed()


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def linked_rows(owner: np.ndarray, number: np.ndarray, rows: int, values: int, least: float) -> list[tuple[int, int]]:
    """Edges that join all of ``rows`` sets linked by a Jaccard similarity of ``least`` or more.

    The sets are pairs of a row (0 to rows - 1) and an element (0 to values - 1),
    repeats allowed.
    """
    pairs = np.sort(owner.astype(np.int64) * values + number)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    owner, number = pairs // max(values, 1), pairs % max(values, 1)
    sizes = np.bincount(owner, minlength=rows)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(values, bool)
    found: list[tuple[int, int]] = []
    waiting = np.ones(rows, bool)
    for seed in range(rows):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue and waiting.any():
            x = queue.pop()
            own = number[starts[x] : starts[x + 1]]
            mark[own] = True
            both = np.bincount(owner[mark[number]], minlength=rows)
            mark[own] = False
            near = np.flatnonzero(waiting & (both > 0) & (both >= least * (sizes + sizes[x] - both)))
            found += [(x, int(y)) for y in near]
            waiting[near] = False
            queue += near.tolist()
    return found

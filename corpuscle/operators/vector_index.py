"""An approximate vector index: k-means lists as table partitions, queries read the nearest lists only."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import durable, shared_folder
from .search import TILE, _best, _blocks

#: Rows that the lists are fitted on: those of least hash, so the sample is the same each time.
SAMPLE_ROWS = 20_000
SEED = 42
#: Rows of one file of a list; a list of more has several files.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class VectorIndex:
    """``path`` holds the table (vec_id, v, list), in a folder for each list; ``centres`` are the lists' unit centroids."""

    spark: SparkSession
    path: str
    schema: str
    centres: np.ndarray
    probes: int

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _sample(vectors: DataFrame, rows: int) -> DataFrame:
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return durable(vectors.where(size > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select(F.col("v").cast("array<double>").alias("v")))


def fit_lists(sample: DataFrame, lists: int) -> np.ndarray:
    """Unit centroids of ``lists`` clusters by cosine, fitted on a sample (v)."""
    model = KMeans(k=lists, seed=SEED, maxIter=20, distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("features")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float, asked: int = 500, k: int = 10) -> int:
    """How many lists a query reads so that ``target`` of its k nearest rows of the sample lie in them.

    The first ``asked`` rows ask; each neighbour counts by the place of its list among the lists nearest to the row.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    own = np.argmax(unit @ centres.T, axis=1)
    ask = unit[:asked]
    near = ask @ unit.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -2.0
    best = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
    place = np.argsort(np.argsort(-(ask @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]) + 1 if len(depth) else 1


def build_vector_index(vectors: DataFrame, lists: int | None = None, probes: int | None = None, sample_rows: int = SAMPLE_ROWS, target: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", path: str | None = None) -> VectorIndex:
    """Fits lists on a sample and writes every row to the list of its nearest centroid.

    ``lists`` is the square root of the row count unless given; ``probes``, the lists that a query reads, are as many
    as hold ``target`` of the nearest neighbours within the sample. Null vectors and those without length or of another length than the first are not indexed, as no query
    matches them; an empty table has one list. A list of any size is dealt to files of ``FILE_ROWS``.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("v is not null and size(v) > 0")
    rows = slim.count()
    lists = lists or max(1, math.isqrt(rows))
    sample = _sample(slim, sample_rows) if rows > lists > 1 else None
    centres = fit_lists(sample, lists) if sample else np.ones((1, 1))
    if sample and not probes:
        probes = probes_for(np.array([r["v"] for r in sample.collect()]), centres, target)  # ``sample_rows`` at most
    given = spark.sparkContext.broadcast(centres)  # as many as there are lists
    alone = len(centres) == 1

    def nearest(batches):
        for batch in batches:
            size = centres.shape[1]
            values = batch.column(1).to_pylist()
            fits = np.array([i for i, v in enumerate(values) if alone or len(v) == size], np.int64)
            found = np.zeros(len(fits), np.int32)
            if not alone and len(fits):
                m = np.array([values[i] for i in fits], np.float64)
                norm = np.linalg.norm(m, axis=1)
                found = np.argmax(m @ given.value.T, axis=1).astype(np.int32)
                fits, found = fits[norm > 0], found[norm > 0]
            kept = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(found)], names=["vec_id", "v", "list"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = f"vec_id {kinds['vec_id']}, v {kinds['v']}, list int"
    placed = slim.mapInArrow(nearest, schema)
    at = path or f"{shared_folder(spark).rstrip('/')}/vectors/{uuid.uuid4().hex}"
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // FILE_ROWS // max(1, lists) + 1)))
    placed.repartition("list", deal).write.partitionBy("list").option("maxRecordsPerFile", FILE_ROWS).parquet(at)
    return VectorIndex(spark, at, schema, centres, probes or 1)


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k best by cosine in the ``probes`` lists nearest to each query (query_id, embedding).

    Queries go in blocks of bounded size, like those of ``vector_topk``, which stays as the exact way; all lists as
    probes give its result. A block reads the folders of its lists, and each task scores a list's rows against the
    queries that asked for the list.
    """
    probes = min(probes or index.probes, len(index.centres))
    alone = len(index.centres) == 1
    parts = []
    for ids, block in _blocks(queries):
        sizes = np.linalg.norm(block, axis=1) if len(ids) else np.zeros(0)
        ids, unit = ids[sizes > 0], (block[sizes > 0] / sizes[sizes > 0, None] if len(ids) else block)
        near = np.zeros((len(ids), 1), np.int64) if alone or not len(ids) else np.argsort(-(unit @ index.centres.T), axis=1, kind="stable")[:, :probes]
        wanted = sorted({int(x) for x in near.ravel()})
        rows = index.table().where(F.col("list").isin(wanted))
        parts.append(_scored(rows, ids, unit, near, k, least))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _scored(rows: DataFrame, ids: np.ndarray, unit: np.ndarray, near: np.ndarray, k: int, least: float | None) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast((ids, unit, near))  # one block of the stated queries

    def run(batches):
        own_ids, own, lists_of = given.value
        for batch in batches:
            lists = batch.column(2).to_numpy()
            for one in np.unique(lists):
                asks = np.flatnonzero((lists_of == one).any(axis=1))
                at = np.flatnonzero(lists == one)
                m = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.float64)
                size = np.linalg.norm(m, axis=1)
                if not len(asks) or not (size > 0).any():
                    continue
                names, m = batch.column(0).to_numpy()[at][size > 0], m[size > 0] / size[size > 0, None]
                step = max(1, TILE // len(names))
                for i in range(0, len(asks), step):
                    some = asks[i : i + step]
                    q, r, score = _best(own[some] @ m.T, names, k, least)
                    yield pa.RecordBatch.from_arrays([pa.array(own_ids[some[q]]), pa.array(names[r]), pa.array(score)], names=["query_id", "vec_id", "similarity"])

    return rows.select("vec_id", "v", "list").mapInArrow(run, "query_id long, vec_id long, similarity double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the part of the exact neighbours (query_id, vec_id) that were found."""
    met = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    each = met.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("part"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("part").alias("recall"))

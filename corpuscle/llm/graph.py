"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    the edge table no longer changes. Each round is written to the shared
    folder, in place of the one before; only its row count and checksum reach
    the driver. The result reads the last round, which ``scratch`` holds if given.
    A hub is never gathered: its least neighbour is a partial aggregate that is
    joined back.
    Self-loops and repeated edges are allowed, rows with a null end are ignored,
    no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.materialize(edges)
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first()
        if mark[0] == 0 or tuple(mark) == before:
            break
        before = tuple(mark)
        last, edges = edges, scratch.materialize(_small_star(_large_star(edges)))
        scratch.drop(last)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())

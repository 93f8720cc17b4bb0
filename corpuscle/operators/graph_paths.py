"""How two entities are connected: directed searches from both ends, with the path that joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import durable


def _step(edges: DataFrame, frontier: DataFrame, seen: DataFrame, distance: int) -> DataFrame:
    """(end, node, distance, parent, relation) of the nodes that the frontier reaches first; ``edges`` is (here, there, relation)."""
    met = edges.join(frontier.select("end", F.col("node").alias("here")), "here")
    new = met.join(seen.select("end", F.col("node").alias("there")), ["end", "there"], "left_anti")
    # The least parent and relation are taken where several lead there: a partial aggregate, however many there are.
    first = new.groupBy("end", F.col("there").alias("node")).agg(F.min(F.struct(F.col("here").alias("parent"), "relation")).alias("via"))
    return durable(first.select("end", "node", F.lit(distance).cast("long").alias("distance"), "via.parent", "via.relation"))


def connections(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """(pair_id, distance, meeting, nodes, relations): the shortest directed path of each pair (pair_id, start, goal).

    ``edges`` is (src, dst, relation). One search follows edges from the start, one goes against them from the goal,
    in turns, up to ``depth`` steps each; each reached node remembers the least (parent, relation) that leads to it. A pair is done
    when a node is known to both; of several meeting nodes the one of the shortest path counts, then the least. The path
    is folded back from there to both ends. Pairs that don't meet have no row; start and goal alike have distance 0, no
    relation and one node; pairs with a null end have no row; ``pair_id`` must be unique.

    What is reached depends on the end alone, so pairs that share a start or a goal share its search. Every step joins
    one frontier with the edges and is written to the shared folder; only ends of pairs that are still open go on. A
    pair that is open after a step can meet in the two latest frontiers only, so those alone are compared. Nothing is
    gathered but the paths themselves, 2 * ``depth`` relations at most.
    """
    kind, via = edges.schema["src"].dataType.simpleString(), edges.schema["relation"].dataType.simpleString()
    ends = [F.col(end).cast(kind).alias(end) for end in ("start", "goal")]
    open_pairs = given = durable(pairs.where("pair_id is not null and start is not null and goal is not null").select("pair_id", *ends))
    ahead = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "relation").where("src is not null and dst is not null")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "relation").where("src is not null and dst is not null")

    def seeds(end: str) -> DataFrame:
        none = F.lit(None)
        return durable(given.select(F.col(end).alias("end")).distinct().select("end", F.col("end").alias("node"), F.lit(0).cast("long").alias("distance"), none.cast(kind).alias("parent"), none.cast(via).alias("relation")))

    seen = {"start": seeds("start"), "goal": seeds("goal")}
    edge = dict(seen)
    met = []
    for turn in range(2 * depth + 1):
        a, b = (edge[end].select(F.col("end").alias(end), "node") for end in ("start", "goal"))
        both = open_pairs.join(a, "start").join(b, ["goal", "node"]).groupBy("pair_id", "start", "goal").agg(F.min("node").alias("meeting"))
        met.append(durable(both.select("pair_id", "start", "goal", F.lit(turn).cast("long").alias("distance"), "meeting")))
        if turn == 2 * depth:
            break
        open_pairs = durable(open_pairs.join(met[-1].select("pair_id"), "pair_id", "left_anti"))
        end = ("start", "goal")[turn % 2]
        going = edge[end].join(open_pairs.select(F.col(end).alias("end")).distinct(), "end", "left_semi")
        edge[end] = _step(ahead if end == "start" else back, going, seen[end], turn // 2 + 1)
        seen[end] = seen[end].unionByName(edge[end])
    none = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<{via}>")
    walk = reduce(DataFrame.unionByName, met).withColumns({"here": F.col("meeting"), "before": none[0], "by": none[1], "there": F.col("meeting"), "after": none[0], "to": none[1]})
    for _ in range(depth):
        for end, at, nodes, relations in (("start", "here", "before", "by"), ("goal", "there", "after", "to")):
            pointer = seen[end].where("parent is not null").select(F.col("end").alias(end), F.col("node").alias(at), "parent", "relation")
            joined = walk.join(pointer, [end, at], "left")
            more = F.col("parent").isNotNull()
            one, link = F.array("parent"), F.array("relation")
            grown = {
                nodes: F.when(more, F.concat(one, nodes) if end == "start" else F.concat(nodes, one)).otherwise(F.col(nodes)),
                relations: F.when(more, F.concat(link, relations) if end == "start" else F.concat(relations, link)).otherwise(F.col(relations)),
                at: F.coalesce("parent", at),
            }
            walk = joined.withColumns(grown).drop("parent", "relation")
    return walk.select("pair_id", "distance", "meeting", F.concat("before", F.array("meeting"), "after").alias("nodes"), F.concat("by", "to").alias("relations"))

"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_join, linked_rows, map_arrow, materialize, sorted_groups, without
from .graph import connected_components

#: (shift, width) of the blocks of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Members of one bucket that are compared in one piece; larger buckets are tiled.
TILE = 4096
#: Blocks of a wide fingerprint that are dealt at once. The more rows, the more blocks; what a pass deals stays.
PASS_BLOCKS = 16


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of a whole text's word shingles, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(b" ".join(w), 42)] if w else [], dtype=np.uint64)
    flat = b" ".join(w)
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(w) - words]]]
    return np.array([digest(flat[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], dtype="<u8")


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a whole text: majority bits of XXH64 (seed 42) over its word shingles."""
    hashes = shingle_hashes(text, words)
    return int(np.packbits(majority_bits(hashes, 1), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def majority_bits(hashes: np.ndarray, count: int, even: bool = False) -> np.ndarray:
    """64 * ``count`` bits: the majority bits of the hashes, then of ``count`` - 1 further hashes of each.

    A tie gives 0, or with ``even`` the bit of the least hash, so that the bits of
    short texts are ones as often as zeros.
    """
    ones = np.zeros(64 * count, np.int64)
    for i in range(0, len(hashes), 8192):
        lanes = _bits_of(hashes[i : i + 8192], count).view(np.uint64)
        # Eight one-byte counters are added at a time, in runs too short to overflow them.
        runs = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += runs.view(np.uint8).reshape(-1, 64 * count).sum(0, dtype=np.int64)
    if even and len(hashes):
        return 2 * ones + _bits_of(hashes.min(keepdims=True), count)[0] > len(hashes)
    return 2 * ones > len(hashes)


def _bits_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """A row of 64 * ``count`` bytes, 0 or 1, for each hash: its bits and those of ``count`` - 1 hashes of it."""
    x = hashes[:, None] ^ np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift in (30, 27):
        x[:, 1:] ^= x[:, 1:] >> np.uint64(shift)
        x[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8).reshape(len(x), 8 * count), axis=1, bitorder="little")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 4) -> DataFrame:
    """``docs`` and its 64-bit fingerprint (as a signed long) in column ``out``."""
    docs = without(docs, out)
    at = docs.columns.index(text)

    def run(batch):
        marks = np.array([fingerprint(t, words) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, out])

    return map_arrow(docs, run, docs.select("*", F.lit(0).cast("long").alias(out)).schema)


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join all of ``prints`` (distinct) that are linked at ``distance`` or fewer bits."""
    marks = np.unique(prints)
    u = marks.view(np.uint64)
    edges: list[tuple[int, int]] = []
    left = np.arange(len(u))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(u[left] ^ u[x]) <= distance
            if near.any():
                got = left[near]
                edges += [(int(marks[x]), int(marks[y])) for y in got]
                queue += got.tolist()
                left = left[~near]
    return edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def near_links(prints: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` within ``distance`` bits.

    Six blocks, of which ``distance`` can differ: a close pair agrees in at least
    two, so each pair of blocks (21 bits or so) is a join key. A bucket gives the
    edges of a spanning forest, never all its pairs. A bucket of more than
    ``tile`` members is dealt into chunks, and each pair of chunks is compared in
    its own task group, so no bucket is gathered whole.
    """
    same = len(BLOCKS) - distance
    if not 0 < same <= len(BLOCKS):
        raise ValueError(f"distance must be between 0 and {len(BLOCKS) - 1}")
    keys = []
    for n, chosen in enumerate(combinations(BLOCKS, same)):
        key, used = F.lit(0).cast("long"), 0
        for shift, width in chosen:
            if used + width <= 56:  # fewer bits only make the bucket larger
                key = key.bitwiseOR(F.shiftleft(F.shiftright(F.col("fp"), shift).bitwiseAND((1 << width) - 1), used))
                used += width
        keys.append(F.shiftleft(key, 6).bitwiseOR(F.lit(n).cast("long")))
    members = prints.select("fp", F.explode(F.array(*keys)).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "fp")

    def first(batches):
        edges: list[tuple[int, int]] = []
        for group, over in sorted_groups(batches, ["bucket"], "fp", tile, 2):
            if over:
                n = len(group["fp"])
                yield pa.RecordBatch.from_arrays([pa.array(group["fp"]), pa.nulls(n, pa.int64()), pa.array(group["bucket"])], names=["a", "b", "bucket"])
            else:
                edges += _forest(group["fp"], distance)
            if len(edges) > 50_000:
                yield _wide(edges)
                edges = []
        if edges:
            yield _wide(edges)

    def _wide(edges):
        e = _edge_batch(edges)
        return pa.RecordBatch.from_arrays([*e.columns, pa.nulls(e.num_rows, pa.int64())], names=["a", "b", "bucket"])

    found = materialize(members.mapInArrow(first, "a long, b long, bucket long"))
    crowded = found.where("bucket is not null").select(F.col("a").alias("fp"), "bucket").distinct()

    def tiled(batches):
        for group, _ in sorted_groups(batches, ["bucket", "i", "j"], "fp", None, 2):
            if edges := _forest(group["fp"], distance):
                yield _edge_batch(edges)

    tiles = deal_tiles(crowded, "bucket", "fp", tile).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return found.where("bucket is null").select("a", "b").union(tiles.mapInArrow(tiled, "a long, b long"))


def deal_tiles(members: DataFrame, key: str, ident: str, tile: int) -> DataFrame:
    """Members of large groups dealt into chunks; every two chunks (i <= j) of a group meet in a tile."""
    n = F.count(F.lit(1))
    sizes = members.groupBy(key).agg(n.alias("members"), F.ceil(n / tile).cast("int").alias("chunks"))
    return (
        hot_join(members, sizes, key, "members", members.count())
        .withColumn("c", F.pmod(F.xxhash64(ident), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*members.columns, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, words: int = 4) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    component_id is the smallest id reachable over links of ``distance`` or fewer
    differing bits, the document itself included. Exact copies share a
    fingerprint and count once in the search. Null or blank texts have
    fingerprint zero and are linked like any other; a null id stays null and is
    never a component's smallest unless all are null; repeated rows are kept; an
    empty table gives no rows. Very long texts are hashed whole.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    at = materialize(with_fingerprints(slim, "text", "fp", words).select("doc_id", "fp"))
    return (
        hot_join(at, materialize(_component_of_print(at, distance)), "fp", "n", at.count())
        .select(F.col("doc_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def _component_of_print(at: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id, n) for every distinct fp of (doc_id, fp), which n rows have."""
    prints = at.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = materialize(connected_components(near_links(prints.select("fp"), distance)))
    linked = prints.join(roots, prints.fp == roots.node).groupBy("root").agg(F.min("least").alias("component_id"))
    whole = roots.join(linked, "root").select(F.col("node").alias("fp"), "root", F.col("component_id").alias("linked"))
    own = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("linked"))
    return prints.join(whole, "fp", "left").select("fp", own.alias("component_id"), "n")


@dataclass(frozen=True)
class BlockPlan:
    """Blocks of a wide fingerprint: a pair of texts is compared if one of ``blocks`` of ``width`` bits is equal."""

    width: int
    blocks: int

    @staticmethod
    def of(rows: int, similarity: float, recall: float) -> BlockPlan:
        """Blocks as wide as keeps unlike texts apart (a handful of ``rows`` by chance in one), as many as find ``recall`` of the pairs at ``similarity``.

        Two texts of Jaccard similarity j have a cosine of 2 j / (1 + j) and agree
        in a bit with probability 1 - acos(cosine) / pi.
        """
        width = max(8, rows.bit_length() - 2)
        agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** width
        return BlockPlan(width, math.ceil(math.log(1 - recall) / math.log(1 - agree)))

    def keys(self, packed: np.ndarray, first: int, last: int) -> np.ndarray:
        """Of rows of packed bits, the keys of blocks ``first`` to ``last`` - 1."""
        start, end = first * self.width, last * self.width
        bits = np.unpackbits(packed[:, start // 8 : -(-end // 8)], axis=1, bitorder="little")[:, start % 8 :]
        value = np.zeros((len(packed), last - first), np.int64)
        for i in range(self.width):
            value |= bits[:, i : end - start : self.width].astype(np.int64) << i
        return (value << 12) + np.arange(first, last)


def _with_blocks(docs: DataFrame, plan: BlockPlan, words: int) -> DataFrame:
    """(doc_id, mark, node, fp, bits) of (doc_id, mark, node, text); ``bits`` are those of all blocks, in bytes."""
    count = -(-plan.width * plan.blocks // 64)

    def run(batch):
        bits = [np.packbits(majority_bits(shingle_hashes(t, words), count, even=True), bitorder="little") for t in batch.column(3).to_pylist()]
        prints = np.array([x[:8].view(np.int64)[0] for x in bits], np.int64)
        columns = [*batch.columns[:3], pa.array(prints), pa.array([x.tobytes() for x in bits], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "fp", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, mark long, node long, fp long, bits binary")


def _block_members(nodes: DataFrame, plan: BlockPlan, first: int, last: int) -> DataFrame:
    """(node, fp, bucket) of (node, fp, bits): every node in each of blocks ``first`` to ``last`` - 1."""

    def run(batch):
        for a in range(0, batch.num_rows, 2000):
            node, fp, bits = batch.slice(a, 2000).columns
            keys = plan.keys(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1), first, last)
            columns = [np.repeat(x.to_numpy(), last - first) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(keys.ravel())], names=["node", "fp", "bucket"])

    return map_arrow(nodes.select("node", "fp", "bits"), run, "node long, fp long, bucket long")


def _close_nodes(nodes: DataFrame, plan: BlockPlan, distance: int, tile: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect the nodes of (node, fp, bits) that share a block and differ in ``distance`` bits or fewer of fp.

    Blocks are dealt PASS_BLOCKS at a time and only edges are kept, so the disk
    that is used at once doesn't grow with their number.
    """

    def run(keys):
        def over(batches):
            edges: list[np.ndarray] = []
            for group, hot in sorted_groups(batches, keys, "node", tile if keys == ["bucket"] else None, 2):
                if hot:
                    n = len(group["node"])
                    yield pa.RecordBatch.from_arrays([pa.array(group["node"]), pa.nulls(n, pa.int64()), pa.array(group["fp"]), pa.array(group["bucket"])], names=["a", "b", "fp", "bucket"])
                    continue
                fp, node = group["fp"].view(np.uint64), group["node"]
                if len(fp) == 2:  # most buckets
                    if int(fp[0] ^ fp[1]).bit_count() <= distance:
                        edges.append(node[None, :])
                else:
                    left = np.arange(len(fp))
                    while len(left) > 1:
                        queue, left = [left[0]], left[1:]
                        while queue and len(left):
                            x = queue.pop()
                            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
                            got, left = left[near], left[~near]
                            if len(got):
                                edges.append(np.stack([np.full(len(got), node[x]), node[got]], axis=1))
                                queue += got.tolist()
            found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), none, none], names=["a", "b", "fp", "bucket"])

        return over

    schema = "a long, b long, fp long, bucket long"

    def linked(first: int) -> DataFrame:
        members = _block_members(nodes, plan, first, min(first + PASS_BLOCKS, plan.blocks))
        return members.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run(["bucket"]), schema)

    found = scratch.materialize(*map(linked, range(0, plan.blocks, PASS_BLOCKS)))
    crowded = found.where("bucket is not null").select("bucket", F.col("a").alias("node"), "fp").distinct()
    tiles = deal_tiles(crowded, "bucket", "node", tile).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return found.where("bucket is null").select("a", "b").union(tiles.mapInArrow(run(["bucket", "i", "j"]), schema).select("a", "b")).distinct()


def _similar_nodes(texts: DataFrame, similarity: float, words: int, tile: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of (root, node, text) whose shingle sets have a Jaccard similarity of ``similarity``, inside each root."""

    def run(keys):
        def over(batches):
            for group, _ in sorted_groups(batches, keys, "node", None, 2):
                sets = [shingle_hashes(t, words) for t in group["text"]]
                values, number = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                edges = linked_rows(owner, number, len(sets), len(values), similarity)
                if edges:
                    ends = group["node"][np.array(edges, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        return over

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in Python and not in bytes
    tiles = deal_tiles(texts, "root", "node", tile).select("root", "i", "j", "node", "text")
    tiles = tiles.repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return tiles.mapInArrow(run(["root", "i", "j"]), "a long, b long")


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    words: int = 5,
    recall: float = 0.95,
    distance: int = 18,
    tile: int = 256,
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Texts are linked if the sets of their ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more; groups are what links connect. At such a
    similarity 64-bit fingerprints differ in about 10 bits, too many for blocks
    that all close pairs share. So the fingerprint is widened by further hashes of
    each shingle, to as many blocks as bring ``recall`` of the pairs at the limit
    (more of closer ones) together in one; pairs that share a block are checked
    for ``distance`` or fewer of the first 64 bits, and their groups for exact
    similarity.

    Equal texts are one in the search; null and blank texts are all equal. Null
    ids come last, and of rows with the same id and text any one is kept.
    Ids, hashes, fingerprints and the texts of groups are written between, and
    deleted when they have been used. Columns are those of ``docs``; an empty table gives no rows.
    """
    names = docs.columns
    plan = BlockPlan.of(docs.count(), similarity, recall)

    def marked(rows: DataFrame) -> DataFrame:
        mark = F.xxhash64(*[F.col(f"`{n}`") for n in rows.columns])
        blank = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
        return rows.withColumns({"__mark": mark, "__node": F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64(text))})

    def slim(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(doc_id).alias("doc_id"), F.col("__mark").alias("mark"), F.col("__node").alias("node"), F.col(text).alias("text"))

    scratch = Scratch(docs.sparkSession)
    rows = marked(docs)
    at = scratch.materialize(_with_blocks(slim(rows), plan, words))
    if not at.groupBy("mark").count().where("count > 1").isEmpty():  # rows equal throughout: a number names each
        scratch.drop(at)
        rows = marked(materialize(docs.withColumn("__row", F.monotonically_increasing_id())))
        at = scratch.materialize(_with_blocks(slim(rows), plan, words))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    nodes = scratch.materialize(at.groupBy("node").agg(F.min(place).alias("first"), F.min("fp").alias("fp"), F.min("bits").alias("bits")))
    scratch.drop(at)
    loose = connected_components(_close_nodes(nodes, plan, distance, 4096, scratch), scratch)
    chosen = nodes.join(loose, "node").select("root", "node", F.col("first.mark").alias("__first"))
    texts = rows.join(chosen, F.col("__mark") == F.col("__first")).select("root", "node", F.col(text).alias("text"))
    linked = connected_components(_similar_nodes(scratch.materialize(texts), similarity, words, tile), scratch)
    kept = nodes.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.mark").alias("__kept")))
    scratch.drop()
    return rows.join(kept, F.col("__mark") == F.col("__kept"), "left_semi").select(*names)

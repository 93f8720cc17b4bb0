"""Jaccard self-join of word n-gram sets by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, materialize, sorted_groups
from .graph import connected_components
from .simhash import shingle_hashes

#: The part of all shingles, by hash, that comes first in the order of prefixes and whose frequencies are counted.
COUNTED = 0.2
#: The most shared tokens that a prefix can be lengthened to demand.
MOST = 8
#: Documents of one token that are paired there; the documents of a token that has more are compared in tiles.
CROWD = 32
#: Shingles of one side of a tile.
TILE = 1 << 18
_FLIP = np.uint64(1 << 63)


def shingle_set(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles (of the whole sequence, if it is shorter)."""
    return np.unique(shingle_hashes(text, words))


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order."""
    return (hashes ^ _FLIP).view(np.int64)


def spare(size: int, percent: int) -> int:
    """How many of a set's tokens a partner at ``percent`` or more can lack."""
    return size - -(-percent * size // 100)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _scan(docs: DataFrame, percent: int, words: int, counted: float) -> DataFrame:
    """(doc_id, mark, digest, n, counted, heads) of (doc_id, mark, text): a set's digest and size, and the tokens that its prefix can hold.

    Tokens of small hashes (a ``counted`` part) go before all others; those beyond them go by hash, and only as many
    as the longest prefix can reach.
    """
    least = np.uint64(min(int(counted * 2.0**64), (1 << 64) - 1))

    def run(batch):
        digests, sizes, firsts, heads = [], [], [], []
        for t in batch.column(2).to_pylist():
            found = shingle_set(t, words)
            n, few = len(found), int(np.searchsorted(found, least))
            digests.append(_digest(found))
            sizes.append(n)
            firsts.append(few)
            heads.append(_signed(found[: max(few, spare(n, percent) + MOST)]))
        offsets = np.append(0, np.cumsum([len(h) for h in heads])).astype(np.int32)
        flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        columns = [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "digest", "n", "counted", "heads"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, mark long, digest binary, n long, counted long, heads array<long>")


def choose_prefix(df: np.ndarray, place: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(matches, length): how many shared tokens a set demands of a partner, and the prefix that has to hold them.

    Two sets at ``percent`` or more share at least l tokens among the first
    ``spare`` + l of both, for every l up to the overlap; where two sets chose
    differently, the lesser l holds. A longer prefix meets more postings (its
    frequencies), but pairs that meet by chance are fewer. ``df`` and ``place``
    are frequencies and places of the tokens that others have, in order.
    """
    lacking = spare(n, percent)
    best = (float("inf"), 1)
    for matches in range(1, min(MOST, max(1, n - lacking)) + 1):
        met = float((df[place < lacking + matches] - 1).sum())
        best = min(best, (met * (1 + n / 16 / matches), matches))
    return best[1], lacking + best[1]


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, matches): the prefixes of (node, n, counted, token, place, df), of tokens that others have.

    Tokens that no other set has come first in the order and only count as places.
    """

    def run(batches):
        for g, _ in sorted_groups(batches, ["node"]):
            n, counted = int(g["n"][0]), int(g["counted"][0])
            first = g["place"] < counted
            by_df = np.lexsort((g["token"][first], g["df"][first]))
            token = np.append(g["token"][first][by_df], g["token"][~first])
            df = np.append(g["df"][first][by_df], g["df"][~first])
            place = np.append(np.arange(len(by_df)) + counted - len(by_df), g["place"][~first])
            matches, length = choose_prefix(df, place, n, percent)
            held = token[place < length]
            if len(held):
                columns = [pa.array(held), *[pa.array(np.full(len(held), x, np.int64)) for x in (g["node"][0], n, matches)]]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "n", "matches"])

    ordered = shared.select("node", "n", "counted", "token", "place", "df").repartition("node").sortWithinPartitions("node", "place")
    return ordered.mapInArrow(run, "token long, node long, n long, matches long")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether two sizes allow the similarity."""
    return percent * F.greatest(a, b) <= 100 * F.least(a, b)


def _counted_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of (a, b, matches), one row for each shared token, that share as many as they demand."""
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("matches").alias("matches")).where("shared >= matches").select("a", "b")


def _hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of each set and the least of its token's sets of about its size, and of the least of neighbouring sizes."""
    grade = F.floor(F.ln("n") / F.lit(float(-np.log(percent / 100)))).cast("long")
    graded = postings.withColumn("grade", grade).withColumn("key", F.xxhash64("token", "grade"))
    hub = F.min(F.struct(F.col("node"), F.col("n"), F.col("matches"))).alias("hub")
    hubs = materialize(graded.groupBy("token", "grade", "key").agg(hub, F.count(F.lit(1)).alias("members")))
    told = hot_join(graded, hubs.select("key", "hub", "members"), "key", "members", graded.count())
    inside = told.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"), F.least("matches", "hub.matches").alias("matches"))
    above = hubs.select("token", (F.col("grade") - 1).alias("grade"), F.col("hub").alias("other"))
    across = hubs.join(above, ["token", "grade"]).select(
        F.col("hub.node").alias("a"), F.col("other.node").alias("b"), F.col("hub.n").alias("na"), F.col("other.n").alias("nb"), F.least("hub.matches", "other.matches").alias("matches")
    )
    pairs = inside.union(across).where((F.col("a") != F.col("b")) & _fits("na", "nb", percent))
    return _counted_pairs(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "matches"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, n, tokens) are at ``percent`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def run(batch):
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
            both = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return map_arrow(pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "x", "y"), run, "a long, b long")


def _tiles(crowded: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Edges between sets of different components that meet in a crowd (root, node).

    The largest component of a crowd is compared with all that isn't in it, and the rest with each other: rows of a
    tile are sets outside the largest component, columns are all sets, ``tile`` shingles or one set on a side.
    A tile gives the edges of a forest over the components in it.
    """
    members = materialize(crowded.join(comps, "node").join(sets.select("node", "n"), "node"))
    groups = members.groupBy("root", "comp").agg(F.sum("n").alias("weight"))
    largest = groups.groupBy("root").agg(F.max(F.struct("weight", "comp")).alias("top"), F.sum("weight").alias("every"))
    sides = largest.select(
        "root", F.col("top.comp").alias("main"), F.ceil(F.col("every") / tile).cast("int").alias("columns"), F.ceil((F.col("every") - F.col("top.weight")) / tile).cast("int").alias("rows")
    ).where("rows > 0")
    # One row per crowd; a crowd of any size is dealt by its members, not by its name.
    counts = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    met = hot_join(members, materialize(sides.join(counts, "root")), "root", "members", members.count()).where("main is not null")
    deal = lambda sides: F.pmod(F.xxhash64("node"), F.col(sides)).cast("int")
    column = met.select("root", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), deal("columns").alias("j"), F.lit(False).alias("is_row"), "node", "comp")
    row = met.where("comp <> main").select("root", deal("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(True).alias("is_row"), "node", "comp")
    placed = column.union(row).join(sets.select("node", "tokens"), "node")

    def run(batches):
        held: dict[bool, list] = {False: [], True: []}
        key = None

        def edges():
            found = _across(held[True], held[False], percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(6))))
            for at, (root, i, j, is_row, node, comp) in enumerate(marks):
                if key != (root, i, j):
                    if held[True] and held[False]:
                        yield edges()
                    held, key = {False: [], True: []}, (root, i, j)
                held[is_row].append((node, comp, np.frombuffer(batch.column(6)[at].as_py(), np.int64)))
        if held[True] and held[False]:
            yield edges()

    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("root", "i", "j", "is_row", "node", "comp", "tokens").repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _across(rows: list, columns: list, percent: int) -> np.ndarray:
    """Pairs (row node, column node) at ``percent`` or more that connect what rows and columns connect: fewer than there are components."""
    sizes = np.array([len(c[2]) for c in columns])
    owner = np.repeat(np.arange(len(columns)), sizes)
    tokens = np.concatenate([c[2] for c in columns])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    found = []
    for node, comp, own in rows:
        lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(columns))
        for y in np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (both > 0)):
            here, there = top(comp), top(columns[y][1])
            if here != there:
                above[here] = there
                found.append((node, columns[y][0]))
    return np.array(found, np.int64).reshape(-1, 2)


def _labels(hubs: DataFrame, postings: DataFrame) -> DataFrame:
    """(node, comp): sets with one ``comp`` are connected by verified pairs; the least set that a set is linked with names it."""
    own = postings.select("node", F.col("node").alias("comp"))
    ends = hubs.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    first = materialize(own.union(ends).groupBy("node").agg(F.min("comp").alias("comp")))
    # The name of the one that names a set, so that hubs of other tokens take the name of the first.
    over = first.select(F.col("node").alias("comp"), F.col("comp").alias("named"))
    return first.join(over, "comp").select("node", F.col("named").alias("comp"))


def _wanted_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens) of the sets in ``wanted`` (node, n, mark, digest), from the texts of ``docs`` (mark, text).

    A bitmap of 2 ** 24 bits, whatever the size of the tables, keeps most other texts out of the join by mark.
    """
    slot, bit = F.shiftrightunsigned("mark", 46), F.col("mark").bitwiseAND(63)
    bits = wanted.select(slot.alias("slot"), bit.cast("int").alias("bit")).groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    met = docs.withColumn("slot", slot).join(F.broadcast(bits), "slot")  # 2 ** 18 rows at most
    met = met.where(F.expr("shiftrightunsigned(bits, cast(mark & 63 as int)) & 1 = 1")).select("mark", "text")
    named = wanted.select("mark", "node", "n", "digest")

    def run(batch):
        keep, sets = [], []
        for i, (t, digest) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            found = shingle_set(t, words)
            if _digest(found) == digest:  # else another text of the same mark
                keep.append(i)
                sets.append(_signed(found).tobytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], pa.array(sets, pa.binary())], names=["node", "n", "tokens"])

    texts = met.join(named, "mark").dropDuplicates(["node", "mark"]).select("node", "n", "text", "digest")
    return map_arrow(texts, run, "node long, n long, tokens binary")


def similar_sets(first: DataFrame, docs: DataFrame, percent: int, words: int, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all sets at ``percent`` or more.

    ``first`` is (node, mark, digest, n, counted, heads), a row for each set; ``docs`` is (mark, text).
    """
    flat = first.select("node", F.posexplode("heads").alias("place", "token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("weight", F.col("df"))
    total = first.agg(F.coalesce(F.sum(F.size("heads")), F.lit(0)).cast("long")).first()[0]
    shared = hot_join(flat, materialize(often), "token", "weight", total).where("df is not null")
    slim = first.select("node", "mark", "digest", "n", "counted")
    postings = materialize(_prefixes(shared.join(slim.select("node", "n", "counted"), "node"), percent))
    # Sets that have a token in their prefix that others have in theirs.
    meets = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("met", F.lit(True)))
    postings = materialize(hot_join(postings, meets, "token", "members", postings.count()).where("met").drop("met"))
    wanted = materialize(slim.join(postings.select("node").distinct(), "node", "left_semi"))
    sets = materialize(_wanted_sets(docs, wanted, words))
    hubs = materialize(_verified(_hub_pairs(postings, percent), sets, percent))
    # Tokens whose sets are all connected have nothing left to find.
    comps = materialize(_labels(hubs, postings))
    placed = postings.join(comps, "node")
    low_high = [F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("least")]
    unfinished = placed.groupBy("token").agg(F.count(F.lit(1)).alias("members"), *low_high).where("low < high")
    unfinished = materialize(unfinished.select("token", "members", F.col("members").alias("size"), "least"))
    left = materialize(hot_join(placed, unfinished, "token", "members", postings.count()).where("size is not null"))
    few = left.where(F.col("size") <= crowd)
    one, two = (few.select(F.col("token").alias(f"token{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "matches", "comp")]) for k in "ab")
    apart = (F.col("tokena") == F.col("tokenb")) & (F.col("nodea") < F.col("nodeb")) & (F.col("compa") != F.col("compb"))
    met = one.join(two, apart & _fits("na", "nb", percent))
    pairs = _counted_pairs(met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), F.least("matchesa", "matchesb").alias("matches")))
    # The least set names a crowd: tokens of the same sets mostly share it, so a set is in few crowds.
    crowds = left.where(F.col("size") > crowd).select("node", F.col("least").alias("root")).distinct()
    return hubs.union(_verified(pairs, sets, percent)).union(_tiles(crowds, comps, sets, percent, tile))


def join_similar(
    docs: DataFrame, percent: int = 85, words: int = 4, doc_id: str = "doc_id", text: str = "text", counted: float = COUNTED, crowd: int = CROWD, tile: int = TILE
) -> DataFrame:
    """One row per document: id, ``n_shingles`` (of its set), ``component_id`` (smallest id reachable by links).

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``percent`` of a
    hundred or more. Equal sets (by a 128-bit digest) are one set in the search. Tokens are ordered by a hash class,
    then frequency, then hash; each set picks how many shared tokens it demands by what the postings of its prefix
    cost, and lengthens the prefix by as many.

    A token's sets are first paired with one hub of their size and verified, so a group of near copies of any size
    is one component after as many pairs as it has members. Then sets of different components are paired at each
    token of up to ``crowd`` sets, and compared in tiles where a token has more. Pairs of sets that are connected
    already aren't made: links are given as components.

    Shingles are compared by 64-bit hashes. Null and blank texts have the empty set and are linked with nothing; a
    null id stays null and is never a component's smallest unless all are null; repeated rows are kept; an empty
    table gives no rows. Very long texts are taken whole.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    scanned = materialize(_scan(slim, percent, words, counted))
    filled = scanned.where("n > 0")
    first = filled.dropDuplicates(["digest"]).select("digest", "mark", "n", "counted", "heads")
    first = materialize(first.withColumn("node", F.monotonically_increasing_id()))
    edges = similar_sets(first, slim.select("mark", "text"), percent, words, crowd, tile)
    roots = materialize(connected_components(edges))
    names = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(names.join(first.select("digest", "node"), "digest"))
    smallest = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(roots, "node", "left").join(smallest, "root", "left").select("digest", F.coalesce("component_id", "least").alias("smallest"), "copies")
    out = hot_join(scanned.select("doc_id", "digest", "n"), materialize(linked), "digest", "copies", scanned.count())
    own = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"))

"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts are quantised to powers of two. An n-gram of level q is put into
the filter as (n-gram, 1) to (n-gram, q); its level is read back by probing
(n-gram, 1), (n-gram, 2), ... until a probe misses.

The filter is cut into slices. A pair lies in the slice of its own hash if its
second token is one of the frequent ones, which every worker knows, and else in
the slice of that token, beside the token's own entry. So whatever a position
of a text asks for lies in one slice: a filter too large for one broadcast is
used slice group by slice group, and each probe is dealt to its group once.

No pair occurs more often than either of its tokens, so its level is cut down to
theirs; a false hit then never gives a probability over one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, append, arrow_chunks, fresh_path, map_arrow, materialize

#: Bytes of text that are worked on at once in a task.
CHUNK_CHARS = 500_000
COUNT_CHARS = 1_500_000
#: Each slice of the hash space has a filter of its own, as large as its n-grams need; slices are made for about so many tokens each.
SLICE_TOKENS = 1 << 22
LEAST_SLICE_BITS, MOST_SLICE_BITS = 12, 28
BITS_PER_ENTRY = 8
PROBES = 3
#: Bytes of filter that are broadcast at once; a larger filter is used in as many passes.
PASS_BYTES = 128 << 20
#: Tokens that every worker knows with their counts; the others' exact counts are joined.
HOT_TOKENS = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x632BE59BD9B4E019)
_SPACES = bytes(1 if b == 0x20 or 0x09 <= b <= 0x0D else 0 for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = base
        have = _POWERS[name] = np.multiply.accumulate(out)
    return have[:n]


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by the end token; and where each text begins (and the last ends)."""
    encoded = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    space = np.frombuffer(data.tobytes().translate(_SPACES), np.uint8)
    edge = np.diff(np.concatenate((np.ones(1, np.int8), space.astype(np.int8))))
    first = np.flatnonzero(edge == -1)
    last = np.flatnonzero(edge == 1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    words = _mix((sums[last] - sums[first]) * _powers("down", _INVERSE, len(data))[first])
    bounds = np.cumsum([0, *[len(e) + 1 for e in encoded]])
    per = np.searchsorted(first, bounds)  # words before each text
    starts = per + np.arange(len(per))
    out = np.empty(len(words) + len(texts), np.uint64)
    out[starts[1:] - 1] = _END
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = words
    return out, starts


def pairs_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (a start mark for a text's first)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = _START
    return _mix(before * _ODD + tokens)


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _slices_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): exact counts of all tokens of the corpus."""
    at = docs.columns.index(text)

    def run(batch):
        for _, _, texts in arrow_chunks(batch.column(at), COUNT_CHARS):
            h, c = np.unique(tokens_of(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(c.astype(np.int64))], names=["h", "c"])

    return map_arrow(docs, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class HotTokens:
    """The frequent tokens and their counts, sorted by hash."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is one of these, its count or 0) of each token."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[i] == h
        return known, np.where(known, self.c[i], 0)


def count_pairs(docs: DataFrame, hot, bits: int, text: str = "text") -> DataFrame:
    """(s, h, c): counts of adjacent pairs of tokens by the slice they lie in."""
    at = docs.columns.index(text)

    def run(batch):
        for _, _, texts in arrow_chunks(batch.column(at), COUNT_CHARS):
            tokens, starts = tokens_of(texts)
            h, first, c = np.unique(pairs_of(tokens, starts), return_index=True, return_counts=True)
            second = tokens[first]
            u, inverse = np.unique(second, return_inverse=True)
            s = _slices_of(np.where(hot.value.find(u)[0][inverse], h, second), bits)
            yield pa.RecordBatch.from_arrays([pa.array(s), _signed(h), pa.array(c.astype(np.int64))], names=["s", "h", "c"])

    # Dealt by slice, so that one shuffle serves the sums and the filters alike.
    return map_arrow(docs, run, "s long, h long, c long").repartition("s").groupBy("s", "h").agg(F.sum("c").alias("c"))


def _level(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c)).astype(np.int64) + 1


_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _spots(h: np.ndarray, level: int, bits: np.ndarray) -> list[np.ndarray]:
    """The PROBES places of (n-gram, level) in a filter of ``bits`` (fewer than 2 ** 32)."""
    x = _mix(h + np.uint64(level * int(_ODD) % (1 << 64)))
    a, b = x >> _HALF, (x & _LOW) | np.uint64(1)
    return [(((a + np.uint64(k) * b) & _LOW) * bits) >> _HALF for k in range(PROBES)]


def build_filters(counts: DataFrame, per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(s, size, bits) of (s, h, c): one filter per slice, of ``per_entry`` bits for each level of each n-gram.

    Rows of a slice must be in one partition; a task holds the hashes of its own slices only.
    """
    names = counts.columns

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            s, h, c = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("s", "h", "c"))
            level = _level(c)
            order = np.argsort(s, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                if len(part):
                    held.setdefault(int(s[part[0]]), []).append((h[part].view(np.uint64), level[part].astype(np.int8)))
        for s, parts in held.items():
            h = np.concatenate([p[0] for p in parts])
            level = np.concatenate([p[1] for p in parts])
            size = -(-int(level.sum(dtype=np.int64)) * per_entry // 64) * 64
            flat = np.zeros(size, bool)
            for q in range(1, int(level.max()) + 1):
                for spot in _spots(h[level >= q], q, np.uint64(size)):
                    flat[spot] = True
            packed = np.packbits(flat, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([size]), pa.array([packed], pa.binary())], names=["s", "size", "bits"])

    return counts.mapInArrow(run, "s long, size long, bits binary")


class Filters:
    """Filters of some slices of ``bits``, side by side."""

    def __init__(self, packed: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int) -> None:
        slices, sizes, self.content = packed
        self.bits = bits
        self.least = int(slices.min()) if len(slices) else 0
        self.count = int(slices.max()) - self.least + 1 if len(slices) else 1
        self.offset = np.zeros(self.count, np.int64)
        self.size = np.zeros(self.count, np.uint64)
        self.offset[slices - self.least] = np.cumsum(sizes // 8) - sizes // 8
        self.size[slices - self.least] = sizes

    def level(self, h: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """Levels of n-grams (in the slice of ``by``, else their own) by repeated membership probes; 0 where no slice is here."""
        s = _slices_of(h if by is None else by, self.bits) - self.least
        s[(s < 0) | (s >= self.count)] = 0
        out = np.zeros(len(h), np.int8)
        left = np.flatnonzero(self.size[s] > 0)
        q = 1
        while len(left):
            at = s[left]
            offset = self.offset[at]
            met = np.ones(len(left), bool)
            for spot in _spots(h[left], q, self.size[at]):
                i = spot.astype(np.int64)
                met &= (self.content[offset + (i >> 3)] >> (i & 7).astype(np.uint8)) & 1 == 1
            left = left[met]
            out[left] = q
            q += 1
        return out


#: The count that a level stands for: the middle of 2 ** (q - 1) to 2 ** q - 1.
_COUNT = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64)])


@dataclass
class Smoothing:
    """The bigram model by levels: P(w | v) = (c(vw) + strength * P(w)) / (c(v) + strength)."""

    n: int
    v: int
    strength: float

    def __post_init__(self) -> None:
        self.floor = self.n + 0.1 * (self.v + 1)
        chance = np.minimum((_COUNT + 0.1) / self.floor, 1.0)  # a level may stand for more than its n-gram has
        #: log10 of the numerator by level of the pair and of its second token, and of the denominator by level of the first.
        self.above = np.log10(_COUNT[:, None] + self.strength * chance[None, :])
        self.below = np.log10(_COUNT + self.strength)


@dataclass(frozen=True)
class _Given:
    """Packed filters for all workers: of frequent tokens, other tokens and pairs, each or None."""

    key: str
    packed: Broadcast

    @staticmethod
    def of(spark: SparkSession, words, tokens, pairs, bits: int) -> _Given:
        return _Given(uuid.uuid4().hex, spark.sparkContext.broadcast((words, tokens, pairs, bits)))

    def filters(self) -> dict:
        """Built once per Python worker; those of another pass go first, so that a worker never holds two passes."""
        if _HELD.get("key") != self.key:
            _HELD.clear()
            words, tokens, pairs, bits = self.packed.value
            _HELD.update(words=words and Filters(words, LEAST_SLICE_BITS), tokens=tokens and Filters(tokens, bits), pairs=pairs and Filters(pairs, bits), key=self.key)
        return _HELD


_HELD: dict = {}


def score_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    strength: float = 2.0,
    pass_bytes: int = PASS_BYTES,
    hot_tokens: int = HOT_TOKENS,
    per_entry: int = BITS_PER_ENTRY,
) -> DataFrame:
    """Per document: base and Bloom-filter language-model scores of the whole text.

    Learns from documents whose crc32(id as text) mod 10 is not 0 and scores all.
    ``score`` is the log10 probability under a bigram model, smoothed towards the
    unigrams with ``strength`` pseudo-counts; all its counts are read from the
    filter. ``base_score`` uses exact unigram counts: those of the ``hot_tokens``
    most frequent tokens are broadcast, those of all others are joined.

    Everything broadcast is bounded: the frequent tokens' counts and filter by
    ``hot_tokens``, the filter of pairs and other tokens by ``pass_bytes``. If it
    fits, texts are scored in one scan. If not, one scan turns the texts into
    probes of about ten bytes, written to the slice group they ask and never
    shuffled; a pass then reads its own probes only. Pairs that are found and begin with a token that isn't frequent
    are dealt once more, to where that token's level lies. All passes append to
    one table, which is summed by document once: neither the bytes read nor the
    last plan grow with the number of passes.

    A null text is empty and has one token, the end; a null id counts as the empty
    string; repeated rows get equal scores; with no training documents all
    counts are zero; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _held_out(F.col(doc_id)).alias("held_out"))
    taught = slim.where(~F.col("held_out")).select("text")
    tokens = materialize(count_tokens(taught))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot_from = _hot_threshold(tokens, hot_tokens)
    frequent = (F.col("c") >= hot_from) | (F.col("h") == int(_END.view(np.int64)))
    known = tokens.where(frequent).toArrow()  # at most hot_tokens rows and the end
    hot = spark.sparkContext.broadcast(HotTokens(known["h"].to_numpy().view(np.uint64), known["c"].to_numpy()))
    bits = min(MOST_SLICE_BITS, max(LEAST_SLICE_BITS, (int(n) // SLICE_TOKENS).bit_length()))

    def by_slice(rows: DataFrame, width: int) -> DataFrame:
        return rows.withColumn("s", F.shiftrightunsigned("h", 64 - width)).select("s", "h", "c").repartition("s")

    words = materialize(build_filters(by_slice(tokens.where(frequent), LEAST_SLICE_BITS), per_entry))
    rare = materialize(build_filters(by_slice(tokens.where(~frequent), bits), per_entry))
    pairs = materialize(build_filters(count_pairs(taught, hot, bits), per_entry))
    groups = _slice_groups(pairs, rare, pass_bytes)
    model = Smoothing(int(n), int(v), strength)
    everywhere = _packed_filters(words)
    scored = slim.withColumn("row", F.monotonically_increasing_id())
    if len(groups) < 2:
        given = _Given.of(spark, everywhere, _packed_filters(rare), _packed_filters(pairs), bits)
        scored = materialize(_scored_at_once(scored, given, hot, model))
    else:
        scratch = Scratch(spark)
        given = _Given.of(spark, everywhere, None, None, bits)
        dealt = scratch.materialize(_with_probes(scored, given, hot, model, [last for _, last in groups], bits), by="pass")
        parts = materialize(_answered_by_passes(dealt, groups, rare, pairs, bits, model, scratch))
        known = materialize(dealt.where(F.col("pass") == -1).select("doc_id", "held_out", "row", *_MADE))
        scratch.drop()
        scored = known.join(parts, "row", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0))).drop("part")
    return _with_base(scored, tokens.where(~frequent), model).select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _slice_groups(pairs: DataFrame, rare: DataFrame, limit: int) -> list[tuple[int, int]]:
    """(first, last) slice of runs of slices whose filters take at most ``limit`` bytes (a larger slice is alone)."""
    sizes = pairs.select("s", "size").union(rare.select("s", "size")).groupBy("s").agg((F.sum("size") / 8).alias("bytes")).orderBy("s")
    groups: list[list[int]] = []
    held = 0.0
    for row in sizes.toLocalIterator():  # at most 2 ** MOST_SLICE_BITS small rows, one partition at a time
        if groups and held + row["bytes"] <= limit:
            groups[-1][1] = row["s"]
            held += row["bytes"]
        else:
            groups.append([row["s"], row["s"]])
            held = row["bytes"]
    return [(a, b) for a, b in groups]


def _packed_filters(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slices, bits of each, all contents) on the driver (their size was checked), by Arrow and so off its JVM heap."""
    got = rows.select("s", "size", "bits").toArrow()
    whole = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8)
    return got["s"].to_numpy(), got["size"].to_numpy(), whole


#: What a scan of the texts adds to each row: the base over frequent tokens, the others, and the score as far as it is known.
_MADE = {"n_tokens": "long", "n_hot": "long", "hot_sum": "double", "tail": "array<long>", "score": "double"}


@dataclass
class _Chunk:
    """Tokens of some texts, and what every worker knows of them."""

    tokens: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    known: np.ndarray  # of each position: is its token frequent
    level: np.ndarray  # of each position: the token's level, 0 if it isn't frequent

    @staticmethod
    def of(texts: list, hot: HotTokens, words: Filters, model: Smoothing) -> tuple[_Chunk, dict]:
        tokens, starts = tokens_of(texts)
        at, counts = starts[:-1], np.diff(starts)
        u, inverse = np.unique(tokens, return_inverse=True)
        known, c = hot.find(u)
        level = np.where(known, words.level(u), 0)[inverse]
        base = np.where(known, np.log10((c + 0.1) / model.floor), 0.0)
        known = known[inverse]
        sizes = np.concatenate(([0], np.cumsum(np.add.reduceat((~known).astype(np.int64), at))))
        made = {
            "n_tokens": pa.array(counts),
            "n_hot": pa.array(np.add.reduceat(known.astype(np.int64), at)),
            "hot_sum": pa.array(np.add.reduceat(base[inverse], at)),
            "tail": pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), _signed(tokens[~known])),
        }
        return _Chunk(tokens, starts, pairs_of(tokens, starts), known, level), made

    def before(self, values: np.ndarray, end) -> np.ndarray:
        """Of each position, the value of the token before it; texts start after ``end``."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts[:-1]] = end
        return out


def _end_level(words: Filters) -> int:
    return int(words.level(np.array([_END]))[0])


def _scored_at_once(docs: DataFrame, given, hot, model: Smoothing) -> DataFrame:
    """(doc_id, held_out, row) and _MADE, with the whole score."""
    names = docs.columns

    def run(batch):
        held = given.filters()
        end = _end_level(held["words"])
        made: dict[str, list] = {c: [] for c in _MADE}
        for _, _, texts in arrow_chunks(batch.column(names.index("text")), CHUNK_CHARS):
            chunk, base = _Chunk.of(texts, hot.value, held["words"], model)
            level, rare = chunk.level.astype(np.int64), ~chunk.known
            level[rare] = held["tokens"].level(chunk.tokens[rare])
            pair = held["pairs"].level(chunk.pairs, np.where(rare, chunk.tokens, chunk.pairs))
            before = chunk.before(level, end)
            p = model.above[np.minimum(pair, np.minimum(level, before)), level] - model.below[before]
            base["score"] = pa.array(np.add.reduceat(p, chunk.starts[:-1]))
            for c, x in base.items():
                made[c].append(x)
        keep = ["doc_id", "held_out", "row"]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), *(pa.concat_arrays(x) for x in made.values())], names=[*keep, *_MADE])

    return map_arrow(docs, lambda batch: run(batch) if batch.num_rows else (), _schema(docs))


def _schema(docs: DataFrame) -> str:
    keep = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "held_out", "row")]
    return ", ".join(keep + [f"{c} {t}" for c, t in _MADE.items()])


def _groups_of(hashes: np.ndarray, ends: list[int], bits: int) -> np.ndarray:
    """The slice group, of those that end at ``ends``, that each hash belongs to."""
    return np.minimum(np.searchsorted(np.array(ends), _slices_of(hashes, bits)), len(ends) - 1)


#: What a row of probes holds, as bytes of numbers.
_PROBES = {"ids": np.int64, "n": np.int32, "h": np.uint64, "q": np.int8, "w": np.uint64, "u": np.int8, "v": np.uint64}
_ASKS = {"ids": np.int64, "n": np.int32, "v": np.uint64, "p": np.int8, "q": np.int8}


#: Probes in a row. A page of a file holds a hundred rows at least, so rows must be small.
_PIECE = 4096


def _packed_row(kinds: dict, *values: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(x, kind).tobytes() for kind, x in zip(kinds.values(), values, strict=True)]


def _packed_columns(rows: list[list[bytes]]) -> list[pa.Array]:
    return [pa.array(x, pa.binary()) for x in zip(*rows)]


def _rows(batch: pa.RecordBatch, kinds: dict):
    """The numbers of each row of a batch whose columns are those of ``kinds``."""
    for k in range(batch.num_rows):
        yield [np.frombuffer(batch.column(i)[k].as_buffer(), kind) for i, kind in enumerate(kinds.values())]


def _by_text(text_of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n): the texts of probes that are in the order of texts, and how many each has."""
    t, n = np.unique(text_of, return_counts=True)
    return ids[t], n


def _with_probes(docs: DataFrame, given: _Given, hot, model: Smoothing, ends: list[int], bits: int) -> DataFrame:
    """Rows of pass -1 are documents, with what is known without pairs; others hold a chunk's probes of one pass.

    A probe is a pair's hash (``h``), the levels of its second and first token
    (``q``, ``u``; -1 if not known yet) and, of those that aren't known, the hashes
    (``w``, ``v``). Probes stand text by text, ``n`` for each of ``ids``.
    """
    names = docs.columns

    def run(batch):
        held = given.filters()
        end = _end_level(held["words"])
        keep = [batch.column(names.index(c)) for c in ("doc_id", "held_out", "row")]
        for a, b, texts in arrow_chunks(batch.column(names.index("text")), CHUNK_CHARS):
            chunk, base = _Chunk.of(texts, hot.value, held["words"], model)
            # A rare token's own count is asked by its probe, for it as the second of a pair and as the first of the next.
            after_known = chunk.before(chunk.known, True)
            before = chunk.before(chunk.level.astype(np.int64), end)
            first = chunk.before(chunk.tokens, np.uint64(0))
            share = np.where(after_known, -model.below[before], 0.0)
            base["score"] = pa.array(np.add.reduceat(share, chunk.starts[:-1]))
            size = b - a
            docs_part = [c.slice(a, size) for c in keep] + list(base.values())
            nothing = [pa.nulls(size, pa.binary()) for _ in _PROBES]
            yield pa.RecordBatch.from_arrays([*docs_part, pa.array(np.full(size, -1, np.int32)), *nothing], names=fields)
            goes = _groups_of(np.where(chunk.known, chunk.pairs, chunk.tokens), ends, bits)
            text_of = np.repeat(np.arange(size, dtype=np.int32), np.diff(chunk.starts))
            order = np.argsort(goes, kind="stable")
            cuts = np.flatnonzero(np.diff(goes[order])) + 1
            ids = keep[2].slice(a, size).to_numpy()
            pieces = [part[i : i + _PIECE] for part in np.split(order, cuts) for i in range(0, len(part), _PIECE)]
            packed = []
            for part in pieces:
                rare, open_ = ~chunk.known[part], ~after_known[part]
                values = [*_by_text(text_of[part], ids), chunk.pairs[part], np.where(rare, -1, chunk.level[part]), chunk.tokens[part][rare]]
                packed.append(_packed_row(_PROBES, *values, np.where(open_, -1, before[part]), first[part][open_]))
            empty = [pa.nulls(len(pieces), c.type) for c in docs_part]
            asked = pa.array([goes[part[0]] for part in pieces], pa.int32())
            yield pa.RecordBatch.from_arrays([*empty, asked, *_packed_columns(packed)], names=fields)

    fields = ["doc_id", "held_out", "row", *_MADE, "pass", *_PROBES]
    schema = _schema(docs) + ", pass int, " + ", ".join(f"{c} binary" for c in _PROBES)
    return map_arrow(docs, lambda batch: run(batch) if batch.num_rows else (), schema)


def _answered_by_passes(
    dealt: DataFrame, groups: list[tuple[int, int]], rare: DataFrame, pairs: DataFrame, bits: int, model: Smoothing, scratch: Scratch
) -> DataFrame:
    """(row, part): what all probes add to each text's score, by two rounds over the slice groups."""
    spark = dealt.sparkSession
    ends = [last for _, last in groups]
    first, second = fresh_path(spark), fresh_path(spark)
    for number, (least, most) in enumerate(groups):
        within = F.col("s").between(least, most)
        given = _Given.of(spark, None, _packed_filters(rare.where(within)), _packed_filters(pairs.where(within)), bits)
        append(_answered(dealt.where(F.col("pass") == number), given, model, ends, bits), first, by="pass")
        given.packed.destroy()
    answers = scratch.hold(first, _ANSWER)
    for number, (least, most) in enumerate(groups):
        asked = answers.where(F.col("pass") == number)
        given = _Given.of(spark, None, _packed_filters(rare.where(F.col("s").between(least, most))), None, bits)
        append(_settled(asked, given, model), second)
        given.packed.destroy()
    sums = answers.where(F.col("pass") == -1).select("row", "part").union(scratch.hold(second, "row long, part double"))
    return sums.groupBy("row").agg(F.sum("part").alias("part"))


#: Rows of pass -1 are parts of scores; others hold pairs (level ``p``) whose first token ``v`` another group knows.
_ANSWER = "row long, part double, ids binary, n binary, v binary, p binary, q binary, pass int"


def _answered(probes: DataFrame, given: _Given, model: Smoothing, ends: list[int], bits: int) -> DataFrame:
    """_ANSWER of the probes of one pass."""
    fields = ["row", "part", *_ASKS, "pass"]

    def run(batch):
        held = given.filters()
        rows, parts, packed, asked = [], [], [], []
        for ids, n, h, q, w, u, v in _rows(batch, _PROBES):
            t, rare, unknown = np.repeat(np.arange(len(ids)), n), q < 0, u < 0
            level, by = q.astype(np.int64), h.copy()
            level[rare], by[rare] = held["tokens"].level(w), w
            pair = np.minimum(held["pairs"].level(h, by), level)
            open_ = unknown & (pair > 0)
            pair = np.where(unknown, pair, np.minimum(pair, u))
            share = np.where(open_, 0.0, model.above[pair, level])
            share[rare] -= model.below[level[rare]]
            rows.append(ids)
            parts.append(np.bincount(t, share, len(ids)))
            asks, first = np.flatnonzero(open_), v[open_[unknown]]
            goes = _groups_of(first, ends, bits)
            for group in np.unique(goes):
                of = goes == group
                some = asks[of]
                packed.append(_packed_row(_ASKS, *_by_text(t[some], ids), first[of], pair[some], level[some]))
                asked.append(group)
        rows = pa.array(np.concatenate(rows))
        nothing = [pa.nulls(len(rows), pa.binary()) for _ in _ASKS]
        yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate(parts)), *nothing, pa.array(np.full(len(rows), -1, np.int32))], names=fields)
        if asked:
            empty = [pa.nulls(len(asked), x) for x in (pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*empty, *_packed_columns(packed), pa.array(asked, pa.int32())], names=fields)

    return map_arrow(probes.select(*_PROBES), lambda batch: run(batch) if batch.num_rows else (), _ANSWER)


def _settled(asked: DataFrame, given: _Given, model: Smoothing) -> DataFrame:
    """(row, part): what pairs add whose first token's level is read here."""

    def run(batch):
        held = given.filters()
        rows, parts = [], []
        for ids, n, v, p, q in _rows(batch, _ASKS):
            pair = np.minimum(p, held["tokens"].level(v)).astype(np.int64)
            share = model.above[pair, q.astype(np.int64)]
            rows.append(ids)
            parts.append(np.bincount(np.repeat(np.arange(len(ids)), n), share, len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, parts)], names=["row", "part"])

    return map_arrow(asked.select(*_ASKS), lambda batch: run(batch) if batch.num_rows else (), "row long, part double")


def _with_base(scored: DataFrame, rare: DataFrame, model: Smoothing) -> DataFrame:
    """Completes the exact base score with the tokens that are not broadcast."""
    tail = (
        scored.select("row", F.explode("tail").alias("h"))
        .join(rare, "h", "left")
        .groupBy("row")
        .agg(F.count("c").alias("tail_known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / float(model.floor))).alias("tail_sum"))
    )
    return (
        scored.join(tail, "row", "left")
        .withColumn("n_known", F.col("n_hot") + F.coalesce("tail_known", F.lit(0)))
        .withColumn("base_score", F.col("hot_sum") + F.coalesce("tail_sum", F.lit(0.0)))
    )


def _hot_threshold(tokens: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` tokens reach it (from a table of count classes)."""
    classes = tokens.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    total, found = 0, (1 << 62)
    for row in sorted(classes, key=lambda r: -r["k"]):
        total += row["n"]
        if total > most:
            break
        found = row["least"]
    return found

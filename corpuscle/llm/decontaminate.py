"""Benchmark decontamination: test n-grams as a broadcast hash set, verified word by word."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, materialize, text_chunks, without

#: Bytes that are words of the contract: 0-9, a-z (A-Z lower-cased) and everything from 0x80.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_END = b"\x01"  # never part of a word
#: Characters of benchmark text per broadcast; a larger benchmark is searched in several passes.
PASS_CHARS = 32_000_000
CHUNK_CHARS = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class _Index:
    """The n-grams of some benchmark items: windows as tuples of word numbers, and their rolling hashes."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[int]] = {}
        number = self.vocabulary
        for ident, text in items:
            w = [number.setdefault(x, len(number)) for x in words_of(text)]
            for window in {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else ():
                self.windows.setdefault(window, []).append(ident)
        self.lengths = sorted({len(w) for w in self.windows})
        self.hashes = {
            size: np.unique(np.array([_hash(np.array(w, np.int64), size)[0] for w in self.windows if len(w) == size], np.uint64)) for size in self.lengths
        }

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(first word, end, items) of every occurrence of a window; negative ids match nothing."""
        found = []
        known = np.append(0, np.cumsum(ids >= 0))
        for size in self.lengths:
            if len(ids) < size:
                continue
            table = self.hashes[size]
            h = _hash(ids, size)
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            at = at[table[np.minimum(np.searchsorted(table, h[at]), len(table) - 1)] == h[at]]
            for i in at.tolist():
                items = self.windows.get(tuple(ids[i : i + size].tolist()))
                if items:
                    found.append((i, i + size, items))
        return found


def _hash(ids: np.ndarray, size: int) -> np.ndarray:
    x = (ids + 2).astype(np.uint64) * _MULT
    x ^= x >> np.uint64(29)
    h = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        h = h * _MULT + x[k : len(ids) - size + 1 + k]
    return h


def _passes(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items, in lists of at most ``limit`` characters (a longer item is alone)."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():  # test sets, a few at a time; never the corpus
        if held and size + len(row.t) > limit:
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, pass_chars: int = PASS_CHARS
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges) and ``hit_items`` (item ids).

    A window is ``n`` consecutive words of an item, or the whole of a shorter
    one. A document word inside any occurrence of a window is hit. Documents are
    never shuffled: the window set is broadcast, up to ``pass_chars`` characters
    of benchmark text at a time, and a larger benchmark takes as many passes.
    Null texts have no words and match nothing; repeated items count once by id;
    a null item id is reported as null; an empty benchmark or table matches
    nothing. Existing columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "hit_spans", "hit_items")
    id_type = benchmark.schema[item_id].dataType
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("hit_items", T.ArrayType(id_type)),
        ]
    )
    done = docs
    for number, items in enumerate(_passes(benchmark, item_id, item_text, pass_chars)):
        if number:
            done = materialize(done)
        done = _search(done, spark.sparkContext.broadcast((uuid.uuid4().hex, items)), text, n, added, number > 0)
    return done


#: One index per broadcast and Python worker.
_BUILT: dict[str, _Index] = {}


def _search(docs: DataFrame, items, text: str, n: int, added: T.StructType, again: bool) -> DataFrame:
    base = docs.columns[:-3] if again else docs.columns
    at = base.index(text)
    schema = T.StructType([docs.schema[c] for c in base] + list(added))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batch):
        key, held = items.value
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = _Index(held, n)
        index = _BUILT[key]
        texts = batch.column(at).to_pylist()
        old_spans = batch.column(len(base) + 1).to_pylist() if again else [[]] * len(texts)
        old_items = batch.column(len(base) + 2).to_pylist() if again else [[]] * len(texts)
        counts, spans, found = [], [], []
        for a, b in text_chunks(texts, CHUNK_CHARS):
            for k, (total, got, who) in enumerate(_search_chunk(index, texts[a:b]), a):
                if old_spans[k]:
                    got = _merged([(s["start"], s["end"]) for s in old_spans[k]] + got)
                counts.append(total)
                spans.append([{"start": s, "end": e} for s, e in got])
                found.append(sorted(who | set(old_items[k]), key=str))
        columns = [*batch.columns[: len(base)], pa.array(counts, pa.int64()), pa.array(spans, span_type)]
        item_type = batch.schema.field(len(base) + 2).type.value_type if again else None
        columns.append(pa.array(found, pa.list_(item_type or to_arrow_type(added["hit_items"].dataType.elementType))))
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return map_arrow(docs, run, schema)


def _search_chunk(index: _Index, texts: list) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each text: words, merged hit ranges, items found."""
    lists = [words_of(t) for t in texts]
    starts = np.cumsum([0, *[len(w) + 1 for w in lists]])
    flat = np.full(int(starts[-1]), -1, np.int64)
    get = index.vocabulary.get
    for w, s in zip(lists, starts.tolist()):
        if w:
            flat[s : s + len(w)] = [get(x, -1) for x in w]
    out: list = [(len(w), [], set()) for w in lists]
    hits = index.hits(flat) if index.windows else []
    if hits:
        which = np.searchsorted(starts, np.array([h[0] for h in hits]), "right") - 1
        for (a, b, items), k in zip(hits, which.tolist()):
            out[k][1].append((a - int(starts[k]), b - int(starts[k])))
            out[k][2].update(items)
    return [(total, _merged(got), who) for total, got, who in out]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination_report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items and a digest of their ids."""
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        F.col(doc_id),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _cut(text: str, spans: list[dict]) -> str:
    """``text`` without the words in ``spans`` and what stands between them."""
    data = text.encode("utf-8", "replace")
    mask = np.frombuffer(data.translate(_WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for s in spans:
        parts.append(data[at : first[s["start"]]])
        at = int(last[s["end"] - 1])
    parts.append(data[at:])
    return b"".join(parts).decode("utf-8", "replace")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without benchmark passages; columns are those of ``docs``.

    Hit spans are cut out of the text. A document of which ``drop_share`` or more
    of the words are hit is dropped as a copy of the benchmark. Documents that
    match nothing are untouched.
    """
    names = docs.columns
    found = find_contamination(docs, benchmark, text, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    kept = found.where((F.size("hit_spans") == 0) | (hit < F.lit(drop_share) * F.col("n_words"))).select(*names, "hit_spans")
    at = names.index(text)

    def run(batch):
        spans = batch.column(len(names)).to_pylist()
        texts = [_cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans)]
        columns = batch.columns[: len(names)]
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(kept, run, docs.schema)


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The report for small tables, by comparing every window with every position."""
    out = []
    for ident, text in docs:
        w = words_of(text)
        hit, who = set(), set()
        for item, passage in items:
            v = words_of(passage)
            for i in range(max(1, len(v) - n + 1)) if v else ():
                window = v[i : i + n]
                for j in range(len(w) - len(window) + 1):
                    if w[j : j + len(window)] == window:
                        hit.update(range(j, j + len(window)))
                        who.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest()
        out.append((ident, len(w), len(hit), len(who), digest, bool(hit)))
    return out

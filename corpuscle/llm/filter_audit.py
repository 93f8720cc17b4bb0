"""What each filter of a chain removes, in every order: Arrow buffers scanned by byte classes and prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, materialize

#: Bytes that are scanned at once; a longer text is scanned in pieces that end between words.
PIECE = 1 << 20
_WORD, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_CLASS = np.full(256, _WORD | _POINT, np.uint8)
_CLASS[0x80:0xC0] = _WORD  # the further bytes of a code point
_CLASS[[0x20, *range(0x09, 0x0E)]] = _POINT
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[np.frombuffer(b"#$%&*|", np.uint8)] |= _SYMBOL
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64

#: Failure conditions of the five filters, as SQL over the columns of ``measure`` and ``copy``.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_symbols > 0",
    "E": "copy",
}


class WordScan:
    """Counts of whole texts from their bytes: words, distinct words, capitals, symbols, code points."""

    def __init__(self, piece: int = PIECE, base: int = 0x100000001B3):
        self.piece = piece
        self.base = base | 1
        self._ups = self._downs = np.ones(1, _U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The base's powers, and those of its inverse modulo 2 ** 64."""
        if len(self._ups) < n:
            grown = max(n, self.piece + 1)
            self._ups, self._downs = (np.multiply.accumulate(np.append(_U(1), np.full(grown - 1, x, _U))) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return self._ups, self._downs

    def _cuts(self, data: np.ndarray, a: int, z: int) -> Iterator[tuple[int, int]]:
        """Pieces of data[a:z] that end between words; a word longer than a piece stays whole."""
        while z - a > self.piece:
            gap = np.flatnonzero(_CLASS[data[a : a + self.piece]] & _WORD == 0)
            end = a + self.piece
            if len(gap):
                end = a + int(gap[-1]) + 1
            else:
                while end < z and _CLASS[data[end]] & _WORD:
                    end += 1
            yield a, end
            a = end
        yield a, z

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of (words, distinct words, capitals, symbols, code points) of the texts between ``offsets``.

        Word starts and ends are steps of the word class; what a text has of a
        class is a difference of prefix sums. Hashes of words are differences of
        prefix sums as well (a polynomial modulo 2 ** 64). A text's words are
        sorted by hash, and neighbours of equal hash are compared byte by byte: a
        text in which two words share a hash is counted by a set of its words.
        """
        out = np.zeros((len(offsets) - 1, 5), np.int64)
        found = [self._piece(data, a, z, offsets, out) for a, z in self._cuts(data, int(offsets[0]), int(offsets[-1]))]
        starts, lengths, hashes, owner = (np.concatenate(x) for x in zip(*found))
        key = (hashes ^ owner.astype(_U) * _U(_ODD)) * _U(_ODD | 2)
        order = np.argsort(key)
        key, owner, starts, lengths = key[order], owner[order], starts[order], lengths[order]
        twins = np.flatnonzero(key[1:] == key[:-1])
        equal = (owner[twins] == owner[twins + 1]) & (lengths[twins] == lengths[twins + 1])
        equal[equal] = self._equal(data, starts[twins[equal]], starts[twins[equal] + 1], lengths[twins[equal]])
        out[:, 1] = out[:, 0] - np.bincount(owner[twins[equal]], minlength=len(out))
        for i in np.unique(np.append(owner[twins[~equal]], owner[twins[~equal] + 1])):
            out[i, 1] = len(set(data[offsets[i] : offsets[i + 1]].tobytes().split()))
        return out

    def _piece(self, data, a: int, z: int, offsets: np.ndarray, out: np.ndarray):
        """Adds the counts of data[a:z] to ``out``; (starts, lengths, hashes, texts) of its words."""
        b = data[a:z]
        kind = _CLASS[b]
        word = kind & _WORD
        rel = np.clip(offsets, a, z) - a
        edge = np.zeros(len(b) + 1, bool)
        edge[rel] = True
        edge[-1] = True
        before = np.append(np.uint8(0), word[:-1]) & ~edge[:-1]
        starts = np.flatnonzero(word & (1 - before))
        after = np.append(word[1:], np.uint8(0)) & ~edge[1:]
        ends = np.flatnonzero(word & (1 - after)) + 1
        for column, mask in ((2, _CAPITAL), (3, _SYMBOL), (4, _POINT)):
            sums = np.append(0, np.cumsum(kind & mask != 0))
            out[:, column] += sums[rel[1:]] - sums[rel[:-1]]
        at = np.searchsorted(starts, rel)
        out[:, 0] += at[1:] - at[:-1]
        ups, downs = self._powers(len(b))
        sums = np.append(_U(0), np.cumsum((b.astype(_U) + _U(1)) * ups[: len(b)]))
        hashes = (sums[ends] - sums[starts]) * downs[starts]
        owner = np.repeat(np.arange(len(out)), at[1:] - at[:-1])
        return starts + a, ends - starts, hashes, owner

    def _equal(self, data, one: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the bytes at ``one`` and ``two`` are the same, ``piece`` bytes or a word at a time."""
        same = np.ones(len(one), bool)
        ends = np.cumsum(lengths)
        i = 0
        while i < len(one):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + self.piece, "right")))
            first = ends[i:j] - lengths[i:j] - done
            step = np.arange(int(ends[j - 1]) - done) - np.repeat(first, lengths[i:j])
            differ = data[np.repeat(one[i:j], lengths[i:j]) + step] != data[np.repeat(two[i:j], lengths[i:j]) + step]
            same[i:j] = np.add.reduceat(differ, first, dtype=np.int64) == 0
            i = j
        return same


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", piece: int = PIECE) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_capitals, n_symbols, n_chars, digest) of every document.

    The digest (BLAKE2b, 128 bits) stands for the whole text. Null texts are empty, a null part is the empty string.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    names = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars"]

    def run(batch):
        scan = WordScan(piece)
        data, offsets = _buffers(batch.column(2))
        counts, digests, i = [], [], 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1)
            counts.append(scan.count(data, offsets[i : j + 1]))
            i = j
        for a, z in zip(offsets[:-1], offsets[1:]):
            digests.append(hashlib.blake2b(data[a:z], digest_size=16).digest())
        whole = np.concatenate(counts) if counts else np.zeros((0, 5), np.int64)
        columns = [pa.array(np.ascontiguousarray(whole[:, k])) for k in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(digests, pa.binary())], names=["doc_id", "part", *names, "digest"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, part string, {', '.join(f'{n} long' for n in names)}, digest binary")


def with_copies(measured: DataFrame) -> DataFrame:
    """``measured`` with ``copy``: whether a document of a smaller id has the same text.

    A digest's least id is a partial aggregate; frequent digests are broadcast, the rest joined. Rows that share an
    id aren't smaller than each other; a null id is neither a copy nor smaller than another.
    """
    same = measured.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    joined = hot_join(measured, materialize(same), "digest", "n", measured.count())
    return joined.withColumn("copy", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))).drop("least")


def _orders(letters: str) -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, unique_fails, shares) for each set of failed filters, order and step."""
    rows = []
    for order in permutations(letters):
        done = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            for mask in range(1 << len(letters)):
                fails = bool(mask & bit)
                gone = bool(mask & done)
                # In so many of all orders this filter comes first of those that fail.
                shares = factorial(len(letters)) // mask.bit_count() if fails else 0
                rows.append((mask, "".join(order), step, not (mask & (done | bit)), fails and not gone, fails and gone, mask == bit, shares))
            done |= bit
    return rows


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What every filter keeps, removes and loses, in all orders of the filters, per part.

    ``filters`` gives a letter and a failure condition each (``FILTERS``); at most six. ``labels`` has doc_id, quality
    and toxic; a document is good (toxic) if any of its label rows says so. Documents count once per row. One row per part, filter order and step:
    kept, removed, redundant (fails, removed earlier), unique_fails (fails this one only), good_lost, toxic_lost and
    shapley (removed by the step's filter, summed over all orders).

    Each document becomes a mask of the filters that it fails; counts by part and mask are all that is joined with the
    orders, so a part of any size is a partial aggregate. Null texts are empty, a null part is the empty string, an
    empty table gives no rows.
    """
    filters = filters or FILTERS
    if len(filters) > 6:
        raise ValueError("at most six filters have all their orders audited")
    letters = "".join(filters)
    measured = with_copies(materialize(measure(docs, doc_id, text, part)))
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(0))
    any_of = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"__{c}") for c in ("quality", "toxic")]
    said = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("__id")).agg(*any_of)
    judged = measured.select("doc_id", "part", mask.alias("mask")).join(said, F.col("doc_id") == F.col("__id"), "left")
    counts = judged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__quality"), 1)).alias("good"), F.count(F.when(F.col("__toxic"), 1)).alias("toxic")
    )
    fields = "mask int, filter_order string, step int, kept boolean, removed boolean, redundant boolean, unique_fails boolean, shares long"
    steps = docs.sparkSession.createDataFrame(_orders(letters), fields)  # 600 steps of 32 masks for five filters
    met = counts.join(F.broadcast(steps), "mask")

    def total(value: str, when: str) -> Column:
        return F.sum(F.when(F.col(when), F.col(value)).otherwise(0)).alias

    return met.groupBy("part", "filter_order", "step").agg(
        total("n", "kept")("kept"),
        total("n", "removed")("removed"),
        total("n", "redundant")("redundant"),
        total("n", "unique_fails")("unique_fails"),
        total("good", "removed")("good_lost"),
        total("toxic", "removed")("toxic_lost"),
        F.sum(F.col("n") * F.col("shares")).alias("shapley"),
    )

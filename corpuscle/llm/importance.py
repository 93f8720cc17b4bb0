"""Importance resampling towards a target text: bucketed n-grams, enumerated by word suffix arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_chunks, map_arrow, materialize

BUCKETS = 10_000
#: Characters whose words share one suffix array, and its most positions; a longer text takes several arrays.
CHUNK, POSITIONS = 8_000_000, 1 << 20
_U = np.uint32
_SPACE = b" "
#: Lower-cases A-Z, keeps digits, letters and bytes beyond ASCII, makes all else a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only): runs of digits, letters and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _shift_tables() -> list[np.ndarray]:
    """For each k, what 2 ** k zero bytes make of a CRC-32, as four tables of 256 by its bytes."""
    one = np.array([(bit >> 8) ^ (zlib.crc32(bytes([bit & 255])) ^ zlib.crc32(b"\0")) for bit in (1 << i for i in range(32))], _U)
    tables = []
    for _ in range(32):
        table = np.zeros((4, 256), _U)
        for i in range(32):
            low = 1 << (i % 8)
            table[i // 8, low : 2 * low] = table[i // 8, :low] ^ one[i]
        tables.append(table)
        one = _apply(table, one)
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHIFT = _shift_tables()


def joined_crc(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of head + tail from those of both and the tail's length in bytes (a CRC is linear)."""
    out, k = head.copy(), 0
    while len(length) and (length >> k).any():
        on = np.flatnonzero(length >> k & 1)
        out[on] = _apply(_SHIFT[k], out[on])
        k += 1
    return out ^ tail


def ngram_runs(ids: np.ndarray, ends: np.ndarray, count: int, crcs: np.ndarray, spaced: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(crc of each run, run of each place, places) for n-grams of one, two and three words.

    ``ids`` are numbers from 1 of a text's words, 0 ends it; the first ``count`` places start n-grams, those after
    them only continue some. Suffixes are sorted by three words; neighbours whose common prefix is at least n words
    belong to one run of n-grams, which is hashed once.
    """
    none = np.zeros(len(ids) + 2, np.int64)
    none[: len(ids)] = ids
    first, second, third = none[:count], none[1 : count + 1] * ~ends[:count], none[2 : count + 2]
    third = third * ((second > 0) & ~np.append(ends, [True])[1 : count + 1])
    base = len(crcs)
    key = (first * base + second) * base + third
    order = np.argsort(key)
    ordered = key[order]
    for n, width in ((1, base * base), (2, base), (3, 1)):
        prefix = ordered // width
        places = order if n == 1 else order[(second if n == 2 else third)[order] > 0]
        if n > 1:
            prefix = prefix[prefix % base > 0]
        new = np.append(True, prefix[1:] != prefix[:-1]) if len(prefix) else np.zeros(0, bool)
        at = places[new]
        crc = crcs[first[at]]
        if n > 1:
            crc = joined_crc(crc, spaced[second[at]], sizes[second[at]])
        if n > 2:
            crc = joined_crc(crc, spaced[third[at]], sizes[third[at]])
        yield crc, np.cumsum(new) - 1, places


def _blocks(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``ngram_runs`` takes for the words of ``texts``, in blocks of bounded size, and the text of each place."""
    flat: list[bytes] = []
    lengths = []
    for t in texts:
        w = words_of(t)
        flat += w
        lengths.append(len(w))
    owner = np.repeat(np.arange(len(texts)), lengths)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(lengths)[np.array(lengths) > 0] - 1] = True
    for a in range(0, len(flat), POSITIONS):
        count = min(POSITIONS, len(flat) - a)
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        ids = np.array([number(w, len(seen) + 1) for w in flat[a : a + count + 2]], np.int64)
        crcs = np.array([0, *[zlib.crc32(w) for w in seen]], _U)
        spaced = np.array([0, *[zlib.crc32(_SPACE + w) for w in seen]], _U)
        sizes = np.array([0, *[len(w) + 1 for w in seen]], np.int64)
        yield ids, last[a : a + count + 2], count, crcs, spaced, sizes, owner[a : a + count]


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of one to three words, over all texts, fall in each bucket (CRC-32 modulo ``buckets``)."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in arrow_chunks(batch.column(0), CHUNK):
                for *block, _ in _blocks(texts):
                    for crc, run_of, _ in ngram_runs(*block):
                        total += np.bincount(crc % _U(buckets), weights=np.bincount(run_of, minlength=len(crc)), minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = rows.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: floor(1000 ln of its smoothed share in ``target`` over its share in ``docs``)."""
    s, t = ([0] * buckets, [0] * buckets)
    for counts, rows in ((s, docs), (t, target)):
        for row in bucket_counts(rows, text, buckets).collect():  # a number for each bucket at most
            counts[row["bucket"]] = row["n"]
    n_s, n_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(float(t[b] + 1) * (n_s + buckets) / (float(s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]


def with_weights(docs: DataFrame, gains: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's n-grams."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))  # a number for each bucket

    def run(batch):
        gain = given.value
        n_words = np.zeros(batch.num_rows, np.int64)
        weight = np.zeros(batch.num_rows, np.int64)
        for lo, hi, texts in arrow_chunks(batch.column(1), CHUNK):
            for *block, owner in _blocks(texts):
                own = np.zeros(block[2], np.int64)
                for crc, run_of, places in ngram_runs(*block):
                    own[places] += gain[crc % _U(len(gain))][run_of]
                sums = np.append(0, np.cumsum(own))
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                weight[lo:hi] += sums[ends[1:]] - sums[ends[:-1]]
                n_words[lo:hi] += np.diff(ends)
        features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_arrow(slim, run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) for a Gumbel variate g that the seed and the id decide; a null id reads as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def best_ranked(rows: DataFrame, order: list[Column], count: int, out: str = "rank") -> DataFrame:
    """``rows`` with the place, from 1, of the first ``count`` in order, and null for the others.

    Rows are cut into ranges of the order and written once; a range's place is the sum of those before it, and only
    ranges that reach into the first ``count`` are sorted, each in its own task. Rows that ``order`` can't tell
    apart may be in different ranges.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    cut = materialize(numbered.repartitionByRange(ranges, *order, F.xxhash64("__row")).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["count"]) for r in cut.groupBy("__range").count().collect())  # one row per range
    starts, before = [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = spark.createDataFrame([x for x in starts if x[1] < count], "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__row")) + F.col("__before")
    first = cut.join(F.broadcast(offsets), "__range").withColumn(out, place)  # one row per range
    rest = cut.join(F.broadcast(offsets), "__range", "left_anti").withColumn(out, F.lit(None).cast("long"))
    whole = first.withColumn(out, F.when(F.col(out) <= count, F.col(out))).select(*rows.columns, out)
    return whole.unionByName(rest.select(*rows.columns, out))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank): a draw of ``percent`` that resembles ``target``.

    Features are runs of one to three words; weight is the log of how much likelier the target's bucket frequencies
    make them, in thousandths; score adds a Gumbel variate, so that taking the highest scores samples without
    replacement in proportion to the importance. Of the documents with ``min_words`` words or more, ``percent`` of a hundred (rounded
    down) get a rank; ties go to the smaller id.

    Words of a chunk of texts get numbers and one suffix array, so each repeated n-gram is hashed once; texts are
    read twice, for the counts and for the scores. Null texts have no words, a null id comes first in ties, repeated
    rows are ranked each, an empty ``target`` or table is fine.
    """
    weighed = with_weights(docs, bucket_gains(docs, target, text, buckets), doc_id, text)
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = best_ranked(able, [F.col("score").desc(), F.col("doc_id")], percent * able.count() // 100)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("doc_id").alias(doc_id), "n_features", "weight", "score", "rank")

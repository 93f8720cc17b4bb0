"""Chunking: headed sections in expressions; fixed windows and sentence packing, folds over a text, in Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, CHARS_PER_TOKEN, estimate_tokens, sentences, strip

SIZE, OVERLAP = 512, 0.2
#: Texts that a task holds as Python strings at once.
TEXTS = 64


def checked_step(size: int, overlap: float) -> int:
    """Characters between the starts of two windows."""
    chars = size * CHARS_PER_TOKEN
    step = chars - int(chars * overlap)
    if step <= 0:
        raise ValueError("overlap leaves no step")
    return step


def windows(text: str, size: int, overlap: float) -> Iterator[tuple[int, int, str]]:
    """(start, end, stripped piece) of a text's fixed windows."""
    chars = size * CHARS_PER_TOKEN
    zone_at = int(chars * 0.8)
    for start in range(0, len(text), checked_step(size, overlap)):
        end = start + chars
        if end < len(text):
            stop, line = text.rfind(". ", start + zone_at, end), text.rfind("\n", start + zone_at, end)
            end = stop + 2 if stop >= 0 else line + 1 if line >= 0 else end
        if piece := text[start:end].strip(BLANKS):
            yield start, end, piece


def fixed(docs: DataFrame, size: int = SIZE, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, total_chunks, start_char, end_char, chunk, token_count): windows that start at equal steps.

    A window that isn't the last ends behind the last ". " (else newline) of its
    last fifth. Windows of white space only are left out and take no number.
    """
    checked_step(size, overlap)
    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    id_field = made.schema["doc_id"].dataType.simpleString()

    # One pass over each text: a window costs its own length, wherever it stands.
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                found = [list(windows(t, size, overlap)) if t else [] for t in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = [c for f in found for c in f]
                columns = [pa.array([i for f in found for i in range(len(f))], pa.int64()), pa.array([len(found[i]) for i in at.tolist()], pa.int64())]
                columns += [pa.array([c[j] for c in flat], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), *columns], names=["doc_id", "chunk_index", "total_chunks", "start_char", "end_char", "chunk"]
                )

    flat = made.mapInArrow(run, f"doc_id {id_field}, chunk_index long, total_chunks long, start_char long, end_char long, chunk string")
    return flat.withColumn("token_count", estimate_tokens(F.col("chunk")))


def semantic(docs: DataFrame, size: int = SIZE, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk, token_count): whole sentences up to the size, the last ones carried over."""
    limit = size * CHARS_PER_TOKEN
    made = docs.select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s")).where(F.size("s") > 0)

    # A few texts at a time: an Arrow batch of long ones is many times its size as Python strings.
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = [(i, c) for i, found in enumerate(part.column(1).to_pylist()) for c in enumerate(_packed(found, limit, overlap))]
                totals: dict[int, int] = {}
                for i, _ in rows:
                    totals[i] = totals.get(i, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                        pa.array([c[0] for _, c in rows], pa.int64()),
                        pa.array([totals[i] for i, _ in rows], pa.int64()),
                        pa.array([c[1] for _, c in rows], pa.string()),
                    ],
                    names=["doc_id", "chunk_index", "total_chunks", "chunk"],
                )

    kind = made.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, chunk_index long, total_chunks long, chunk string").withColumn("token_count", estimate_tokens(F.col("chunk")))


def _packed(found: list[str], limit: int, overlap: float) -> list[str]:
    """Sentences joined up to ``limit`` characters; each chunk begins with the last sentences of the one before."""
    carry = max(1, int(len(found) * overlap * 0.1))
    out: list[str] = []
    held: list[str] = []
    for s in found:
        if held and sum(map(len, held)) + len(s) > limit:
            out.append(" ".join(held))
            held = held[-carry:]
        held.append(s)
    return [*out, " ".join(held)]


def headed_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, header, body): what stands below each ``#`` header; text before the first has an empty header."""
    parts = F.split(F.col(text), r"(?m)(?=^#{1,6}\s+\S)")
    header = F.regexp_extract("part", r"^(#{1,6}\s+[^\n]+)", 1)
    body = strip(F.when(F.col("part").rlike(r"^#{1,6}\s+\S"), F.regexp_replace("part", r"^#{1,6}\s+[^\n]+\n?", "")).otherwise(F.col("part")))
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("section", "part"))
    return flat.select("doc_id", F.col("section").cast("long").alias("section"), header.alias("header"), body.alias("body")).where("body <> ''")


def markdown(docs: DataFrame, size: int = SIZE, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections as chunks; those over the size are cut into fixed windows. Chunks are numbered per document."""
    parts = headed_sections(docs, doc_id, text).withColumn("whole", F.when(F.col("header") == "", F.col("body")).otherwise(F.concat_ws("\n", "header", "body")))
    small = F.length("whole") <= size * CHARS_PER_TOKEN
    kept = parts.where(small).select("doc_id", "section", F.lit(0).cast("long").alias("piece"), "header", F.col("whole").alias("chunk"))
    long_ = parts.where(~small).withColumn("key", F.struct("doc_id", "section", "header"))
    cut = fixed(long_, size, overlap, "key", "whole").select("doc_id.doc_id", "doc_id.section", F.col("chunk_index").alias("piece"), "doc_id.header", "chunk")
    order = Window.partitionBy("doc_id").orderBy("section", "piece")
    return (
        kept.unionByName(cut)
        .withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
        .select("doc_id", "chunk_index", "total_chunks", "header", "chunk")
        .withColumn("token_count", estimate_tokens(F.col("chunk")))
    )


STRATEGIES = {"fixed": fixed, "semantic": semantic, "markdown": markdown}


def chunk_text(docs: DataFrame, strategy: str = "fixed", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return STRATEGIES[strategy](docs, **options)

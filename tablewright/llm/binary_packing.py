"""Packing by powers of two: every document is cut into pieces of binary length, and equal lengths go into one bucket.

A document of n tokens gives n // longest pieces of the greatest length and one piece for each binary digit of the rest,
longest first. Every piece is a sequence by itself: it crosses no document and is padded nowhere. A trainer draws
batches from one bucket at a time, so all sequences of a batch have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.batches import importable, pieces, stored
from tablewright.llm.token_records import encoder

_PIECE = "part long, place long, doc_id long, start long, length long, doc_tokens long, ids binary"


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """``tokens`` as pieces of ``longest`` and then as its binary digits, from large to small."""
    rest = tokens % longest
    digits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [longest] * (tokens // longest) + digits


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int | None, longest: int) -> Iterator[pa.RecordBatch]:
    own = encoder(tokenizer_path)
    part = TaskContext.get().partitionId()
    end = b"" if end_id is None else end_id.to_bytes(own.width, "little")
    placed = dict.fromkeys((1 << b for b in range(longest.bit_length())), 0)
    for batch in pieces(batches, "text", 2 << 20):
        rows = [row + end for row in own.encode([t or "" for t in batch.column("text").to_pylist()])]
        ids = np.frombuffer(b"".join(rows), f"<u{own.width}").astype("<u4")
        columns: list[list] = [[], [], [], [], []]
        for doc_id, row in zip(batch.column("doc_id").to_pylist(), rows):
            tokens, start = len(row) // own.width, 0
            for length in binary_lengths(tokens, longest):
                for column, value in zip(columns, (placed[length], doc_id, start, length, tokens)):
                    column.append(value)
                placed[length] += 1
                start += length
        offsets = np.r_[0, np.cumsum(np.array(columns[3], np.int64) * 4)].astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(columns[0]), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
        made = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), part, np.int64)), *made, held], ["part", "place", "doc_id", "start", "length", "doc_tokens", "ids"])


def pack_by_powers(documents: DataFrame, tokenizer_path: str, end_id: int | None, longest: int = 2048) -> DataFrame:
    """(sequence_id, offset, doc_id, start, length, doc_tokens, ids): the pieces of all ``documents`` (doc_id, text).

    ``end_id`` (if any) ends each document. ``start`` counts its ids before the piece, ``ids`` are unsigned 32-bit
    little-endian numbers. ``longest`` is a power of two. Sequences are numbered from 0 without gaps, from the shortest
    bucket to the longest; a sequence is one piece, so ``offset`` is 0. Null text is an empty one: it gives its end
    id, or nothing. Null and repeated ids are kept as they are, each row is a document of its own. Other columns are ignored.
    An empty table gives an empty one. Texts stay where they are read; what is exchanged are counts, one row per task
    and bucket.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    importable(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Written once: a task that runs again would number its pieces in the order in which it meets them.
    cut = stored(rows.mapInArrow(lambda b: _cut(b, tokenizer_path, end_id, longest), _PIECE), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    # One row per bucket: at most the binary logarithm of ``longest`` and one.
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("base"))
    starts = stored(counts.join(F.broadcast(buckets), "length").select("length", "part", (F.col("base") + F.col("before")).alias("first")), "starts")
    return cut.join(starts, ["length", "part"]).select(
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "doc_id", "start", "length", "doc_tokens", "ids"
    )


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Write the sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("length").parquet(folder)

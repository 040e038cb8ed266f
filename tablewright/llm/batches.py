"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablewright.session import importable, scratch_path  # noqa: F401

def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage is cut, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of the text column, or a single row."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for row, length in enumerate(lengths):
            if row > start and size + length > max_bytes:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(length)
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The rows of a text column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def sample_limit(df: DataFrame, keys: list[str], rows: int) -> int | None:
    """The ``rows``-th smallest hash of ``keys``, the largest one in a smaller table. Only hashes are sorted."""
    return df.select(F.xxhash64(*keys).alias("draw")).orderBy("draw").limit(rows).agg(F.max("draw")).first()[0]


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``keys``, with that hash as ``draw``.

    :func:`sample_limit` is a filter on the next scan. Rows with equal keys are equally placed, so repeated ones at the
    limit may add to the number.
    """
    drawn = df.withColumn("draw", F.xxhash64(*keys))
    threshold = sample_limit(df, keys, rows)
    return drawn.where(F.lit(False) if threshold is None else F.col("draw") <= threshold)

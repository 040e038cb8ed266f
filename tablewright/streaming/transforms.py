"""Fitted cleaning on a stream.

What was learned from a table (names, constants, fences, masks, types) is a projection, so it applies to an unbounded
input as it stands. Steps that need other rows (duplicates, fills from neighbours) stay with the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.plans.cleaning import FittedCleaning
from tablewright.session import scratch_path


def clean_stream(stream: DataFrame, fitted: FittedCleaning) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream; use FittedCleaning.transform")
    return fitted.transform_rows(stream)


def write_available(stream: DataFrame, path: str, fmt: str = "parquet", checkpoint: str | None = None) -> StreamingQuery:
    """Write everything that has arrived and stop; a restart with the same checkpoint goes on where it ended."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream")
    writer = stream.writeStream.format(fmt).option("checkpointLocation", location).outputMode("append")
    return writer.trigger(availableNow=True).start(path)

"""Rows dealt to tasks by what is in them, so that fits which depend on the deal give the same result on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a piece: few enough to give small tables several pieces, and more for large ones.
_SMALL_PIECE, _LARGE_PIECE, _SMALL_PIECES = 1 << 14, 1 << 20, 1024
#: Copies of a row that are made where it was counted. More are made in blocks of ``_BLOCK``, which are spread first.
_FEW, _BLOCK = 16, 1 << 12


def pieces_of(rows: int) -> int:
    """Number of pieces for a table, from its row count alone."""
    return max(1, min(_SMALL_PIECES, rows // _SMALL_PIECE), rows // _LARGE_PIECE)


def _numbered(df: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` with ``__i``, which tells equal ones apart.

    The counts of a table with few different rows fit one task, but its rows need not: no task makes more than a block of
    them from each entry.
    """
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    one = F.lit(1).cast("bigint")
    few = counted.where(F.col("__n") <= _FEW).select(*names, F.explode(F.sequence(one, "__n")).alias("__i"))
    starts = F.explode(F.sequence(one, "__n", F.lit(_BLOCK).cast("bigint"))).alias("__first")
    blocks = counted.where(F.col("__n") > _FEW).select(*names, "__n", starts).repartition(pieces_of(rows), *names, "__first")
    last = F.least(F.col("__first") + F.lit(_BLOCK - 1), "__n")
    return few.unionAll(blocks.select(*names, F.explode(F.sequence("__first", last)).alias("__i")))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` in an order and in pieces that follow from their content.

    Equal rows are counted first and numbered, so that a row that fills a third of the table is spread like all others
    and no matter how the rows came, the same ones lie in the same piece at the same place.
    """
    names = df.columns
    keyed = _numbered(df, rows).withColumn("__h", F.xxhash64(*names, "__i"))
    return keyed.repartition(pieces_of(rows), "__h").sortWithinPartitions("__h", *names, "__i").select(*names)

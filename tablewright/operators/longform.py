"""The shared shape of all profiles: one exploded row per cell, one ``groupBy`` over the column number.

A profile of a table with many columns as one wide ``agg`` grows with the number of columns and leaves code
generation early. Here the plan has the same size for ten columns and for a thousand, each map task keeps one
small buffer per column, and only those buffers are shuffled, so neither row count nor skew reaches the reducers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.session import spread
from tablewright.types import OTHER, TEXT, col, type_class

CELL = Callable[[T.StructField], Column]


def fields_of(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [df.schema[name] for name in columns]


def cells(df: DataFrame, columns: Sequence[str], parts: Mapping[str, CELL]) -> DataFrame:
    """One row per (row, column): ``cid`` is the position in ``columns``, then the given parts of the cell."""
    entries = [
        F.struct(F.lit(i).alias("cid"), *[build(field).alias(part) for part, build in parts.items()])
        for i, field in enumerate(fields_of(df, columns))
    ]
    source = df.select(*[col(c) for c in columns])
    # Work per cell is heavy for texts and nested values only; numbers are aggregated faster than they are moved.
    if any(type_class(f.dataType) in (TEXT, OTHER) for f in fields_of(df, columns)):
        source = spread(source)
    return source.select(F.explode(F.array(*entries)).alias("cell")).select("cell.*")


def lookup(values: Sequence, cid: Column, sql_type: str) -> Column:
    """The value that belongs to a column number, from a list as long as the schema."""
    return F.element_at(F.array(*[F.lit(v).cast(sql_type) for v in values]), cid + 1)


def one_row_per_column(df: DataFrame, columns: Sequence[str], by_cid: DataFrame) -> DataFrame:
    """Attach column names, so that a table without rows still gets a row for each column.

    The right side has at most one row per column of the schema, hence the broadcast.
    """
    names = df.sparkSession.range(0, len(columns), 1, 1).select(F.col("id").cast("int").alias("cid"))
    return names.select("cid", lookup(columns, F.col("cid"), "string").alias("column")).join(
        F.broadcast(by_cid), "cid", "left"
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; NULL when there is nothing to divide by."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)

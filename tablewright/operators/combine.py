"""Stacking tables whose columns only partly agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.operators.dedupe import remove_duplicates
from tablewright.types import DATETIME, NUMERIC, col, is_float, is_integral, type_class


def _common_type(types: Sequence[T.DataType]) -> T.DataType | None:
    """A type that holds the values of all; ``None`` when they already agree."""
    if all(t == types[0] for t in types):
        return None
    kinds = {type_class(t) for t in types}
    if kinds == {NUMERIC}:
        if all(is_integral(t) for t in types):
            return T.LongType()
        return T.DoubleType() if any(is_float(t) for t in types) else _common_decimal(types)
    if kinds == {DATETIME}:
        return T.TimestampNTZType()
    return T.StringType()


#: Decimal digits of whole-number types.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _common_decimal(types: Sequence[T.DataType]) -> T.DataType:
    """Enough places before and after the point for all; text when no decimal has so many."""
    before = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in types)
    after = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in types)
    return T.DecimalType(before + after, after) if before + after <= 38 else T.StringType()


def _aligned(frames: Sequence[DataFrame], names: Sequence[str]) -> list[DataFrame]:
    target = {n: _common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}
    return [
        f.select(*[col(n).cast(target[n]).alias(n) if target[n] is not None else col(n) for n in names if n in f.columns])
        for f in frames
    ]


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables. Columns shared by all if there are any, otherwise every column of every table."""
    if not frames:
        raise ValueError("nothing to combine")
    if len(frames) == 1:
        return frames[0]
    shared = [n for n in frames[0].columns if all(n in f.columns for f in frames[1:])]
    names = shared or list(dict.fromkeys(n for f in frames for n in f.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(frames, names))


def combine_tables(frames: Sequence[DataFrame], order_by: Sequence[str] | None = None, **dedupe) -> DataFrame:
    """Stack the tables and drop duplicates from the result; a single table is returned as it is."""
    stacked = stack(frames)
    return stacked if len(frames) == 1 else remove_duplicates(stacked, order_by, **dedupe)


def union_sources(sources: Mapping[str, DataFrame], label: str = "_source") -> DataFrame:
    """Union by column name, each row marked with the name of the source it came from."""
    frames = [df.withColumn(label, F.lit(name)) for name, df in sources.items()]
    if not frames:
        raise ValueError("nothing to combine")
    names = list(dict.fromkeys(n for f in frames for n in f.columns if n != label)) + [label]
    aligned = _aligned(frames, names)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned).select(*map(col, names))

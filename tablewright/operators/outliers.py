"""Capping outliers at the quartile fences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.longform import cells, lookup, one_row_per_column
from tablewright.operators.quantiles import quantiles
from tablewright.types import NUMERIC, col, columns_of, is_integral, number

MIN_VALUES = 11


@dataclass
class CappedColumns:
    """Fitted fences; applying them is a pure projection, so they also run on a stream."""

    fences: dict[str, tuple[float, float]]
    affected: dict[str, int]
    totals: dict[str, int]

    def transform(self, df: DataFrame) -> DataFrame:
        def capped(f):
            if f.name not in self.fences:
                return col(f.name)
            low, high = self.fences[f.name]
            # Whole numbers that were all inside the fences when fitted stay whole: new ones are capped to whole fences.
            if is_integral(f.dataType) and not self.affected[f.name]:
                value = col(f.name)
                inside = F.least(F.greatest(value.cast("bigint"), F.lit(math.ceil(low))), F.lit(math.floor(high)))
                return F.when(value.isNotNull(), inside).cast(f.dataType).alias(f.name)
            value = number(f)
            return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))).alias(f.name)

        return df.select(*[capped(f) for f in df.schema.fields])

    def report(self, df: DataFrame) -> DataFrame:
        rows = [(n, lo, hi, self.totals[n], self.affected[n]) for n, (lo, hi) in self.fences.items()]
        return df.sparkSession.createDataFrame(
            rows, "column string, low double, high double, non_null bigint, capped bigint"
        )


def fences(quartiles: dict[str, list[float | None]]) -> dict[str, tuple[float, float]]:
    """Outlier bounds per column; a column without finite quartiles has none."""
    spread = {n: (q[0], q[-1], q[-1] - q[0]) for n, q in quartiles.items() if q[0] is not None}
    return {n: (q1 - 1.5 * iqr, q3 + 1.5 * iqr) for n, (q1, q3, iqr) in spread.items() if math.isfinite(iqr)}


def _bounds(bounds: dict, names: Sequence[str], side: int) -> Column:
    return lookup([bounds[n][side] if n in bounds else None for n in names], F.col("cid"), "double")


def outside(bounds: dict, names: Sequence[str]) -> Column:
    """Test for the value ``v`` of column number ``cid``."""
    return (F.col("v") < _bounds(bounds, names, 0)) | (F.col("v") > _bounds(bounds, names, 1))


class OutlierCapper:
    """Learns Q1 - 1.5 IQR and Q3 + 1.5 IQR of every numeric column with more than ten values."""

    def __init__(self, columns: Sequence[str] | None = None, exact: bool = True):
        self.columns = columns
        self.exact = exact

    def fit(self, df: DataFrame) -> CappedColumns:
        numeric = columns_of(df, NUMERIC)
        names = [c for c in (self.columns or numeric) if c in numeric]
        if not names:
            return CappedColumns({}, {}, {})
        bounds = fences(quantiles(df, names, [0.25, 0.75], self.exact))
        counted = (
            cells(df, names, {"v": number})
            .groupBy("cid")
            .agg(F.count("v").alias("n"), F.count_if(outside(bounds, names)).alias("outside"))
        )
        rows = {names[r["cid"]]: r for r in counted.collect()}
        kept = [n for n in names if n in bounds and rows[n]["n"] >= MIN_VALUES]
        return CappedColumns(
            {n: bounds[n] for n in kept}, {n: rows[n]["outside"] for n in kept}, {n: rows[n]["n"] for n in kept}
        )


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Values outside the quartile fences per numeric column; columns of tables with fewer than four rows have none."""
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    if not names:
        return df.sparkSession.createDataFrame([], "cid int, column string, row_count bigint, outlier_count bigint")
    bounds = fences(quantiles(df, names, [0.25, 0.75], exact))
    counted = cells(df, names, {"v": number}).groupBy("cid").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(outside(bounds, names)).alias("outside")
    )
    full = one_row_per_column(df, names, counted)
    return full.select(
        "cid",
        "column",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("row_count"),
        F.when(F.col("rows") >= 4, F.col("outside")).otherwise(F.lit(0)).cast("bigint").alias("outlier_count"),
    )

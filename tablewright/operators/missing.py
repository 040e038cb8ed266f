"""Filling missing values: learn the constants once, apply them as a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.frequencies import text_modes
from tablewright.operators.ordered import OrderedRows
from tablewright.operators.quantiles import quantiles
from tablewright.types import DATETIME, NUMERIC, TEXT, col, is_integral, present, type_class


def null_counts(df: DataFrame) -> dict[str, tuple[int, int]]:
    """(rows, missing) of every column, from one scan."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(present(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    ).first()
    return {f.name: (row[0], row[0] - row[i + 1]) for i, f in enumerate(df.schema.fields)}


def _require_order(order_by: Sequence[str], names: Sequence[str]) -> None:
    if names and not order_by:
        raise ValueError(f"columns {list(names)} are filled from neighbouring rows: name order_by columns")


@dataclass
class FilledColumns:
    """A fitted filler for any table with these columns, batch or stream.

    All columns with a value have a constant, whether or not they had gaps. Types are settled by the fit: a column of
    whole numbers that had gaps becomes double, others keep their type and get the median rounded.
    """

    constants: dict[str, object] = field(default_factory=dict)
    widened: list[str] = field(default_factory=list)
    forward: list[str] = field(default_factory=list)
    both: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    fitted: DataFrame | None = None

    def fill_constants(self, df: DataFrame) -> DataFrame:
        """Medians and modes only: a pure projection."""
        def filled(f):
            if f.name not in self.constants:
                return col(f.name)
            dtype, constant = f.dataType, F.lit(self.constants[f.name])
            if f.name in self.widened:
                dtype = "double"
            elif is_integral(f.dataType):
                constant = F.round(constant)
            return F.coalesce(present(f).cast(dtype), constant.cast(dtype)).alias(f.name)

        return df.select(*[filled(f) for f in df.schema.fields])

    def transform(self, df: DataFrame) -> DataFrame:
        """Constants, then neighbours for the columns in which this table has gaps."""
        filled = self.fill_constants(df)
        if not self.forward and not self.both:
            return filled
        counts = self.counts if df is self.fitted else null_counts(df.select(*map(col, [*self.forward, *self.both])))
        gaps = {n for n, (_, missing) in counts.items() if missing}
        forward, both = [n for n in self.forward if n in gaps], [n for n in self.both if n in gaps]
        if not forward and not both:
            return filled
        _require_order(self.order_by, forward + both)
        return OrderedRows(filled, self.order_by).fill(forward=forward, both=both)

    def report(self, df: DataFrame) -> DataFrame:
        """Missing values per column before and after the fill of the fitted table."""
        after = null_counts(self.transform(df))
        rows = [(n, total, missing, after[n][1]) for n, (total, missing) in self.counts.items()]
        return df.sparkSession.createDataFrame(
            rows, "column string, row_count bigint, missing_before bigint, missing_after bigint"
        )


class MissingValueFiller:
    """Numbers get the median, texts the most frequent value, dates the nearest earlier then later date, the rest the
    nearest earlier value. A column without any value stays as it is."""

    def __init__(self, order_by: Sequence[str] = (), exact: bool = True):
        self.order_by = list(order_by)
        self.exact = exact

    def fit(self, df: DataFrame) -> FilledColumns:
        counts = null_counts(df)
        known = [f for f in df.schema.fields if counts[f.name][1] < counts[f.name][0]]
        by_kind = {kind: [f for f in known if type_class(f.dataType) == kind] for kind in (NUMERIC, TEXT, DATETIME)}
        result = FilledColumns(order_by=self.order_by, counts=counts, fitted=df)
        numbers = [f.name for f in by_kind[NUMERIC]]
        result.constants.update({n: q[0] for n, q in quantiles(df, numbers, [0.5], self.exact).items()})
        result.widened = [f.name for f in by_kind[NUMERIC] if is_integral(f.dataType) and counts[f.name][1]]
        texts = [f.name for f in by_kind[TEXT]]
        if texts:
            result.constants.update({n: value for n, (value, _) in text_modes(df, texts).items()})
        result.both = [f.name for f in by_kind[DATETIME]]
        result.forward = [f.name for f in known if type_class(f.dataType) not in by_kind]
        _require_order(self.order_by, [n for n in result.both + result.forward if counts[n][1]])
        return result

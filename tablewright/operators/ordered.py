"""Operators that depend on row order, without a window over the whole table in one task.

Rows are range-partitioned and sorted by explicit keys (with a unique last key a hot value is spread over several
ranges), numbered inside their range, and written to the checkpoint folder once, so that a lost executor cannot
renumber them. What crosses ranges is one small row per range: its row count or its last known value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.session import materialize, range_partitions
from tablewright.types import col, present, require_columns

_RANGE, _PLACE = "__range", "__place"


class OrderedRows:
    """The rows of a table in a fixed order.

    ``order_by`` must name a unique combination of columns: the order of equal rows would be undefined otherwise.
    Nulls sort last.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str]):
        if not order_by:
            raise ValueError("this operator depends on row order: name the order_by columns")
        require_columns(df, order_by)
        self.columns = df.columns
        keys = [col(c).asc_nulls_last() for c in order_by]
        parts = range_partitions(df)
        numbered = (
            (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys))
            .sortWithinPartitions(*keys)
            # The id holds the partition in its upper 31 bits and the place inside it in the lower 33.
            .withColumn("__id", F.monotonically_increasing_id())
            .withColumn(_RANGE, F.shiftright("__id", 33).cast("int"))
            .withColumn(_PLACE, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__id")
        )
        self.rows = materialize(numbered)
        # A table without rows may have no partition at all.
        self.ranges = max(1, self.rows._jdf.queryExecution().toRdd().getNumPartitions())

    def _with_range_table(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Attach a table with one row per range, of which there are at most ``MAX_RANGES``."""
        return rows.join(F.broadcast(table), _RANGE, "left")

    def _apart(self) -> DataFrame:
        """The rows with one partition for each range, as windows over ranges need them."""
        return self.rows.repartitionById(self.ranges, _RANGE)

    def _earlier(self) -> Window:
        return Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)

    def _later(self) -> Window:
        # Read backwards: a frame that runs to the end of the table would be scanned anew for every row.
        return Window.orderBy(F.desc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)

    def with_index(self, name: str = "row_index") -> DataFrame:
        """Consecutive numbers from 0 over the whole table."""
        sizes = self.rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n"))
        starts = sizes.select(_RANGE, F.coalesce(F.sum("__n").over(self._earlier()), F.lit(0)).alias("__start"))
        numbered = self._with_range_table(self.rows, starts)
        return numbered.select(*map(col, self.columns), (F.col("__start") + F.col(_PLACE)).alias(name))

    def with_running_sum(self, value: Column, name: str) -> DataFrame:
        """Sum of ``value`` over all rows up to and including the current one."""
        rows = self._apart().withColumn("__value", value)
        sums = self.rows.withColumn("__value", value).groupBy(_RANGE).agg(F.sum("__value").alias("__sum"))
        starts = sums.select(_RANGE, F.coalesce(F.sum("__sum").over(self._earlier()), F.lit(0)).alias("__start"))
        inside = Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = self._with_range_table(rows.withColumn("__running", F.sum("__value").over(inside)), starts)
        return running.select(*map(col, self.columns), (F.col("__start") + F.col("__running")).alias(name))

    def fill(self, forward: Sequence[str] = (), both: Sequence[str] = ()) -> DataFrame:
        """Fill missing values with the nearest earlier one; for ``both`` then with the nearest later one."""
        names = [*forward, *both]
        if not names:
            return self.rows.select(*map(col, self.columns))
        schema = self.rows.schema
        value = {n: present(schema[n]) for n in names}
        back = Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = Window.partitionBy(_RANGE).orderBy(F.desc(_PLACE)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = []
        for i, n in enumerate(names):
            known = F.when(value[n].isNotNull(), F.col(_PLACE))
            edges.append(F.max_by(value[n], known).alias(f"__last{i}"))
            edges.append(F.min_by(value[n], known).alias(f"__first{i}"))
        table = self.rows.groupBy(_RANGE).agg(*edges)
        table = table.select(
            _RANGE,
            *[F.last(f"__last{i}", ignorenulls=True).over(self._earlier()).alias(f"__from_before{i}") for i in range(len(names))],
            *[F.last(f"__first{i}", ignorenulls=True).over(self._later()).alias(f"__from_after{i}") for i in range(len(names))],
        )
        inside = self._apart().select(
            "*",
            *[F.last(value[n], ignorenulls=True).over(back).alias(f"__back{i}") for i, n in enumerate(names)],
            *[F.last(value[n], ignorenulls=True).over(ahead).alias(f"__ahead{i}") for i, n in enumerate(names)],
        )
        joined = self._with_range_table(inside, table)
        filled = {}
        for i, n in enumerate(names):
            choices = [F.col(f"__back{i}"), F.col(f"__from_before{i}")]
            if n in both:
                choices += [F.col(f"__ahead{i}"), F.col(f"__from_after{i}")]
            filled[n] = F.coalesce(*choices)
        return joined.select(*[filled.get(c, col(c)).alias(c) for c in self.columns])

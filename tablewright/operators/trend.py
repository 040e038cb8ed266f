"""Trends of numbers along the first date column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.formats import fixed
from tablewright.operators.correlation import pearson
from tablewright.operators.longform import lookup
from tablewright.operators.ordered import OrderedRows
from tablewright.types import DATETIME, NUMERIC, col, columns_of, number

STRONG = 0.7
MODERATE = 0.3
TREND_SCHEMA = "cid int, column string, n bigint, correlation double, strength string, direction string, message string"


def trends(
    df: DataFrame, tie_break: Sequence[str], date_column: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Correlation of each number with its row position once rows are sorted by date, missing dates last.

    Rows keep their position when a number is missing. ``tie_break`` must make the order unique. Each numeric column
    has a row; ``strength`` and ``message`` are NULL below the moderate limit.
    """
    dates = columns_of(df, DATETIME)
    date_column = date_column or (dates[0] if dates else None)
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    if date_column is None or not names:
        return df.sparkSession.createDataFrame([], TREND_SCHEMA)
    keys = list(dict.fromkeys([date_column, *tie_break]))
    needed = list(dict.fromkeys([*keys, *names]))
    indexed = OrderedRows(df.select(*map(col, needed)), keys).with_index("__x")
    fields = [df.schema[n] for n in names]
    centre = indexed.agg(F.avg("__x"), *[F.avg(number(f)) for f in fields]).first()
    entries = [
        F.struct(F.lit(i).alias("cid"), (number(f) - F.lit(centre[i + 1] or 0.0)).alias("y")) for i, f in enumerate(fields)
    ]
    long = indexed.select((F.col("__x") - F.lit(centre[0] or 0.0)).alias("x"), F.explode(F.array(*entries)).alias("e"))
    pairs = long.select("x", "e.cid", "e.y").where("y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    sums = pairs.groupBy("cid").agg(
        F.count("y").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"),
    )
    r = F.when(F.col("n") > 2, pearson("n", "sx", "sy", "xx", "yy", "xy"))
    found = sums.select("cid", lookup(names, F.col("cid"), "string").alias("column"), "n", r.alias("correlation"))
    size = F.abs("correlation")
    strength = F.when(size > STRONG, "Strong").when(size > MODERATE, "Moderate")
    direction = F.when(F.col("correlation") > 0, "increasing").otherwise("decreasing")
    return found.select(
        "*",
        strength.alias("strength"),
        F.when(strength.isNotNull(), direction).alias("direction"),
        F.concat(
            strength, F.lit(" "), direction, F.lit(" trend in '"), F.col("column"), F.lit("' over time (correlation: "),
            fixed(F.col("correlation"), 3), F.lit(")"),
        ).alias("message"),
    )

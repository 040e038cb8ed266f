"""Tables inside running text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.text import strip
from tablewright.types import col


def table_lines(df: DataFrame, text_column: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, header, row_number, cells)``: the table rows of each text, its first table line being the header.

    Table lines hold a tab, two spaces or a bar. The separator is decided per text: tab if any table line has one, else bar,
    else two or more spaces. All of it happens inside the row of the text, so nothing is shuffled.
    """
    lines = F.filter(
        F.transform(F.split(col(text_column), "\n"), strip),
        lambda line: line.contains("\t") | line.contains("  ") | line.contains("|"),
    )
    found = df.select(*map(col, keys), lines.alias("lines")).where(F.size("lines") > 0)
    separator = (
        F.when(F.exists("lines", lambda line: line.contains("\t")), "\\t")
        .when(F.exists("lines", lambda line: line.contains("|")), "\\|")
        .otherwise("\\s{2,}")
    )
    split = found.select(
        *map(col, keys), F.transform("lines", lambda line: F.transform(F.split(line, separator), strip)).alias("rows")
    )
    exploded = split.select(
        *map(col, keys), F.col("rows")[0].alias("header"), F.posexplode("rows").alias("row_number", "cells")
    )
    return exploded.where("row_number > 0")


def table_from_text(df: DataFrame, text_column: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same, with the named header columns as columns of the result; a text without a column has NULL there."""
    rows = table_lines(df, text_column, keys)

    def cell(name: str) -> Column:
        place = F.array_position("header", F.lit(name)).cast("int")
        return F.when(place > 0, F.nullif(F.try_element_at("cells", F.when(place > 0, place).otherwise(1)), F.lit(""))).alias(name)

    return rows.select(*map(col, keys), F.col("row_number").cast("bigint").alias("row_number"), *[cell(c) for c in columns])

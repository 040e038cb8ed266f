"""Finding the type that a text column really holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.text import strip
from tablewright.operators.frequencies import cardinalities
from tablewright.operators.longform import cells, one_row_per_column, ratio
from tablewright.operators.profile import column_counts, sample_values
from tablewright.types import NUMERIC, TEXT, col, columns_of, is_float, number

# Date and time layouts that are tried.
DATE_LAYOUTS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]
TIME_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "MM/dd/yyyy HH:mm:ss",
]
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _trimmed(name: str) -> Column:
    return strip(col(name))


def as_bigint(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE), text.try_cast("bigint"))


def as_double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _has_shape(text: Column, layout: str) -> Column:
    """Cheap test that the text has as many digits and the same separators as the layout."""
    shape = "".join(
        "[0-9]" if ch in "yMdHmsS" else "" if ch == "'" else "T" if ch == "T" else f"\\{ch}" if ch in "./-" else ch for ch in layout
    )
    return text.rlike(f"^{shape}$")


def as_timestamp(text: Column, layouts: Sequence[str] = (*DATE_LAYOUTS, *TIME_LAYOUTS)) -> Column:
    """The text by the layout that has its shape; NULL when it has none or is no valid date."""
    layout = F.coalesce(*[F.when(_has_shape(text, each), F.lit(each)) for each in layouts])
    return F.try_to_timestamp(text, layout).cast("timestamp_ntz")


def as_date(text: Column) -> Column:
    return as_timestamp(text, DATE_LAYOUTS).cast("date")


# Narrowest first. Numbers come before dates, so that 2020 stays a number.
_READERS = {"bigint": as_bigint, "double": as_double, "date": as_date, "timestamp_ntz": as_timestamp}


def _texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(cid, s)``: the trimmed texts of all columns, so that each test is compiled once and not once per column."""
    return cells(df, names, {"s": lambda f: _trimmed(f.name)})


def parse_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column can be read as each type, from one scan of all rows."""
    names = [c for c in (columns or columns_of(df, TEXT)) if c in columns_of(df, TEXT)]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "cid int, column string, non_null bigint, all_whole boolean, all_digits boolean, " + ", ".join(f"as_{t} bigint" for t in _READERS)
        )
    text = F.col("s")
    read = _texts(df, names).select(
        "cid", "s", *[reader(text).alias(kind) for kind, reader in _READERS.items() if kind != "timestamp_ntz"]
    )
    # A text that is a date is a timestamp as well; only the rest is tried with the time layouts.
    timed = F.coalesce(F.col("date").cast("timestamp_ntz"), F.when(F.col("double").isNull(), as_timestamp(text, TIME_LAYOUTS)))
    read = read.withColumn("timestamp_ntz", timed)
    counted = read.groupBy("cid").agg(
        F.count("s").alias("non_null"),
        F.coalesce(F.bool_and(F.col("double") % 1 == 0), F.lit(False)).alias("all_whole"),
        F.coalesce(F.bool_and(text.rlike(_WHOLE)), F.lit(False)).alias("all_digits"),
        *[F.count(kind).alias(f"as_{kind}") for kind in _READERS],
    )
    full = one_row_per_column(df, names, counted)
    numbers = ["non_null", *[f"as_{kind}" for kind in _READERS]]
    return full.select(
        "cid", "column", F.coalesce("all_whole", F.lit(False)).alias("all_whole"),
        F.coalesce("all_digits", F.lit(False)).alias("all_digits"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
    )


def inferred_type() -> Column:
    """A type is adopted only if every known value can be read as it without loss.

    Whole numbers that do not all fit a bigint stay text: as doubles, long identifiers would become equal.
    """
    choice = F.when(F.col("non_null") == 0, F.lit("string"))
    for kind in _READERS:
        choice = choice.when(F.col(f"as_{kind}") == F.col("non_null"), F.lit(kind))
        if kind == "bigint":
            choice = choice.when(F.col("all_digits"), F.lit("string"))
    return choice.otherwise(F.lit("string"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(cid, column, non_null, as_..., inferred_type)`` for each text column."""
    return parse_counts(df, columns).withColumn("inferred_type", inferred_type()).drop("all_whole", "all_digits")


def typed(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Read text columns as the planned types; a pure projection."""
    def read(name: str) -> Column:
        reader = _READERS.get(plan.get(name, "string"))
        return reader(_trimmed(name)).alias(name) if reader else col(name)

    return df.select(*[read(c) for c in df.columns])


def type_plan(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    return {r["column"]: r["inferred_type"] for r in infer_types(df, columns).collect()}


def retype_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Give every text column the narrowest type that reads all of its values."""
    return typed(df, type_plan(df, columns))


def suggest_types(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``datetime``, ``integer``, ``float`` or ``category`` for each text column, or NULL.

    A column of whole numbers is an integer even if written with a fraction of zero; few distinct values (less than
    half of the rows) make a category.
    """
    found = parse_counts(df, columns)
    names = [c for c in (columns or columns_of(df, TEXT)) if c in columns_of(df, TEXT)]
    if not names:
        return found.withColumn("suggested_type", F.lit(None).cast("string"))
    distinct = cardinalities(df, names, exact).select("cid", "row_count", "distinct")
    joined = found.join(F.broadcast(distinct), "cid")  # one row per column of the schema on both sides
    known = F.col("non_null") > 0
    numeric = known & (F.col("as_double") == F.col("non_null"))
    dated = known & (F.col("as_timestamp_ntz") == F.col("non_null"))
    suggestion = (
        F.when(numeric & F.col("all_whole"), "integer")
        .when(numeric, "float")
        .when(dated, "datetime")
        .when(known & (ratio(F.col("distinct"), F.col("row_count")) < 0.5), "category")
    )
    return joined.select("cid", "column", "non_null", "distinct", suggestion.alias("suggested_type"))


def detect_types(df: DataFrame, samples: int = 5, exact: bool = True) -> DataFrame:
    """Type, class, missing and distinct values, samples and a better type for every column.

    A float column without gaps and fractions suggests ``integer``; texts as in :func:`suggest_types`.
    """
    counts = column_counts(df, exact=exact)
    shown = sample_values(df, limit=samples).select("cid", "samples")
    described = counts.join(F.broadcast(shown), "cid", "left")  # one row per column of the schema on each side
    floats = [n for n in columns_of(df, NUMERIC) if is_float(df.schema[n].dataType)]
    suggestions = suggest_types(df, exact=exact).select("column", "suggested_type")
    if floats:
        whole = cells(df, floats, {"v": number}).groupBy("cid").agg(
            F.coalesce(F.bool_and(F.coalesce(F.col("v") % 1 == 0, F.lit(False))), F.lit(False)).alias("whole")
        )
        named = one_row_per_column(df, floats, whole)
        suggestions = suggestions.unionByName(named.select("column", F.when(F.col("whole"), "integer").alias("suggested_type")))
    return described.join(F.broadcast(suggestions), "column", "left").select(
        "cid", "column", "data_type", "category", "null_count", "null_pct", "distinct", "samples", "suggested_type"
    )

"""Column profiles: one tidy row per column.

Each profile is one explode and one ``groupBy`` over the column number (see :mod:`longform`); quantiles and value
frequencies come from their own kernels. Column-sized results that a later pass needs (means, quartiles) are the
only things that visit the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import patterns as P
from tablewright.functions.text import is_blank, is_digits, is_lower, is_mixed_case, is_upper
from tablewright.operators import frequencies
from tablewright.operators.frequencies import cardinalities, smallest_values
from tablewright.operators.longform import cells, fields_of, lookup, no_nan, one_row_per_column, percent
from tablewright.operators.outliers import fences, outside
from tablewright.operators.quantiles import centres, quantiles
from tablewright.types import DATETIME, NUMERIC, TEXT, col, columns_of, epoch_micros, number, type_class

QUARTILES = (0.25, 0.5, 0.75)


def _chosen(df: DataFrame, columns: Sequence[str] | None, *classes: str) -> list[str]:
    allowed = columns_of(df, *classes) if classes else df.columns
    return [c for c in (columns if columns is not None else allowed) if c in allowed]


def empty_profile(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def type_names(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f.dataType.simpleString() for f in fields_of(df, columns)]


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows, nulls and distinct values of every column."""
    names = _chosen(df, columns)
    found = cardinalities(df, names, exact)
    cid = F.col("cid")
    return found.select(
        "cid",
        "column",
        lookup(type_names(df, names), cid, "string").alias("data_type"),
        lookup([type_class(f.dataType) for f in fields_of(df, names)], cid, "string").alias("category"),
        "row_count",
        "non_null",
        (F.col("row_count") - F.col("non_null")).alias("null_count"),
        percent(F.col("row_count") - F.col("non_null"), F.col("row_count")).alias("null_pct"),
        "distinct",
        percent(F.col("distinct"), F.col("row_count")).alias("distinct_pct"),
    )


class NumericStats:
    """Means and quartiles of the numeric columns: what the second pass over the data needs to know."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True):
        self.df = df
        self.columns = _chosen(df, columns, NUMERIC)
        if exact:
            found = centres(df, self.columns, QUARTILES)
            self.quartiles = {n: c.quantiles for n, c in found.items()}
            self.means = {n: c.mean for n, c in found.items()}
        else:
            self.quartiles = quantiles(df, self.columns, QUARTILES, exact=False)
            rows = cells(df, self.columns, {"v": number}).groupBy("cid").agg(F.avg("v").alias("mean")).collect()
            self.means = {self.columns[r["cid"]]: r["mean"] for r in rows}


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, stats: NumericStats | None = None) -> DataFrame:
    """Range, centre, spread, shape, quartiles, outliers, zeros and negatives of the numeric columns."""
    stats = stats or NumericStats(df, columns, exact)
    names = stats.columns
    if not names:
        return empty_profile(df, NUMERIC_SCHEMA)
    cid, v = F.col("cid"), F.col("v")
    centred = v - lookup([stats.means.get(n) for n in names], cid, "double")
    power = {2: centred * centred, 3: centred * centred * centred, 4: centred * centred * centred * centred}
    far_out = outside(fences(stats.quartiles), names)
    sums = (
        cells(df, names, {"v": number})
        .groupBy("cid")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("v").alias("non_null"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            *[F.sum(power[k]).alias(f"s{k}") for k in power],
            F.count_if(far_out).alias("outlier_count"),
            F.count_if(v == 0).alias("zero_count"),
            F.count_if(v < 0).alias("negative_count"),
            F.count_if(F.abs(v) == float("inf")).alias("infinite_count"),
            F.coalesce(F.bool_and(v % 1 == 0), F.lit(False)).alias("all_whole"),
        )
    )
    full = one_row_per_column(df, names, sums)
    n = F.col("non_null").cast("double")
    m2, m3, m4 = (F.try_divide(F.col(f"s{k}"), n) for k in (2, 3, 4))
    g1 = no_nan(F.try_divide(m3, F.pow(m2, F.lit(1.5))))
    g2 = no_nan(F.try_divide(m4, m2 * m2) - 3)
    counts = ["row_count", "non_null", "outlier_count", "zero_count", "negative_count", "infinite_count"]
    return full.select(
        "cid",
        "column",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("all_whole", F.lit(False)).alias("all_whole"),
        "min",
        "max",
        lookup([stats.means.get(c) for c in names], cid, "double").alias("mean"),
        *[lookup([stats.quartiles[c][i] for c in names], cid, "double").alias(q) for i, q in enumerate(("q25", "median", "q75"))],
        F.when(n > 1, no_nan(F.sqrt(F.try_divide(F.col("s2"), n - 1)))).alias("std"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).alias("skewness"),
        F.when(
            n > 3, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g2 + 6)
        ).alias("kurtosis"),
        g1.alias("population_skewness"),
        g2.alias("population_kurtosis"),
    ).withColumn("outlier_count", F.when(F.col("row_count") >= 4, F.col("outlier_count")).otherwise(F.lit(0).cast("bigint")))


NUMERIC_SCHEMA = (
    "cid int, column string, row_count bigint, non_null bigint, outlier_count bigint, zero_count bigint, "
    "negative_count bigint, infinite_count bigint, all_whole boolean, min double, max double, mean double, "
    "q25 double, median double, q75 double, std double, skewness double, kurtosis double, "
    "population_skewness double, population_kurtosis double"
)


def _raw(field: T.StructField) -> Column:
    return col(field.name)


# What is counted per text column.
TEXT_FLAGS = {
    "empty_count": lambda c: c == "",
    "blank_count": is_blank,
    "contains_numbers": lambda c: c.rlike(P.HAS_DIGIT),
    "contains_special_chars": lambda c: c.rlike(P.HAS_SPECIAL),
    "all_uppercase": is_upper,
    "all_lowercase": is_lower,
    "starts_with_number": lambda c: c.rlike(P.STARTS_WITH_DIGIT),
    "email_like": lambda c: c.rlike(P.EMAIL_LIKE),
    "url_like": lambda c: c.rlike(P.URL_LIKE),
    "phone_like": lambda c: c.rlike(P.PHONE_LIKE),
}
LENGTH_FLAGS = ("empty_count", "blank_count")
PATTERN_FLAGS = tuple(name for name in TEXT_FLAGS if name not in LENGTH_FLAGS)

# The stricter patterns that decide what a text column is about.
KIND_FLAGS = {
    "email_like": lambda c: c.rlike(P.PII_PATTERNS["email"]),
    "phone_like": lambda c: c.rlike(P.PII_PATTERNS["phone"]),
    "url_like": lambda c: c.rlike(P.URL_LIKE + r"\S"),
    "date_like": lambda c: c.rlike(P.DATE_LIKE),
    "numeric_string": is_digits,
    "all_caps": is_upper,
    "mixed_case": is_mixed_case,
}


def count_flags(df: DataFrame, flags: dict, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column pass each test. Nulls pass none."""
    names = _chosen(df, columns, TEXT)
    if not names:
        return empty_profile(df, "cid int, column string, " + ", ".join(f"{f} bigint" for f in flags))
    # Tests follow the explode, so that each is compiled once and not once per column.
    texts = cells(df, names, {"s": _raw})
    counted = texts.groupBy("cid").agg(*[F.count_if(test(F.col("s"))).alias(f) for f, test in flags.items()])
    full = one_row_per_column(df, names, counted)
    return full.select("cid", "column", *[F.coalesce(F.col(f), F.lit(0)).cast("bigint").alias(f) for f in flags])


def pattern_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts of digits, special characters, case forms and address-like texts."""
    return count_flags(df, {f: TEXT_FLAGS[f] for f in PATTERN_FLAGS}, columns)


def kind_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts of values that look like mail addresses, phones, links, dates, numbers, and of case forms."""
    return count_flags(df, KIND_FLAGS, columns)


def length_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lengths, and empty and blank values, of the text columns."""
    names = _chosen(df, columns, TEXT)
    if not names:
        return empty_profile(df, LENGTH_SCHEMA)
    # Lengths first become a small (column, length) table, so that their distinct count needs no second shuffle.
    texts = cells(df, names, {"s": _raw})
    by_length = texts.groupBy("cid", F.length("s").alias("len")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(TEXT_FLAGS[f](F.col("s"))).alias(f) for f in LENGTH_FLAGS]
    )
    n = F.col("n").cast("double")
    stats = by_length.groupBy("cid").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("len").isNotNull(), F.col("n"))).alias("non_null"),
        F.sum(F.col("len") * F.col("n")).alias("sum_length"),
        F.sum(F.col("len").cast("double") * F.col("len") * n).alias("sum_squares"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.count("len").alias("distinct_lengths"),
        *[F.sum(f).alias(f) for f in LENGTH_FLAGS],
    )
    full = one_row_per_column(df, names, stats)
    known = F.col("non_null").cast("double")
    mean = F.try_divide(F.col("sum_length").cast("double"), known)
    variance = F.try_divide(F.col("sum_squares") - known * mean * mean, known - 1)
    counts = ["row_count", "non_null", "distinct_lengths", *LENGTH_FLAGS]
    return full.select(
        "cid",
        "column",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.col("min_length").cast("bigint").alias("min_length"),
        F.col("max_length").cast("bigint").alias("max_length"),
        mean.alias("average_length"),
        F.greatest(variance, F.lit(0.0)).alias("length_variance"),
    )


LENGTH_SCHEMA = (
    "cid int, column string, row_count bigint, non_null bigint, distinct_lengths bigint, empty_count bigint, "
    "blank_count bigint, min_length bigint, max_length bigint, average_length double, length_variance double"
)


def text_modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value of each text column and how often it occurs; the smallest value on ties."""
    names = _chosen(df, columns, TEXT)
    if not names:
        return empty_profile(df, "cid int, column string, most_frequent string, most_frequent_count bigint")
    found = frequencies.text_modes(df, names)
    rows = [(i, n, *found.get(n, (None, 0))) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "cid int, column string, most_frequent string, most_frequent_count bigint")


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value, lengths, blanks and patterns of the text columns."""
    base = length_profile(df, columns)
    extra = [text_modes(df, columns), pattern_profile(df, columns)]
    for other in extra:  # one row per column on both sides
        base = base.join(F.broadcast(other.drop("column")), "cid")
    return base


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last moment, and the whole days between them."""
    names = _chosen(df, columns, DATETIME)
    if not names:
        return empty_profile(df, "cid int, column string, min_date timestamp_ntz, max_date timestamp_ntz, date_range_days bigint")
    # Shown in local time; measured in elapsed time.
    parts = {"shown": lambda f: col(f.name).cast("timestamp_ntz"), "micros": epoch_micros}
    found = cells(df, names, parts).groupBy("cid").agg(
        F.min("shown").alias("min_date"), F.max("shown").alias("max_date"),
        F.min("micros").alias("lo"), F.max("micros").alias("hi"),
    )
    full = one_row_per_column(df, names, found)
    return full.select(
        "cid",
        "column",
        "min_date",
        "max_date",
        F.floor((F.col("hi") - F.col("lo")) / F.lit(86_400_000_000)).cast("bigint").alias("date_range_days"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies, nulls equal to each other. One row."""
    groups = df.select(*[comparable(f).alias(f"k{i}") for i, f in enumerate(df.schema.fields)])
    counted = groups.groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kinds"))
    return total.select(
        F.col("rows").cast("bigint").alias("total_rows"),
        F.col("kinds").cast("bigint").alias("distinct_rows"),
        (F.col("rows") - F.col("kinds")).cast("bigint").alias("duplicate_rows"),
    )


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be grouped; maps cannot, so they go by their sorted entries."""
    if isinstance(field.dataType, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col(field.name))))
    return col(field.name)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any missing value. One row."""
    no_gap = F.lit(True)
    for f in df.schema.fields:
        known = ~F.isnan(col(f.name)) & col(f.name).isNotNull() if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name).isNotNull()
        no_gap = no_gap & known
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(no_gap).alias("complete_rows"))


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 5) -> DataFrame:
    """The smallest distinct values of each column, as texts."""
    names = _chosen(df, columns)
    return one_row_per_column(df, names, smallest_values(df, names, limit))

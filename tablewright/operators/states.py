"""Mergeable column states: a profile that grows with its table without reading old rows again.

A state is one row per column, of a size that does not depend on the rows behind it: counts, central moments, extremes, and
sketches of the distinct values (HLL), of the quantiles (KLL) and of the frequent values. States of parts of a table,
or of yesterday's table and today's rows, merge into the state of the union. They can be written as Parquet and kept.

Counts, extremes and lengths of the merged state are exact, moments are up to rounding. Sketches are bound as follows:
distinct values by ``DISTINCT_ERROR`` (relative, three standard errors), the rank of a quantile by ``RANK_ERROR`` of
the rows, the count of a frequent value by ``top_error`` of the rows. Frequent values are those that certainly occur
more often than that; a column without any has no ``most_frequent``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.formats import as_text
from tablewright.operators.frequencies import _LONG_TEXT, moment, top_error
from tablewright.operators.longform import cells, fields_of, lookup, no_nan, one_row_per_column, percent
from tablewright.operators.profile import TEXT_FLAGS
from tablewright.session import materialize
from tablewright.types import DATETIME, NUMERIC, TEXT, col, epoch_micros, present, require_columns, type_class

#: Base-2 logarithm of the registers of the distinct sketch, and three standard errors of its estimate.
LG_REGISTERS, DISTINCT_ERROR = 13, 3 * 1.04 / 2**6.5
#: Size parameter of the quantile sketch, and by what share of the rows a rank may be off (99 of 100 times).
QUANTILE_ITEMS, RANK_ERROR = 800, 0.005
#: Values whose frequency is tracked in each column.
TRACKED = 2_000

_COUNTS = ("row_count", "non_null", "infinite_count", "zero_count", "negative_count", "sum_length", *TEXT_FLAGS)
_LEAST = ("min", "min_length", "first_micros")
_MOST = ("max", "max_length", "last_micros")


def _numeric(field: T.StructField) -> Column:
    return present(field).cast("double") if type_class(field.dataType) == NUMERIC else F.lit(None).cast("double")


def _text(field: T.StructField) -> Column:
    return col(field.name).cast("string") if type_class(field.dataType) == TEXT else F.lit(None).cast("string")


def _micros(field: T.StructField) -> Column:
    return epoch_micros(field) if type_class(field.dataType) == DATETIME else F.lit(None).cast("bigint")


def _value(field: T.StructField) -> Column:
    """The value as text, a long one by its SHA-256."""
    value = as_text(present(field), field.dataType)
    return F.when(F.length(value) > _LONG_TEXT, F.sha2(value, 256)).otherwise(value)


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The state of each column of a table, in one scan; a task passes on one row of fixed size per column.

    NaN is missing. Infinite values are counted and left out of moments and quantiles, not of the extremes. A table without
    rows has states of zero rows.
    """
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)
    v, s = F.col("v"), F.col("s")
    finite = F.when(F.abs(v) < float("inf"), v)
    parts = {"v": _numeric, "s": _text, "micros": _micros, "value": _value}
    n = F.col("n").cast("double")
    # Spark's own aggregates are mergeable and stable; central moments follow from them.
    sums = cells(df, names, parts).groupBy("cid").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("value").alias("non_null"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite_count"),
        F.count_if(v == 0).alias("zero_count"),
        F.count_if(v < 0).alias("negative_count"),
        F.coalesce(F.sum(F.length(s)), F.lit(0)).cast("bigint").alias("sum_length"),
        *[F.count_if(test(s)).alias(flag) for flag, test in TEXT_FLAGS.items()],
        F.count(finite).alias("n"),
        F.avg(finite).alias("mean"),
        F.var_pop(finite).alias("variance"),
        F.skewness(finite).alias("skew"),
        F.kurtosis(finite).alias("kurt"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.min(F.length(s)).cast("bigint").alias("min_length"),
        F.max(F.length(s)).cast("bigint").alias("max_length"),
        F.min("micros").alias("first_micros"),
        F.max("micros").alias("last_micros"),
        F.hll_sketch_agg("value", LG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(finite, F.lit(QUANTILE_ITEMS)).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED}) FILTER (WHERE value IS NOT NULL)").alias("top_sketch"),
    )
    m2 = F.col("variance") * n
    full = one_row_per_column(df, names, sums)
    return full.select(
        "column",
        lookup([f.dataType.simpleString() for f in fields_of(df, names)], F.col("cid"), "string").alias("data_type"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "mean",
        m2.alias("m2"),
        F.when(n > 0, F.coalesce(no_nan(F.col("skew")), F.lit(0.0)) * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).alias("m3"),
        F.when(n > 0, F.coalesce(no_nan(F.col("kurt")) + 3, F.lit(0.0)) * m2 * m2 / n).alias("m4"),
        *_LEAST,
        *_MOST,
        "distinct_sketch",
        "quantile_sketch",
        "top_sketch",
    )


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of the union of the tables behind the given states, one row per column.

    Columns meet by name; one that a table lacks has no rows there. A column with different types is an error, since its
    values would be compared in two forms. A table may hold many states of one column, such as one a day.
    """
    if not states:
        raise ValueError("no states to merge")
    # Kept, since their mean and their moments are two passes: a state may be a scan of its table.
    rows = materialize(reduce(DataFrame.unionByName, states))
    n = F.col("n").cast("double")
    # Only states are moved: first their common mean, then moments around it.
    means = rows.groupBy("column").agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("all_mean"))
    moved = rows.join(means, "column")
    d = F.col("mean") - F.col("all_mean")
    total = {
        "m2": F.col("m2") + n * d * d,
        "m3": F.col("m3") + 3 * d * F.col("m2") + n * d * d * d,
        "m4": F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d,
    }
    kinds = F.collect_set("data_type")
    one_type = F.when(F.size(kinds) == 1, kinds[0]).otherwise(
        F.raise_error(F.concat(F.lit("types differ in column "), F.first("column"))).cast("string")
    )
    return moved.groupBy("column").agg(
        one_type.alias("data_type"),
        *[F.sum(c).cast("bigint").alias(c) for c in _COUNTS],
        F.sum("n").cast("bigint").alias("n"),
        F.first("all_mean").alias("mean"),
        *[F.sum(value).alias(name) for name, value in total.items()],
        *[F.min(c).alias(c) for c in _LEAST],
        *[F.max(c).alias(c) for c in _MOST],
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILE_ITEMS)).alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED}) FILTER (WHERE top_sketch IS NOT NULL)").alias("top_sketch"),
    )


def profile_of(states: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a state tells about each column; ``quantiles`` has a value for each of ``probs``."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    variance = F.try_divide(m2, n)
    # Listed are only values that certainly occur more often than the sketch may err.
    top = F.when(F.col("non_null") > 0, F.get(F.expr("approx_top_k_estimate(top_sketch, 1)"), 0))
    return states.select(
        "column",
        "data_type",
        "row_count",
        "non_null",
        (F.col("row_count") - F.col("non_null")).alias("null_count"),
        percent(F.col("row_count") - F.col("non_null"), F.col("row_count")).alias("null_pct"),
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("distinct"),
        "min",
        "max",
        "mean",
        F.when(n > 1, F.sqrt(F.try_divide(m2, n - 1))).alias("std"),
        no_nan(F.try_divide(F.col("m3") / n, F.pow(variance, F.lit(1.5)))).alias("population_skewness"),
        no_nan(F.try_divide(F.col("m4") / n, variance * variance) - 3).alias("population_kurtosis"),
        F.when(n > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*map(F.lit, probs)))).alias("quantiles"),
        "infinite_count",
        "zero_count",
        "negative_count",
        "min_length",
        "max_length",
        F.try_divide(F.col("sum_length").cast("double"), F.when(F.col("min_length").isNotNull(), F.col("non_null"))).alias("average_length"),
        *TEXT_FLAGS,
        moment("first_micros").alias("first"),
        moment("last_micros").alias("last"),
        top["item"].alias("most_frequent"),
        top["count"].alias("most_frequent_count"),
        F.floor(F.col("row_count") * top_error(TRACKED)).alias("most_frequent_error"),
    )

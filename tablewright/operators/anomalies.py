"""Findings about suspicious columns, as rows of a rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.formats import fixed
from tablewright.operators.frequencies import cardinalities
from tablewright.operators.longform import lookup
from tablewright.operators.profile import NumericStats, length_profile, numeric_profile, pattern_profile
from tablewright.types import NUMERIC, TEXT, columns_of

# Limits of the rules.
OUTLIER_SHARE = 0.05
SKEW_LIMIT = 3.0
LENGTH_SHARE = 0.8
MIXED_CASE_SHARE = 0.5
MIN_NUMBERS = 11


def _finding(rule: str, applies: Column, metric: Column, threshold: float, *message) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in message]
    return F.when(
        applies,
        F.struct(
            F.lit(rule).alias("rule"),
            metric.cast("double").alias("metric"),
            F.lit(float(threshold)).alias("threshold"),
            F.concat(F.lit("Column '"), F.col("column"), F.lit("' "), *parts).alias("message"),
        ),
    )


def _findings(rows: DataFrame, checks: list[Column], position: Column) -> DataFrame:
    found = rows.select(position.alias("position"), "column", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return found.select("position", "column", "f.rule", "f.metric", "f.threshold", "f.message")


def anomalies(df: DataFrame, exact: bool = True, stats: NumericStats | None = None) -> DataFrame:
    """``(position, column, rule, metric, threshold, message)`` for every rule that a column breaks."""
    parts = []
    numeric, texts = columns_of(df, NUMERIC), columns_of(df, TEXT)
    if numeric:
        profile = numeric_profile(df, exact=exact, stats=stats)
        distinct = cardinalities(df, numeric, exact).select("cid", "distinct")
        rows = profile.join(F.broadcast(distinct), "cid").where(F.col("non_null") >= MIN_NUMBERS)
        total = F.col("row_count").cast("double")
        skew = F.abs("skewness")
        checks = [
            _finding(
                "many_outliers", F.col("outlier_count") > total * OUTLIER_SHARE, F.col("outlier_count") / total,
                OUTLIER_SHARE, "has ", F.col("outlier_count").cast("string"), " outliers (",
                fixed(F.col("outlier_count") / total * 100, 1), "%)",
            ),
            _finding("single_value", F.col("distinct") == 1, F.col("distinct"), 1, "has only one unique value"),
            _finding("extreme_skew", skew > SKEW_LIMIT, skew, SKEW_LIMIT, "is highly skewed (skewness: ", fixed(skew, 2), ")"),
        ]
        parts.append(_findings(rows, checks, lookup([df.columns.index(c) for c in numeric], F.col("cid"), "int")))
    if texts:
        lengths = length_profile(df)
        case = pattern_profile(df).select("cid", "all_uppercase", "all_lowercase")
        rows = lengths.join(F.broadcast(case), "cid")
        total = F.col("row_count").cast("double")
        varied = F.try_divide(F.col("distinct_lengths").cast("double"), total)
        mixed = F.try_divide((F.col("non_null") - F.col("all_uppercase") - F.col("all_lowercase")).cast("double"), total)
        checks = [
            _finding("varied_lengths", varied > LENGTH_SHARE, varied, LENGTH_SHARE, "has inconsistent text lengths"),
            _finding("mixed_case", mixed > MIXED_CASE_SHARE, mixed, MIXED_CASE_SHARE, "has mixed case formatting"),
        ]
        parts.append(_findings(rows, checks, lookup([df.columns.index(c) for c in texts], F.col("cid"), "int")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, rule string, metric double, threshold double, message string"
        )
    return reduce(lambda a, b: a.unionAll(b), parts)

"""Quality scores of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.text import is_blank
from tablewright.operators.frequencies import cardinalities
from tablewright.operators.longform import cells, lookup, one_row_per_column, ratio
from tablewright.operators.profile import length_profile
from tablewright.types import NUMERIC, TEXT, fields_are, number, present, type_class

# Weights of the scores and the grades they lead to.
WEIGHTS = {"completeness": 0.3, "uniqueness": 0.2, "consistency": 0.25, "validity": 0.25}
GRADES = [(0.9, "A (Excellent)"), (0.8, "B (Good)"), (0.7, "C (Fair)"), (0.6, "D (Poor)")]
LOWEST_GRADE = "F (Very Poor)"
DESCRIPTIONS = {
    "completeness": "Percentage of non-null values",
    "uniqueness": "Average uniqueness ratio across columns",
    "consistency": "Consistency of data formats and patterns",
    "validity": "Percentage of values that appear valid",
    "overall_score": "Weighted average of all quality metrics",
}
STEADY = 0.9


def _is_valid(field: T.StructField) -> Column:
    """Finite number, text that is not blank, or any known value of another type."""
    kind = type_class(field.dataType)
    if kind == NUMERIC:
        return F.coalesce(F.abs(number(field)) < float("inf"), F.lit(False))
    if kind == TEXT:
        return F.coalesce(~is_blank(present(field)), F.lit(False))
    return present(field).isNotNull()


def column_quality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Completeness, uniqueness, validity and consistency of every column."""
    names = df.columns
    counts = cardinalities(df, names, exact)
    valid = cells(df, names, {"ok": _is_valid}).groupBy("cid").agg(F.count_if("ok").alias("valid"))
    text = fields_are(df, TEXT)
    joined = counts.join(F.broadcast(valid), "cid", "left")  # one row per column of the schema
    rows = F.col("row_count")
    if any(text):
        lengths = length_profile(df).select("column", "average_length", "length_variance")
        joined = joined.join(F.broadcast(lengths), "column", "left")
        wobble = F.when(F.col("average_length") > 0, F.col("length_variance") / F.col("average_length")).otherwise(0.0)
        steadiness = F.when(
            lookup(text, F.col("cid"), "boolean"), F.greatest(F.lit(0.0), 1 - F.coalesce(wobble, F.lit(0.0)) / 10)
        ).otherwise(F.lit(STEADY))
    else:
        steadiness = F.lit(STEADY)
    return joined.select(
        "cid",
        "column",
        "row_count",
        "non_null",
        "distinct",
        ratio(F.col("non_null"), rows).alias("completeness"),
        ratio(F.col("distinct"), rows).alias("uniqueness"),
        ratio(F.coalesce("valid", F.lit(0)), rows).alias("validity"),
        steadiness.alias("consistency"),
    )


def quality_metrics(df: DataFrame, exact: bool = True) -> DataFrame:
    """Completeness, uniqueness and validity of the table: rows ``(metric, score)``; 0 for an empty table."""
    scores = ("completeness", "uniqueness", "validity")
    one = column_quality(df, exact).agg(*[F.coalesce(F.avg(s), F.lit(0.0)).alias(s) for s in scores])
    return one.select(F.explode(F.array(*[_named(s, F.col(s)) for s in scores])).alias("m")).select("m.*")


def _named(metric: str, score: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), score.alias("score"))


def grade(score: Column) -> Column:
    letters = F.when(score >= GRADES[0][0], GRADES[0][1])
    for limit, name in GRADES[1:]:
        letters = letters.when(score >= limit, name)
    return letters.otherwise(LOWEST_GRADE)


def quality_assessment(df: DataFrame, exact: bool = True) -> DataFrame:
    """All four scores and their weighted total with its grade: ``(metric, score, grade, description)``."""
    one = column_quality(df, exact).agg(*[F.coalesce(F.avg(s), F.lit(0.0)).alias(s) for s in WEIGHTS])
    total = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0))
    entries = [_named(s, F.col(s)) for s in WEIGHTS] + [_named("overall_score", total)]
    long = one.select(F.explode(F.array(*entries)).alias("m")).select("m.*")
    described = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return long.select(
        "metric",
        "score",
        F.when(F.col("metric") == "overall_score", grade(F.col("score"))).alias("grade"),
        described[F.col("metric")].alias("description"),
    )

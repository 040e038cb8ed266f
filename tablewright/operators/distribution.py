"""Shape of numeric columns: normality, uniformity, a named shape, and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.longform import cells, lookup, no_nan, one_row_per_column
from tablewright.operators.ordered import OrderedRows
from tablewright.operators.profile import NumericStats, numeric_profile
from tablewright.types import NUMERIC, columns_of, number, require_columns

MIN_VALUES = 10


def with_normality(df: DataFrame, n: str, skew: str, kurtosis: str) -> DataFrame:
    """Add ``normality_statistic``: K-squared of D'Agostino and Pearson from the count and the population moments.

    Both parts are the published normal approximations: D'Agostino (1970) for the skewness and Anscombe and
    Glynn (1983) for the kurtosis, where ``kurtosis`` is the excess over the normal distribution. Steps are columns of
    their own, so that none is computed more than once.
    """
    names = ["__n", "__scaled", "__beta", "__w2", "__x", "__s", "__a", "__d", "__z1", "__z2"]
    count, scaled, beta, w2, x, s, a, d, z1, z2 = map(F.col, names)
    steps = [
        F.when(F.col(n) >= 8, F.col(n).cast("double")),
        F.col(skew) * F.sqrt((count + 1) * (count + 3) / (6 * (count - 2))),
        3 * (count * count + 27 * count - 70) * (count + 1) * (count + 3)
        / ((count - 2) * (count + 5) * (count + 7) * (count + 9)),
        F.sqrt(2 * (beta - 1)) - 1,
        (F.col(kurtosis) + 3 - 3 * (count - 1) / (count + 1))
        / F.sqrt(24 * count * (count - 2) * (count - 3) / ((count + 1) * (count + 1) * (count + 3) * (count + 5))),
        6 * (count * count - 5 * count + 2) / ((count + 7) * (count + 9))
        * F.sqrt(6 * (count + 3) * (count + 5) / (count * (count - 2) * (count - 3))),
        6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s))),
        1 + x * F.sqrt(2 / (a - 4)),
        F.asinh(scaled / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2)),
        (1 - 2 / (9 * a) - F.signum(d) * F.pow(F.try_divide(1 - 2 / a, F.abs(d)), F.lit(1.0 / 3))) / F.sqrt(2 / (9 * a)),
    ]
    for name, step in zip(names, steps):
        df = df.withColumn(name, step)
    return df.withColumn("normality_statistic", no_nan(z1 * z1 + z2 * z2)).drop(*names)


def shape_name(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """A name for the shape, from the sample skewness and excess kurtosis."""
    return (
        F.when(n < MIN_VALUES, "insufficient_data")
        .when((F.abs(skewness) < 0.5) & (F.abs(kurtosis) < 3), "approximately_normal")
        .when(skewness > 1, "right_skewed")
        .when(skewness < -1, "left_skewed")
        .when(kurtosis > 3, "heavy_tailed")
        .otherwise("unknown")
    )


def uniformity_distance(df: DataFrame, columns: Sequence[str] | None = None, rescale: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform distribution on (0, 1): ``(cid, column, n, ks_distance)``.

    Outside the unit interval the reference distribution is flat, so counts are enough. Inside it the distinct values
    with their counts are put in order and summed up range by range. ``rescale`` maps each column to its own range first.
    """
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    if not names:
        return df.sparkSession.createDataFrame([], "cid int, column string, n bigint, ks_distance double")
    values = cells(df, names, {"v": number}).where("v IS NOT NULL")
    if rescale:
        span = {r["cid"]: r for r in values.groupBy("cid").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        low, high = (
            lookup([span[i][side] if i in span else None for i in range(len(names))], F.col("cid"), "double")
            for side in ("lo", "hi")
        )
        values = values.select("cid", F.try_divide(F.col("v") - low, high - low).alias("v")).where("v IS NOT NULL")
    edges = values.groupBy("cid").agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v") <= 0).alias("low"),
        F.count_if(F.col("v") < 1).alias("below_one"),
    )
    known = {r["cid"]: r for r in edges.collect()}
    sizes = [known[i]["n"] if i in known else 0 for i in range(len(names))]
    lows = [known[i]["low"] if i in known else 0 for i in range(len(names))]
    inner_sizes = [known[i]["below_one"] - known[i]["low"] if i in known else 0 for i in range(len(names))]
    cid, n = F.col("cid"), lookup(sizes, F.col("cid"), "double")
    inner = values.where("v > 0 AND v < 1").groupBy("cid", "v").agg(F.count(F.lit(1)).alias("m"))
    running = OrderedRows(inner, ["cid", "v"]).with_running_sum(F.col("m"), "run")
    # The running sum goes on over all columns: take off the earlier ones, add the values below the interval.
    shift = lookup([lows[i] - sum(inner_sizes[:i]) for i in range(len(names))], cid, "bigint")
    upto, v = F.col("run") + shift, F.col("v")
    peak = running.groupBy("cid").agg(F.max(F.greatest(upto / n - v, v - (upto - F.col("m")) / n)).alias("d"))
    full = one_row_per_column(df, names, peak)
    outside = [max(lo, size - lo - inside) / size if size else None for lo, size, inside in zip(lows, sizes, inner_sizes)]
    return full.select(
        "cid", "column", lookup(sizes, cid, "bigint").alias("n"), F.greatest("d", lookup(outside, cid, "double")).alias("ks_distance")
    )


def kolmogorov_p_value(distance: Column, n: Column) -> Column:
    """Asymptotic two-sided p value."""
    x = distance * F.sqrt(n.cast("double"))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def distribution_profile(
    df: DataFrame, columns: Sequence[str] | None = None, rescale: bool = False, stats: NumericStats | None = None
) -> DataFrame:
    """Normality, uniformity and shape of each numeric column with at least ten values."""
    shape = with_normality(
        numeric_profile(df, columns, stats=stats), "non_null", "population_skewness", "population_kurtosis"
    )
    uniform = uniformity_distance(df, columns, rescale).select("cid", "ks_distance")
    joined = shape.join(F.broadcast(uniform), "cid")
    joined = joined.withColumn("p_normal", F.exp(-F.col("normality_statistic") / 2))
    joined = joined.withColumn("p_uniform", kolmogorov_p_value(F.col("ks_distance"), F.col("non_null")))
    enough = F.col("non_null") >= MIN_VALUES
    return joined.select(
        "cid",
        "column",
        "non_null",
        F.when(enough, F.col("normality_statistic")).alias("normality_statistic"),
        F.when(enough, F.col("p_normal")).alias("normality_p_value"),
        F.when(enough, F.col("p_normal") > 0.05).alias("is_normal"),
        F.when(enough, F.col("ks_distance")).alias("uniformity_statistic"),
        F.when(enough, F.col("p_uniform")).alias("uniformity_p_value"),
        F.when(enough, F.col("p_uniform") > 0.05).alias("is_uniform"),
        shape_name(F.col("non_null"), F.col("skewness"), F.col("kurtosis")).alias("distribution_type"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with their counts, empty bins included; the maximum belongs to the last bin.

    Bins span the finite values. Infinite ones, where there are any, are counted in bin -1 and in bin ``bins``.
    """
    require_columns(df, [column])
    given = number(df.schema[column])
    infinite = F.abs(given) == F.lit(float("inf"))
    value = F.when(~infinite, given)
    low, high, below, above = df.agg(
        F.min(value), F.max(value), F.count_if(infinite & (given < 0)), F.count_if(infinite & (given > 0))
    ).first()
    spark = df.sparkSession
    ends = [(-1, float("-inf"), float("-inf"), below), (bins, float("inf"), float("inf"), above)]
    apart = spark.createDataFrame([e for e in ends if e[3]], "bin int, low double, high double, n bigint")
    if low is None:
        return apart
    width = (high - low) / bins
    place = (
        F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    )
    counted = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("found"))
    frame = spark.range(0, bins, 1, 1).select(F.col("id").cast("int").alias("bin"))
    spans = frame.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("n"),
    )
    return spans.unionByName(apart) if below or above else spans

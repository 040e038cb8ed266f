import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import distribution, overview, profile, quality
from tablewright.operators.anomalies import anomalies
from tablewright.operators.correlation import correlation_matrix, correlations, strong_pairs, summarize_strong_pairs
from tablewright.operators.outliers import OutlierCapper, outlier_counts
from tablewright.operators.trend import trends


def one(df, column):
    return df.where(F.col("column") == column).first().asDict()


def test_counts_of_every_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 'a', true, array(1), map('k', 1), 1.50BD, date'2024-01-01'),
        (2, 'a', NULL, array(1), map('k', 2), 2.50BD, NULL), (NULL, '', false, NULL, map('k', 1), NULL, date'2024-01-03')
        AS t(n, s, b, l, m, d, t)"""
    )
    found = {r["column"]: (r["non_null"], r["distinct"]) for r in profile.column_counts(df).collect()}
    assert found == {"n": (2, 2), "s": (3, 2), "b": (2, 2), "l": (2, 1), "m": (3, 2), "d": (2, 2), "t": (2, 2)}
    approx = {r["column"]: (r["non_null"], r["distinct"]) for r in profile.column_counts(df, exact=False).collect()}
    assert approx == found


def test_empty_table_has_a_row_per_column(spark):
    df = spark.createDataFrame([], "n double, s string, t timestamp_ntz")
    assert one(profile.column_counts(df), "n")["null_pct"] is None
    assert profile.numeric_profile(df).first()["mean"] is None
    assert profile.text_profile(df).first()["most_frequent_count"] == 0
    assert profile.datetime_profile(df).first()["min_date"] is None
    assert {r["metric"]: r["score"] for r in quality.quality_metrics(df).collect()} == {
        "completeness": 0.0, "uniqueness": 0.0, "validity": 0.0,
    }
    checks = {r["rule"]: r["passed"] for r in overview.validate_table(df).collect()}
    assert not checks["not_empty"] and not checks["no_empty_columns"]
    assert anomalies(df).count() == 0
    assert correlations(spark.createDataFrame([], "a double, b double")).first()["r"] is None


def test_numeric_profile_with_special_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, -3, 4)] + [(None,), (float("nan"),)], "x double")
    found = one(profile.numeric_profile(df), "x")
    assert (found["row_count"], found["non_null"], found["zero_count"], found["negative_count"]) == (7, 5, 1, 1)
    assert found["mean"] == pytest.approx(0.8) and found["all_whole"]
    assert found["std"] == pytest.approx(2.588435821)
    infinite = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,)], "x double")
    assert one(profile.numeric_profile(infinite), "x")["infinite_count"] == 1


def test_constant_column_has_no_shape_and_no_correlation(spark):
    df = spark.range(0, 50).select(F.lit(0.1).alias("k"), F.col("id").cast("double").alias("x"))
    found = one(profile.numeric_profile(df), "k")
    assert found["std"] == pytest.approx(0, abs=1e-12)
    pair = correlations(df).first()
    assert pair["r"] is None and pair["n"] == 50


def test_outliers_need_four_rows(spark):
    assert outlier_counts(spark.createDataFrame([(1.0,), (1.0,), (100.0,)], "x double")).first()["outlier_count"] == 0
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1000, -1000]], "x double")
    assert outlier_counts(df).first()["outlier_count"] == 2
    capper = OutlierCapper().fit(df)
    capped = capper.transform(df)
    low, high = capper.fences["x"]
    assert capper.affected == {"x": 2}
    assert capped.where((F.col("x") < low) | (F.col("x") > high)).count() == 0
    assert sorted(capper.transform(capped).collect()) == sorted(capped.collect())


def test_capping_keeps_whole_numbers_without_outliers(spark):
    df = spark.range(0, 20).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") > 3, F.col("id").cast("double")).alias("x"))
    capped = OutlierCapper().fit(df).transform(df)
    assert dict(capped.dtypes) == {"n": "int", "x": "double"}
    assert capped.where("x IS NULL").count() == 4


def test_text_profile_excludes_nulls(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), (None,), ("",), (" \n",), ("a1@b.c",), ("Aé",), ("123-456-7890",)], "s string")
    found = one(profile.text_profile(df), "s")
    assert found["non_null"] == 7 and found["empty_count"] == 1 and found["blank_count"] == 2
    assert found["all_uppercase"] == 1 and found["all_lowercase"] == 2
    assert found["email_like"] == 1 and found["phone_like"] == 1 and found["contains_numbers"] == 2
    assert found["contains_special_chars"] == 2  # é is a letter


def test_duplicate_count_with_nulls_and_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL, map('a', 1, 'b', 2)), (1, NULL, map('b', 2, 'a', 1)), (2, 'x', map()) AS t(a, b, m)")
    assert tuple(profile.duplicate_count(df).first()) == (3, 2, 1)


def test_normality_against_published_values(spark):
    # Values that the literature gives for these two samples: z of the skewness, z of the kurtosis.
    def parts(values):
        n, mean = len(values), sum(values) / len(values)
        m = {k: sum((v - mean) ** k for v in values) / n for k in (2, 3, 4)}
        return n, m[3] / m[2] ** 1.5, m[4] / m[2] ** 2 - 3

    def k2(n, g1, g2):
        df = spark.createDataFrame([(n, g1, g2)], "n bigint, s double, k double")
        return distribution.with_normality(df, "n", "s", "k").first()["normality_statistic"]

    n, g1, g2 = parts([2, 8, 0, 4, 1, 9, 9, 0])
    m, h1, h2 = parts(list(range(20)))
    # Skewness 0 leaves the kurtosis part alone, and the skewness part is the rest.
    assert k2(m, 0.0, h2) == pytest.approx(1.705810**2, abs=1e-4)
    assert k2(n, g1, g2) - k2(n, 0.0, g2) == pytest.approx(0.446264**2, abs=1e-4)
    assert h1 == pytest.approx(0, abs=1e-12)


def test_uniformity_distance_brute_force(spark):
    values = [-1.0, 0.0, 0.1, 0.1, 0.1, 0.35, 0.5, 0.99, 1.0, 3.0]
    df = spark.createDataFrame([(v, v / 4 + 0.2) for v in values], "a double, b double")

    def distance(data):
        ordered, n, best = sorted(data), len(data), 0.0
        for v in set(ordered):
            f = min(1.0, max(0.0, v))
            best = max(best, sum(x <= v for x in ordered) / n - f, f - sum(x < v for x in ordered) / n)
        return best

    found = {r["column"]: r["ks_distance"] for r in distribution.uniformity_distance(df).collect()}
    assert found["a"] == pytest.approx(distance(values))
    assert found["b"] == pytest.approx(distance([v / 4 + 0.2 for v in values]))
    scaled = {r["column"]: r["ks_distance"] for r in distribution.uniformity_distance(df, rescale=True).collect()}
    assert scaled["a"] == pytest.approx(distance([(v + 1) / 4 for v in values]))
    assert scaled["a"] == pytest.approx(scaled["b"])


def test_kolmogorov_p_value(spark):
    df = spark.createDataFrame([(0.05, 100), (0.1358, 100), (0.5, 100)], "d double, n int")
    p = [r[0] for r in df.select(distribution.kolmogorov_p_value(F.col("d"), F.col("n"))).collect()]
    assert p[0] > 0.9 and p[1] == pytest.approx(0.05, abs=0.001) and p[2] < 1e-10


def test_histogram_covers_all_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 9.9, 10, 10)] + [(None,)], "x double")
    bins = distribution.histogram(df, "x", 10).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 3]
    flat = distribution.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 3)
    assert sum(r["n"] for r in flat.collect()) == 2


def test_correlations_are_pairwise_complete(spark):
    data = [(1.0, 2.0, None), (2.0, 4.1, 5.0), (3.0, None, 1.0), (4.0, 8.3, 9.0), (5.0, 9.7, 2.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")

    def pearson(x, y):
        kept = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        mx, my = (sum(v) / len(kept) for v in zip(*kept))
        cov = sum((p - mx) * (q - my) for p, q in kept)
        return cov / math.sqrt(sum((p - mx) ** 2 for p, _ in kept) * sum((q - my) ** 2 for _, q in kept))

    columns = list(zip(*data))
    for r in correlations(df).collect():
        assert r["r"] == pytest.approx(pearson(columns[r["i"]], columns[r["j"]]))
    matrix = {r["column"]: r for r in correlation_matrix(df).collect()}
    assert matrix["a"]["a"] == 1.0 and matrix["a"]["b"] == matrix["b"]["a"]
    strong = strong_pairs(df).orderBy("i", "j").collect()
    assert [(r["column_a"], r["column_b"]) for r in strong] == [("a", "b")]
    assert "positively correlated variables: 'a' and 'b'" in strong[0]["message"]
    assert summarize_strong_pairs(strong_pairs(df)).first()[0].startswith("Strong correlations: a and b (positive, r=0.9")
    assert summarize_strong_pairs(strong_pairs(df, 1.1)).first()[0] == "No strong correlations found"


def test_many_columns_split_into_passes(spark):
    df = spark.range(0, 40).select(*[((F.col("id") * (i + 1)) % 17).alias(f"c{i}") for i in range(14)])
    pairs = correlations(df).collect()
    assert len(pairs) == 91 and all(-1 <= p["r"] <= 1 for p in pairs)


def test_trend_keeps_positions_of_missing_numbers(spark):
    df = spark.sql("SELECT id, CASE WHEN id % 9 <> 0 THEN timestamp_ntz'2024-01-01' + make_dt_interval(id) END AS d, CASE WHEN id % 4 <> 0 THEN id * 2.0D END AS y FROM range(100)")
    found = one(trends(df, ["id"]), "y")
    assert found["n"] == 75 and found["strength"] == "Strong" and found["direction"] == "increasing"


def test_anomaly_rules(spark):
    df = spark.range(0, 100).select(
        F.when(F.col("id") < 90, F.col("id") % 3).otherwise(F.col("id") * 100).cast("double").alias("wild"),
        F.lit(1).alias("one"),
        F.when(F.col("id") == 7, 1e9).otherwise(F.col("id").cast("double")).alias("skewed"),
        F.repeat(F.lit("x"), F.col("id").cast("int")).alias("lengths"),
        F.lit("Mixed Case").alias("mixed"),
    )
    found = {(r["column"], r["rule"]) for r in anomalies(df).collect()}
    assert ("wild", "many_outliers") in found and ("one", "single_value") in found and ("skewed", "extreme_skew") in found
    assert ("lengths", "varied_lengths") in found and ("mixed", "mixed_case") in found


def test_quality_of_blank_and_infinite_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("  ", float("inf")), (None, None), ("b", 2.0)], "s string, x double")
    by_column = {r["column"]: r["validity"] for r in quality.column_quality(df).collect()}
    assert by_column == {"s": 0.5, "x": 0.5}
    overall = quality.quality_assessment(df).where("metric = 'overall_score'").first()
    assert overall["grade"] in ("A (Excellent)", "B (Good)", "C (Fair)", "D (Poor)", "F (Very Poor)")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(0, 100).select("id", F.col("id").cast("string").alias("s"))
    same = df.repartition(5).orderBy(F.desc("id"))
    changed = df.withColumn("s", F.when(F.col("id") == 50, "x").otherwise(F.col("s")))
    mark = overview.fingerprint(df).first()[0]
    assert mark == overview.fingerprint(same).first()[0] != overview.fingerprint(changed).first()[0]
    assert overview.portable_fingerprint(df).first() == overview.portable_fingerprint(same).first()
    twice = df.unionAll(df)
    assert overview.fingerprint(twice).first()[0] != overview.fingerprint(twice.unionAll(df)).first()[0]


def test_memory_and_summary(spark):
    df = spark.createDataFrame([(1, "é", True), (2, None, False)], "n int, s string, b boolean")
    found = {r["column"]: r["bytes"] for r in overview.memory_usage(df).collect()}
    assert found == {"n": 8, "s": 2, "b": 2}
    summary = overview.profile_summary(df).first()
    assert (summary["total_missing"], summary["complete_rows"], summary["boolean_columns"]) == (1, 1, 1)
    sheet = {r["key"]: r["value"] for r in overview.summary_sheet(df, "t", "2024-01-01").collect()}
    assert sheet["Memory Usage"] == "12.0 B" and sheet["Processing Date"] == "2024-01-01"


def test_modes_of_long_texts(spark):
    long_a, long_b = "a" * 500, "b" * 500
    df = spark.createDataFrame(
        [(long_b, "x", long_b), (long_b, "x", long_a), (long_a, long_a, "c"), (long_a, "y", "d"), ("z", None, None)],
        "tie string, short string, unique string",
    )
    found = {r["column"]: (r["most_frequent"], r["most_frequent_count"]) for r in profile.text_modes(df).collect()}
    assert found == {"tie": (long_a, 2), "short": ("x", 2), "unique": (long_a, 1)}
    assert {r["column"]: r["distinct"] for r in profile.column_counts(df).collect()} == {"tie": 3, "short": 3, "unique": 4}


def test_approximate_mode(spark):
    df = spark.range(0, 5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("string").alias("s"))
    found = one(profile.numeric_profile(df, exact=False), "x")
    assert found["mean"] == 2499.5 and found["median"] == pytest.approx(2499.5, abs=2)
    assert {r["metric"] for r in quality.quality_assessment(df, exact=False).collect()} >= {"overall_score"}


def test_detected_types(spark):
    from tablewright.operators.typing import detect_types

    df = spark.createDataFrame([(1.0, 1.0, "1"), (2.0, None, "2"), (3.0, 2.0, "2")], "a double, b double, s string")
    found = {r["column"]: (r["suggested_type"], r["samples"]) for r in detect_types(df, samples=2).collect()}
    assert found == {"a": ("integer", ["1.0", "2.0"]), "b": (None, ["1.0", "2.0"]), "s": ("integer", ["1", "2"])}


def test_dates_do_not_depend_on_the_session_zone(spark):
    # 02:30 on this day does not exist in New York; the range crosses the change of the clocks.
    df = spark.sql(
        """SELECT * FROM VALUES (timestamp_ntz'2024-03-10 02:30:00.25', date'2024-03-09'), (timestamp_ntz'2024-03-10 03:30:00.25',
        date'2024-07-01'), (timestamp_ntz'1969-12-31 23:59:59.5', NULL) AS t(at, day)"""
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {r["column"]: r for r in profile.datetime_profile(df).collect()}
        distinct = {r["column"]: r["distinct"] for r in profile.column_counts(df).collect()}
        samples = {r["column"]: r["samples"] for r in profile.sample_values(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert distinct == {"at": 3, "day": 2}
    assert found["day"]["date_range_days"] == 114 and str(found["at"]["min_date"]) == "1969-12-31 23:59:59.500000"
    assert samples["at"] == ["1969-12-31 23:59:59.5", "2024-03-10 02:30:00.25", "2024-03-10 03:30:00.25"]

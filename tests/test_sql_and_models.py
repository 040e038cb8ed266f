import datetime
import decimal
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.functions import formats
from tablewright.operators import modeling
from tablewright.operators.adhoc import QuerySpec, checked_expression, needs_query, run_sql, with_expression
from tablewright.operators.clustering import STILL, _rounds, _scaled, _scaling, choose_k, clusters, fit_clusters, silhouettes
from tablewright.operators.deal import _numbered, dealt, pieces_of
from tablewright.operators.ddl import SqlScript, column_mapping
from tablewright.operators.forest import grown_forests, predictions
from tablewright.operators.modeling import predictive_models
from tablewright.operators.starts import Draws, parallel_starts
from tablewright.plans.analysis import AnalysisPlan


def shown(spark, build, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_format_bytes(spark):
    given = [0, 1, 100, 1023, 1024, 1536, 1152, 1048576, 5 * 1024**4, 3 * 1024**5, -1]
    wanted = ["0 B", "1.0 B", "100.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.12 KB", "1.0 MB", "5.0 TB", "3072.0 TB", "Unknown size"]
    assert shown(spark, formats.format_bytes, given, "bigint") == wanted


def test_format_number(spark):
    given = [None, 0.0, 1234567.0, 1234.567, -5.25, 0.125, 0.0625, 0.00123, float("nan"), 999.999, -1234.5]
    wanted = ["N/A", "0", "1,234,567", "1,234.57", "-5.25", "0.125", "0.062", "1.23e-03", "N/A", "1000.00", "-1,234.50"]
    assert shown(spark, formats.format_number, given, "double") == wanted


def test_float_text_equals_python(spark):
    given = [0.0, 1.5, 1e7, 25345544.0, 123456789.125, 1e15, 1e16, 1.5e17, 0.001, 0.0001, 1e-5, 2.5e-7, -3.25e8, 1 / 3, 1e-4 / 3]
    assert shown(spark, formats.float_text, given, "double") == [str(v) for v in given]


def test_sql_literals(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "it's", True, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), decimal.Decimal("1.50"), [1]),
         (None,) * 8],
        "i int, d double, s string, b boolean, dt date, ts timestamp_ntz, n decimal(5,2), l array<int>",
    )
    cells = [tuple(r) for r in df.select(*[formats.sql_literal(F.col(f.name), f.dataType) for f in df.schema.fields]).collect()]
    assert cells[0] == ("1", "2.0", "'it''s'", "TRUE", "'2024-01-02'", "'2024-01-02T03:04:05'", "1.50", "'[1]'")
    assert cells[1] == ("NULL",) * 8


def test_column_mapping_rules(spark):
    df = spark.sql(
        """SELECT id AS `Order`, id * 100000 AS big, -id AS neg, 'abc' AS code, concat('user', id, '@x.org') AS mail,
        repeat('x', cast(60 + id AS int)) AS medium, repeat('y', 1200) AS large, CASE WHEN id % 2 = 0 THEN 1.5D END AS gap,
        id % 4 = 0 AS flag FROM range(200)"""
    )
    found = {r["column"]: r for r in column_mapping(df).collect()}
    types = {c: r["sql_type"] for c, r in found.items()}
    assert types == {
        "Order": "SMALLINT", "big": "INTEGER", "neg": "SMALLINT", "code": "CHAR(3)", "mail": "VARCHAR(15)", "medium": "VARCHAR(310)",
        "large": "TEXT", "gap": "DOUBLE PRECISION", "flag": "BOOLEAN",
    }
    assert found["Order"]["is_unique"] and not found["Order"]["nullable"] and found["Order"]["sql_name"].startswith("column_")
    assert found["gap"]["comment"] == "50.0% null; constant value" and found["Order"]["comment"] == "unique values"
    assert found["mail"]["checks"].startswith("CHECK (mail ~* '^[A-Za-z0-9") and found["neg"]["checks"] == ""
    assert found["code"]["comment"] == "constant value" and found["code"]["sample_values"] == "abc"


def test_script_parts(spark):
    df = spark.sql("SELECT id AS key_no, id % 40 AS grp, CASE WHEN id <> 3 THEN 'x' END AS s FROM range(101)")
    script = SqlScript(df, "T 1", ["key_no"], with_checks=True)
    assert script.create_lines()[:3] == ["CREATE TABLE t_1 (", "    key_no SMALLINT NOT NULL UNIQUE CHECK (key_no >= 0),", "    grp SMALLINT NOT NULL CHECK (grp >= 0),"]
    assert script.primary_keys() == ["key_no"]
    assert script.index_lines() == [
        "CREATE UNIQUE INDEX idx_t_1_key_no ON t_1 (key_no);", "CREATE INDEX idx_t_1_grp ON t_1 (grp);",
    ]
    statements = {r["seq"]: r["statement"] for r in script.insert_statements().collect()}
    assert len(statements) == 2 and statements[0].count("\n    (") == 100
    assert statements[1] == "INSERT INTO t_1 (key_no, grp, s) VALUES (100, 20, 'x');"
    assert "(3, 3, NULL)" in statements[0]
    assert script.insert_statements(batch=1, limit=5).count() == 5
    with pytest.raises(ValueError):
        SqlScript(df, "t").insert_statements()


def test_restricted_expressions(spark):
    df = spark.createDataFrame([(3, "it's"), (-4, "x(y)")], "n int, s string")
    out = with_expression(df, "m", "abs(n) + length(s)")
    assert [r["m"] for r in out.collect()] == [7, 8]
    assert with_expression(df, "m", "case when s = 'f(x); --' then 1 else 0 end").count() == 2
    for bad in ("reflect('java.lang.System', 'exit')", "(select 1)", "1; drop table t", "java_method('a')", "n -- x", "`reflect`('java.lang.System','getProperty','user.home')",
                "current_user", "`current_user`()", "a.reflect('x')", "n /* x */", "x -> 1", "date '2024-01-01' :: int"):
        with pytest.raises(ValueError):
            checked_expression(bad)
    with pytest.raises(ValueError):
        QuerySpec(where="`reflect`('java.lang.System','getProperty','user.home') = 'x'").run(df)
    with pytest.raises(ValueError):
        with_expression(df, "m", "unknown_name + 1")
    assert with_expression(df, "m", "cast(n as double) * -1.5 + CASE WHEN `s` LIKE '%y)' THEN 1 ELSE 0 END").count() == 2


def test_query_spec(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), ("c", None)], "k string, v int")
    spec = QuerySpec(where="k <> 'c'", group_by=["k"], aggs={"n": ("count", "*"), "top": ("max", "v")}, order_by=["-top"], limit=1)
    assert [tuple(r) for r in spec.run(df).collect()] == [("a", 2, 5)]
    assert QuerySpec(select=["k"], order_by=["-v", "k"], limit=2).run(df.select("k", "v")).columns == ["k"]
    assert sorted(r[0] for r in QuerySpec(group_by=["k"]).run(df).collect()) == ["a", "b", "c"]
    assert run_sql(df, "SELECT count(*) AS n FROM {t} WHERE v > :low", low=2).first()["n"] == 2
    with pytest.raises(ValueError):
        QuerySpec(aggs={"x": ("collect_list", "v")}).run(df)
    with pytest.raises(ValueError):
        QuerySpec(select=["zzz"]).run(df)


def test_question_routing(spark):
    asked = ["Show me all", "Why is that?", "Which one is HIGHEST", "explain"]
    assert shown(spark, needs_query, asked, "string") == [True, False, True, False]


def test_forest_finds_the_planted_signal(spark):
    df = spark.range(0, 600).select(
        (F.rand(1) * 10).alias("noise"), (F.rand(2) * 10).alias("signal")
    ).withColumn("target", F.when(F.rand(4) < 0.02, None).otherwise(F.col("signal") * 3 + F.rand(3)))
    found = predictive_models(df, targets=["target"], trees=20).collect()
    best = max(found, key=lambda r: r["importance"])
    assert best["feature"] == "signal" and best["r2_score"] > 0.7
    assert sum(r["importance"] for r in found) == pytest.approx(1)
    assert found[0]["train_rows"] + found[0]["test_rows"] == 600


def test_forests_are_those_of_mllib(spark):
    """All targets grow in the same passes; trees and importances are MLlib's."""
    df = spark.range(23_000).selectExpr("id % 1009 * 1.5 AS a", "id * id % 977 AS b", "IF(id % 3 = 0, id % 7, 0) AS c", "4 AS d", "id % 1009 + id * id % 977 AS e")
    names = [f"x{i}" for i in range(5)]
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(df.columns, names)])
    rows = rows.repartition(3, *names).sortWithinPartitions(*names).persist()
    forests, thresholds = grown_forests(rows, 23_000, [0, 2, 4], 6, 4, 42)
    told = predictions(rows, forests, thresholds)
    for i, target in enumerate((0, 2, 4)):
        inputs = [n for n in names if n != names[target]]
        vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
        model = RandomForestRegressor(labelCol=names[target], numTrees=6, maxDepth=4, seed=42).fit(vectors)
        assert np.abs(model.featureImportances.toArray() - forests[i].importances()).max() < 1e-9
        wanted = model.transform(vectors).agg(F.sum("prediction"), F.sum(F.col("prediction") * F.col(names[target]))).first()
        got = told.agg(F.sum(f"prediction{i}"), F.sum(F.col(f"prediction{i}") * F.col(f"label{i}"))).first()
        assert tuple(got) == pytest.approx(tuple(wanted), rel=1e-9)
    rows.unpersist()


def test_targets_share_their_passes(spark):
    df = spark.range(400).selectExpr("id % 97 a", "id % 89 b", "id % 83 c")
    spark.sparkContext.setJobGroup("forests", "fit")
    try:
        assert len({r["target"] for r in predictive_models(df).collect()}) == 3
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests")) < 30
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_clusters_find_the_planted_blobs(spark):
    df = spark.range(0, 300).select(
        ((F.col("id") % 3) * 100 + F.rand(1)).alias("x"), ((F.col("id") % 3) * (F.col("id") % 3) * 50 + F.rand(2)).alias("y")
    )
    found = clusters(df, max_k=5).collect()
    assert found[0]["k"] == 3 and found[0]["silhouette"] > 0.9
    assert sorted({r["cluster"]: r["size"] for r in found}.values()) == [100, 100, 100]


def test_starts_are_those_of_mllib(spark):
    java = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(77)
    draws = Draws(77)
    assert [java.nextDouble() for _ in range(50)] == [*draws.take(20), *draws.take(30)]
    for rows, pieces, kinds in ((40_000, None, 1_000_003), (3_000, 7, 1_000_003), (3_000, 3, 5)):
        df = spark.range(rows).selectExpr(f"double(id * id % {kinds} % 9973) a", f"double(id % {kinds} % 101) b", f"id % {kinds} % 13 c")
        values, scaler = _scaling(df, df.columns)
        if pieces:
            values = values.repartition(pieces, "x0", "x1", "x2").sortWithinPartitions("x0", "x1", "x2").persist()
        found = parallel_starts(values, _scaled(scaler), (2, 6), 42, 2)
        for k, centres in found.items():
            wanted = np.array(KMeans(k=k, seed=42, maxIter=0).fit(scaler.transform(values)).clusterCenters())
            assert centres.shape == wanted.shape and np.abs(centres - wanted).max() < 1e-9
        values.unpersist()


def test_starts_share_their_passes(spark):
    df = spark.range(400).selectExpr("id % 97 a", "id % 89 b")
    spark.sparkContext.setJobGroup("starts", "fit")
    try:
        fit_clusters(df).release()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts")) < 70
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_choice_of_k():
    costs = [100.0, 20.0, 15.0, 12.0, 11.5]
    assert choose_k(costs) == 3
    assert choose_k(costs, "flattest") == 5
    with pytest.raises(ValueError):
        choose_k(costs, "other")


def test_analysis_plan(spark):
    df = spark.sql(
        """SELECT id, id * 2.0D AS twice, CASE WHEN id % 5 <> 0 THEN pmod(hash(id), 100) END AS gap, concat('Row ', id) AS name,
        timestamp_ntz'2024-01-01' + make_dt_interval(id) AS at FROM range(200)"""
    )
    plan = AnalysisPlan(df, tie_break=["id"])
    found = {r["rule"]: r["message"] for r in plan.insights().collect()}
    assert "small" in found and found["correlated"].startswith("Columns that move together: id and twice (positive, r=1.000)")
    assert found["some_missing"] == "Few gaps: 4.0% of all cells are empty"
    assert found["model"].startswith("Column id can be predicted, R2 ")
    assert found["features"].startswith("It depends most on twice")
    assert "segments" in found and "quantitative" in found
    lines = {r["rule"]: r["message"] for r in plan.summary().collect()}
    assert lines["profiled"] and lines["trends"].startswith("Trends: 2 ")
    assert set(plan.sections) >= {"summary", "numeric", "text", "datetime", "trends", "models", "clusters", "quality"}


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() == 6


def test_forest_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 9)), rng.random(), float(i % 3)) for i in range(600)] + [(1.0, 0.5, 2.0)] * 300
    rows = [(a, b, c, 3 * a + b) for a, b, c in rows]
    found = []
    for pieces in (1, 4, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(pieces)
        found.append([tuple(r) for r in predictive_models(df, targets=["y"]).orderBy("feature").collect()])
    for other in found[1:]:
        for one, two in zip(found[0], other):
            assert one[:2] == two[:2] and one[2:5] == pytest.approx(two[2:5], rel=1e-9) and one[5:] == two[5:]


def test_only_columns_with_gaps_are_searched_for_medians(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, 1.0, 5.0, None), (2, None, 1.0, None), (3, 4.0, nan, None), (4, 9.0, 2.0, None)]
    df = spark.createDataFrame(rows, "whole int, nulls double, nans double, bare bigint")
    real, asked = modeling.quantiles, []
    monkeypatch.setattr(modeling, "quantiles", lambda df, names, *more: asked.append(list(names)) or real(df, names, *more))
    filled, n = modeling._filled(df, df.columns, True)
    assert asked == [["nulls", "nans", "bare"]] and n == 4
    assert sorted(map(tuple, filled.collect())) == [(1, 1, 5, 0), (2, 4, 1, 0), (3, 4, 2, 0), (4, 9, 2, 0)]
    filled, n = modeling._filled(df, ["whole"], True)
    assert len(asked) == 1 and n == 4 and sorted(r.x0 for r in filled.collect()) == [1, 2, 3, 4]
    empty, n = modeling._filled(df.limit(0), df.columns, True)
    assert len(asked) == 1 and n == 0 and empty.columns == ["x0", "x1", "x2", "x3"] and empty.count() == 0


def test_dealt_rows_follow_from_content(spark):
    rows = [(i % 7, "x") for i in range(500)] + [(3, None)] * 400
    shares = []
    for pieces in (1, 5):
        df = spark.createDataFrame(rows, "a int, s string").repartition(pieces)
        told = dealt(df, 70_000).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
        shares.append(sorted((r.i, r.a, r.s or "") for r in told.collect()))
    assert shares[0] == shares[1] and len(shares[0]) == 900
    parts = Counter(i >> 33 for i, a, s in shares[0] if s == "")
    assert len(parts) == 4 and max(parts.values()) < 200
    assert [pieces_of(n) for n in (0, 1 << 14, 1 << 20, 1 << 40)] == [1, 1, 64, 1 << 20]


def test_copies_of_few_rows_are_made_in_many_tasks(spark):
    df = spark.range(150_000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") >= 0, None).cast("string").alias("s"))
    df = df.unionAll(spark.sql("SELECT 5L, 'x' UNION ALL SELECT 5L, 'x' UNION ALL SELECT 6L, 'y'"))
    made = _numbered(df, 150_003).withColumn("p", F.spark_partition_id())
    by_row = {r["a"]: r[1:] for r in made.groupBy("a").agg(F.count("*"), F.countDistinct("__i"), F.max("__i")).collect()}
    assert by_row == {0: (75_000,) * 3, 1: (75_000,) * 3, 5: (2,) * 3, 6: (1,) * 3}
    assert made.groupBy("p").count().agg(F.max("count")).first()[0] < 60_000


def test_rounds_are_those_of_mllib_and_end(spark):
    # Four groups of rows whose sums differ in their last bits with the order of the tasks.
    df = spark.range(40_000).repartition(40).selectExpr("1000 * (id % 4) + (id % 11) / 100D AS a", "700 * (id % 4) + 0.01 * (id % 3) AS b")
    fit = fit_clusters(df, max_k=6)
    assert fit.k == 4 and sorted(r["count"] for r in fit.assignments().groupBy("cluster").count().collect()) == [10_000] * 4
    fit.release()
    values, scaler = _scaling(df, ["a", "b"])
    vectors = scaler.transform(values)
    starts = {k: np.array(KMeans(k=k, seed=42, maxIter=0).fit(vectors).clusterCenters()) for k in (2, 4, 5)}
    for k, (centres, cost, _) in _rounds(values, scaler, starts, 20, 1e-4).items():
        theirs = KMeans(k=k, seed=42).fit(vectors)
        assert np.allclose(centres, theirs.clusterCenters()) and abs(cost - theirs.summary.trainingCost) < 1e-6 * (1 + cost)
    assert all(still for _, _, still in _rounds(values, scaler, starts, 60, STILL).values())
    values.unpersist()


def test_clustering_is_a_fixpoint(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(c * 9, 1), rng.gauss(-c * 5, 1)) for c in range(3) for _ in range(200)], "a double, b double")
    fit = fit_clusters(df)
    assert fit.k == 3
    rows = [(r.a, r.b, r.cluster) for r in fit.assignments().collect()]
    means = [statistics.mean(x) for x in zip(*rows)][:2]
    spreads = [statistics.stdev(x) for x in zip(*[r[:2] for r in rows])]
    points = [((r[0] - means[0]) / spreads[0], (r[1] - means[1]) / spreads[1], r[2]) for r in rows]
    for c, centre in enumerate(fit.centres):
        own = [p for p in points if p[2] == c]
        assert [statistics.mean(p[i] for p in own) for i in (0, 1)] == pytest.approx(centre, abs=1e-9)
    far = [[(p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 for c in fit.centres] for p in points]
    assert all(d[p[2]] <= min(d) + 1e-12 for d, p in zip(far, points))
    assert sum(d[p[2]] for d, p in zip(far, points)) == pytest.approx(fit.cost)
    assert {(r.cluster, r.column) for r in fit.centre_table().collect()} == {(c, n) for c in range(3) for n in ("a", "b")}
    fit.release()


def test_silhouettes_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(i % 3, 1), rng.gauss(0, 1), "abc"[i % 3]) for i in range(60)] + [(60, 9.0, 9.0, "alone"), (61, 1.0, None, None)]
    got = {r.i: r.silhouette for r in silhouettes(spark.createDataFrame(rows, "i int, x double, y double, g string"), ["x", "y"], "g").collect()}
    square = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    for p in rows[:60]:
        near = {g: statistics.mean(square(p, q) for q in rows[:61] if q[3] == g and q[0] != p[0]) for g in ("a", "b", "c", "alone")}
        a, b = near[p[3]], min(v for g, v in near.items() if g != p[3])
        assert got[p[0]] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    assert got[60] == 0.0 and got[61] is None
    one = spark.createDataFrame([(1.0, "g"), (2.0, "g")], "x double, g string")
    assert [r.silhouette for r in silhouettes(one, ["x"], "g").collect()] == [0.0, 0.0]

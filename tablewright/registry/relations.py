"""Correlations, trends, models, clusters, insights."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.operators import correlation, insights
from tablewright.operators.anomalies import anomalies
from tablewright.operators.clustering import clusters, fit_clusters, silhouettes
from tablewright.operators.modeling import predictive_models
from tablewright.operators.quality import quality_assessment
from tablewright.operators.trend import trends
from tablewright.plans.analysis import AnalysisPlan
from tablewright.registry.base import query, rounded, table
from tablewright.registry.profiling import (
    LINE_NUMBERS,
    ORDER_NUMBERS,
    ORDER_TEXTS,
    ORDERS,
    _ORDER_KINDS,
    _anomaly_sql,
    _quality_sql,
)


def _r(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) + 0.0::DOUBLE END"


def _pairs_sql(t: str, names) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count({a} + {b}) AS n, {_r(a, b)} AS r FROM {t}"""
        for a, b in combinations(names, 2)
    )


@query(_pairs_sql("lineitem", LINE_NUMBERS))
def correlations_lineitem(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "lineitem")).drop("i", "j"))


@query(_pairs_sql("orders_dirty", ORDER_NUMBERS))
def correlations_orders(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "orders_dirty")).drop("i", "j"))


@query(_pairs_sql("consts", ["l_orderkey", "l_linenumber", "l_quantity", "konst", "empty"]))
def correlations_with_constants(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "consts")).drop("i", "j"))


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{a}' AS "column", """
        + ", ".join(("1.0::DOUBLE" if a == b else _r(a, b)) + f" AS {b}" for b in LINE_NUMBERS)
        + " FROM lineitem"
        for a in LINE_NUMBERS
    )
)
def correlation_matrix_lineitem(spark, sf_dir):
    return rounded(correlation.correlation_matrix(table(spark, sf_dir, "lineitem")))


def _strong_sql(t: str, names) -> str:
    return f"""SELECT column_a, column_b, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
    'Strong ' || CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END || ' correlated variables: ''' || column_a
    || ''' and ''' || column_b || ''' (r=' || printf('%.3f', r) || ')' AS message
    FROM ({_pairs_sql(t, names)}) WHERE abs(r) > 0.7"""


@query(_strong_sql("lineitem", LINE_NUMBERS))
def strong_pairs_lineitem(spark, sf_dir):
    return rounded(correlation.strong_pairs(table(spark, sf_dir, "lineitem")).drop("i", "j"))


@query(
    f"""WITH s AS (SELECT row_number() OVER () AS place, * FROM ({_pairs_sql("lineitem", LINE_NUMBERS)})),
    p AS (SELECT place, column_a || ' and ' || column_b || ' (' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ', r='
      || printf('%.3f', r) || ')' AS piece FROM s WHERE abs(r) > 0.7 ORDER BY place LIMIT 3)
    SELECT coalesce('Strong correlations: ' || string_agg(piece, '; ' ORDER BY place), 'No strong correlations found') AS summary FROM p"""
)
def correlation_summary_lineitem(spark, sf_dir):
    return correlation.summarize_strong_pairs(correlation.strong_pairs(table(spark, sf_dir, "lineitem")))


def _trend_sql(t: str, date: str, ties, names) -> str:
    order = ", ".join([f"{date} NULLS LAST", *ties])
    rows = f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS x, {', '.join(names)} FROM {t}"
    one = "\nUNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n, {_r('x', c)} AS r FROM s" for c in names)
    return f"""WITH s AS ({rows}), k AS ({one}), d AS (SELECT *, CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' END
      AS strength, CASE WHEN r > 0 THEN 'increasing' ELSE 'decreasing' END AS way FROM k)
    SELECT c AS "column", n, r AS correlation, strength, CASE WHEN strength IS NOT NULL THEN way END AS direction,
    strength || ' ' || way || ' trend in ''' || c || ''' over time (correlation: ' || printf('%.3f', r) || ')' AS message FROM d"""


@query(_trend_sql("events", "ts", ["event_id"], ["event_id", "user_id", "value"]))
def trends_events(spark, sf_dir):
    return rounded(trends(table(spark, sf_dir, "events"), ["event_id"]).drop("cid"))


@query(_trend_sql("orders_dirty", "o_orderdate", ["o_orderkey"], ORDER_NUMBERS))
def trends_orders(spark, sf_dir):
    return rounded(trends(table(spark, sf_dir, "orders_dirty"), ["o_orderkey"]).drop("cid"))


@query(_trend_sql("lineitem", "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], LINE_NUMBERS))
def trends_lineitem(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return rounded(trends(table(spark, sf_dir, "lineitem"), keys).drop("cid"))


@query()
def forest_models_orders(spark, sf_dir):
    return rounded(predictive_models(table(spark, sf_dir, "orders_dirty")), 4)


@query()
def forest_model_extended_price(spark, sf_dir):
    return rounded(predictive_models(table(spark, sf_dir, "lineitem"), targets=["l_extendedprice"]), 4)


@query()
def clusters_customer(spark, sf_dir):
    return rounded(clusters(table(spark, sf_dir, "customer")), 4)


@query()
def clusters_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    wide = vectors.select(*[F.try_element_at("embedding", F.lit(i + 1)).cast("double").alias(f"e{i}") for i in range(width)])
    return rounded(clusters(wide), 4)


@query("SELECT 3 * count(*) AS cells, 3 AS columns, true AS k_in_range, true AS numbered, true AS means_agree FROM customer")
def cluster_facts_customer(spark, sf_dir):
    """What must hold of any clustering: every row is in one group, and the groups' means make the mean of all."""
    df = table(spark, sf_dir, "customer")
    found = clusters(df)
    overall = df.agg(*[F.avg(c).alias(c) for c in ("c_custkey", "c_nationkey", "c_acctbal")])
    stacked = overall.unpivot([], ["c_custkey", "c_nationkey", "c_acctbal"], "column", "mean")
    by_column = found.groupBy("column").agg(
        F.sum("size").alias("n"), (F.sum(F.col("size") * F.col("mean_value")) / F.sum("size")).alias("weighted"),
        (F.max("cluster") + 1 == F.max("k")).alias("numbered"), F.max("k").between(2, 10).alias("in_range"),
    )
    return by_column.join(stacked, "column").agg(
        F.sum("n").alias("cells"), F.count("*").cast("int").alias("columns"), F.bool_and("in_range").alias("k_in_range"),
        F.bool_and("numbered").alias("numbered"), F.bool_and(F.abs(F.col("weighted") - F.col("mean")) < 1e-6 * (1 + F.abs("mean"))).alias("means_agree"),
    )


@query("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS target, count(*) AS rows, 7::BIGINT AS features, true AS importances_add_up, true AS split_fair FROM lineitem")
def forest_facts_lineitem(spark, sf_dir):
    """What must hold of any forest: all rows train or test, and the importances of a target add up to one."""
    found = predictive_models(table(spark, sf_dir, "lineitem"))
    return found.groupBy("target").agg(
        F.max(F.col("train_rows") + F.col("test_rows")).alias("rows"), F.count("*").alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("importances_add_up"),
        F.bool_and((F.col("train_rows") / (F.col("train_rows") + F.col("test_rows"))).between(0.65, 0.75)).alias("split_fair"),
    )


_MISSING = " + ".join(f"count(*) - count({c})" for c in ORDERS)


@query(
    _quality_sql("orders_dirty", _ORDER_KINDS).rstrip()
    + f""", w AS (SELECT 0.3 * a + 0.2 * b + 0.25 * s + 0.25 * v AS total FROM o),
    m AS (SELECT count(*) AS n, 100.0 * ({_MISSING}) / (6 * count(*)) AS pct FROM orders_dirty),
    x AS (SELECT 'large' AS rule, 'The table is large: ' || format('{{:,}}', n) || ' rows are enough for tests and models' AS message, n > 100000 AS ok FROM m
    UNION ALL SELECT 'small', 'The table is small: with ' || format('{{:,}}', n) || ' rows, read statistics with care', n < 1000 FROM m
    UNION ALL SELECT 'quality', 'Quality grade ' || CASE WHEN total >= 0.9 THEN 'A (Excellent)' WHEN total >= 0.8 THEN 'B (Good)'
      WHEN total >= 0.7 THEN 'C (Fair)' WHEN total >= 0.6 THEN 'D (Poor)' ELSE 'F (Very Poor)' END || ', score ' || printf('%.2f', total), true FROM w
    UNION ALL SELECT 'low_quality', 'Quality is low: clean the table before using it', total < 0.7 FROM w
    UNION ALL SELECT 'much_missing', 'Many gaps: ' || printf('%.1f', pct) || '% of all cells are empty', pct > 10 FROM m
    UNION ALL SELECT 'some_missing', 'Few gaps: ' || printf('%.1f', pct) || '% of all cells are empty', pct > 0 AND pct <= 10 FROM m
    UNION ALL SELECT 'none_missing', 'No cell is empty', pct = 0 FROM m
    UNION ALL SELECT 'quantitative', 'Most of it is numbers: measure and forecast', true
    UNION ALL SELECT 'anomalies', 'Findings to look at: ' || k, k > 0 FROM (SELECT count(*) AS k FROM (
      {_anomaly_sql("orders_dirty", ORDER_NUMBERS, ORDER_TEXTS)})))
    SELECT rule, message FROM x WHERE ok"""
)
def business_insights_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    metrics = insights.metrics_row(df, quality=quality_assessment(df), anomalies=anomalies(df))
    return insights.business_insights(metrics).drop("position")


@query(
    f"""WITH m AS (SELECT count(*) AS n, 100.0 * ({_MISSING}) / (6 * count(*)) AS pct,
      (32 * count(*) + coalesce(sum(strlen(o_orderstatus)), 0) + sum(strlen(o_orderpriority))) / 1048576.0 AS mb FROM orders_dirty)
    SELECT 'size' AS rule, format('{{:,}}', n) || ' rows, 6 columns' AS message FROM m
    UNION ALL SELECT 'composition', 'Columns of numbers, text, dates: 3, 2, 1'
    UNION ALL SELECT 'quality', 'Empty cells ' || printf('%.1f', pct) || '%, repeated rows '
      || (n - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty))) FROM m
    UNION ALL SELECT 'applied', 'Steps done: mask_pii'
    UNION ALL SELECT 'bytes', 'Bytes held: ' || printf('%.1f', mb) || ' MB' FROM m"""
)
def dataset_summary_orders(spark, sf_dir):
    return insights.dataset_summary(table(spark, sf_dir, "orders_dirty"), applied=["mask_pii"]).drop("position")


@query()
def analysis_summary_orders(spark, sf_dir):
    return AnalysisPlan(table(spark, sf_dir, "orders_dirty"), tie_break=["o_orderkey"]).summary()


def _grade(score: str) -> str:
    return f"""CASE WHEN {score} >= 0.9 THEN 'A (Excellent)' WHEN {score} >= 0.8 THEN 'B (Good)' WHEN {score} >= 0.7 THEN 'C (Fair)'
      WHEN {score} >= 0.6 THEN 'D (Poor)' ELSE 'F (Very Poor)' END"""


def _insights_sql(t: str, kinds: dict[str, str], more: str = "") -> str:
    """All rules that need no pairs, models or groups; ``more`` adds those."""
    gaps = " + ".join(f"count(*) - count({c})" for c in kinds)
    numbers, texts = ([c for c, k in kinds.items() if k == kind] for kind in "nt")
    return (
        _quality_sql(t, kinds).rstrip()
        + f""", w AS (SELECT 0.3 * a + 0.2 * b + 0.25 * s + 0.25 * v AS total FROM o),
    m AS (SELECT count(*) AS n, 100.0 * ({gaps}) / ({len(kinds)} * count(*)) AS pct FROM {t}),
    x AS (SELECT 'large' AS rule, 'The table is large: ' || format('{{:,}}', n) || ' rows are enough for tests and models' AS message, n > 100000 AS ok FROM m
    UNION ALL SELECT 'small', 'The table is small: with ' || format('{{:,}}', n) || ' rows, read statistics with care', n < 1000 FROM m
    UNION ALL SELECT 'quality', 'Quality grade ' || {_grade("total")} || ', score ' || printf('%.2f', total), true FROM w
    UNION ALL SELECT 'low_quality', 'Quality is low: clean the table before using it', total < 0.7 FROM w
    UNION ALL SELECT 'much_missing', 'Many gaps: ' || printf('%.1f', pct) || '% of all cells are empty', pct > 10 FROM m
    UNION ALL SELECT 'some_missing', 'Few gaps: ' || printf('%.1f', pct) || '% of all cells are empty', pct > 0 AND pct <= 10 FROM m
    UNION ALL SELECT 'none_missing', 'No cell is empty', pct = 0 FROM m
    UNION ALL SELECT 'quantitative', 'Most of it is numbers: measure and forecast', {len(numbers) > len(texts)}
    UNION ALL SELECT 'qualitative', 'Most of it is text: count and classify', {len(numbers) < len(texts)}
    UNION ALL SELECT 'anomalies', 'Findings to look at: ' || k, k > 0 FROM (SELECT count(*) AS k FROM (
      {_anomaly_sql(t, numbers, texts)})){more})
    SELECT rule, message FROM x WHERE ok"""
    )


_PLANTED_PAIR = """'u and v (' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ', r=' || printf('%.3f', r) || ')'"""
_PLANTED_R = "(SELECT corr(u, v) AS r FROM planted)"
_PLANTED_GROUPS = "(SELECT count(*) AS groups, max(n) * 100.0 / sum(n) AS largest FROM (SELECT count(*) AS n FROM planted GROUP BY floor(u / 1000)))"


# What tells the rows of a group apart is less than a millionth of the spread, so a forest leaves nothing unexplained in
# three digits.
@query(
    _insights_sql(
        "planted", {"u": "n", "v": "n"},
        f"""
    UNION ALL SELECT 'correlated', 'Columns that move together: ' || {_PLANTED_PAIR}, abs(r) > 0.7 FROM {_PLANTED_R}
    UNION ALL SELECT 'use_correlated', 'One of two such columns may stand in for the other in a model', abs(r) > 0.7 FROM {_PLANTED_R}
    UNION ALL SELECT 'model', 'Column u can be predicted, R2 1.000', true UNION ALL SELECT 'features', 'It depends most on v', true
    UNION ALL SELECT 'segments', 'Rows fall into ' || groups || ' groups', true FROM {_PLANTED_GROUPS}
    UNION ALL SELECT 'largest_segment', 'The largest group holds ' || printf('%.1f', largest) || '% of the rows', true FROM {_PLANTED_GROUPS}""",
    )
)
def business_insights_planted(spark, sf_dir):
    return AnalysisPlan(table(spark, sf_dir, "planted")).insights().drop("position")


@query(_insights_sql("sparse", {"n_nationkey": "n", "name": "t", "note": "t"}))
def business_insights_sparse(spark, sf_dir):
    df = table(spark, sf_dir, "sparse")
    metrics = insights.metrics_row(df, quality=quality_assessment(df), anomalies=anomalies(df))
    return insights.business_insights(metrics).drop("position")


@query(
    _quality_sql("planted", {"u": "n", "v": "n"}).rstrip()
    + f""", w AS (SELECT 0.3 * a + 0.2 * b + 0.25 * s + 0.25 * v AS total FROM o)
    SELECT 'profiled' AS rule, 'All columns were profiled' AS message
    UNION ALL SELECT 'correlated', 'Moving together: ' || {_PLANTED_PAIR} FROM {_PLANTED_R}
    UNION ALL SELECT 'models', 'Predictable: u, v'
    UNION ALL SELECT 'segments', 'Groups of rows: ' || groups FROM {_PLANTED_GROUPS}
    UNION ALL SELECT 'quality', 'Quality grade ' || {_grade("total")} || ', score ' || printf('%.2f', total) FROM w"""
)
def analysis_summary_planted(spark, sf_dir):
    return AnalysisPlan(table(spark, sf_dir, "planted")).summary().drop("position")


@query(f'SELECT column_a, column_b, r FROM ({_pairs_sql("planted", ["u", "v"])}) WHERE abs(r) > 0.7')
def strong_pairs_planted(spark, sf_dir):
    return rounded(correlation.strong_pairs(table(spark, sf_dir, "planted")).select("column_a", "column_b", "r"))


_CUSTOMER_NUMBERS = ("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT count(*) AS rows, count(*) AS at_nearest, true AS centres_are_means, true AS cost_adds_up, true AS apart FROM customer")
def cluster_fixpoint_customer(spark, sf_dir):
    """The assignments and centres of a fit, checked from the values themselves: a partition that is no fixpoint fails."""
    df = table(spark, sf_dir, "customer")
    fit = fit_clusters(df)
    rows = fit.assignments()  # persisted with the fit until the session ends
    scale = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in _CUSTOMER_NUMBERS]).first()
    z = rows.select("cluster", *[((F.col(c) - scale[c]["mean"]) / scale[c]["sd"]).alias(c) for c in _CUSTOMER_NUMBERS])
    centres = fit.centre_table().groupBy("cluster").pivot("column", list(_CUSTOMER_NUMBERS)).agg(F.first("centre"))
    stacked = F.broadcast(centres.agg(F.collect_list(F.struct("cluster", *_CUSTOMER_NUMBERS)).alias("centres")))  # k entries
    far = F.transform("centres", lambda m: F.struct(sum((F.pow(F.col(c) - m[c], 2.0) for c in _CUSTOMER_NUMBERS), F.lit(0.0)).alias("d"), m["cluster"].alias("c")))
    told = z.crossJoin(stacked).withColumn("far", far).withColumn("own", F.filter("far", lambda f: f["c"] == F.col("cluster"))[0]["d"])
    means = z.groupBy("cluster").agg(*[F.avg(c).alias(f"m_{c}") for c in _CUSTOMER_NUMBERS]).join(centres, "cluster")
    equal = means.agg(F.bool_and(F.greatest(*[F.abs(F.col(c) - F.col(f"m_{c}")) for c in _CUSTOMER_NUMBERS]) < 1e-6).alias("centres_are_means"), F.count("*").alias("k"))
    sums = told.agg(
        F.count("*").alias("rows"), F.count_if(F.col("own") <= F.array_min(F.transform("far", lambda f: f["d"])) + 1e-9).alias("at_nearest"),
        (F.abs(F.sum("own") - fit.cost) < 1e-6 * (1 + fit.cost)).alias("cost_adds_up"),
    )
    return sums.crossJoin(equal).select("rows", "at_nearest", "centres_are_means", "cost_adds_up", (F.col("k") == fit.k).alias("apart"))


# From the size, the sums and the sum of squares of each group.
@query(
    """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS g, c_nationkey::DOUBLE AS x, c_acctbal / 1000 AS y FROM customer),
    m AS (SELECT g, count(*) AS n, sum(x) / count(*) AS mx, sum(y) / count(*) AS my, sum(x * x + y * y) / count(*) AS q FROM p GROUP BY g),
    d AS (SELECT id, p.g, m.g = p.g AS own, n, x * x + y * y - 2 * (x * mx + y * my) + q AS d FROM p, m),
    s AS (SELECT id, g, max(d * n / (n - 1.0)) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM d GROUP BY id, g)
    SELECT g AS segment, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s GROUP BY g"""
)
def silhouette_segments(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y")
    )
    return rounded(silhouettes(points, ["x", "y"], "segment").groupBy("segment").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette")))

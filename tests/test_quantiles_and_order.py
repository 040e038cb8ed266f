import random
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.session import measured_bytes, range_partitions
from tablewright.operators.missing import MissingValueFiller
from tablewright.operators.ordered import OrderedRows
from tablewright.operators.quantiles import centres, exact_quantiles


def linear(values, p):
    ordered = sorted(values)
    at = p * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


@pytest.mark.parametrize("hot", [0.0, 0.34, 0.9])
@pytest.mark.parametrize("budget, accuracy", [(10**6, 2000), (60, 100), (20, 40)])
def test_quantiles_match_brute_force(spark, hot, budget, accuracy):
    rng = random.Random(7)
    values = [5.0 if rng.random() < hot else rng.lognormvariate(1, 2) for _ in range(3001)]
    df = spark.createDataFrame([(v, i % 13, None) for i, v in enumerate(values)], "a double, b int, c double")
    probs = [0, 0.01, 0.25, 0.5, 0.66, 0.75, 0.999, 1]
    found = exact_quantiles(df, ["a", "b", "c"], probs, budget, accuracy)
    assert found["a"] == pytest.approx([linear(values, p) for p in probs], rel=1e-12)
    assert found["b"] == pytest.approx([linear([i % 13 for i in range(3001)], p) for p in probs])
    assert found["c"] == [None] * len(probs)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.just(3.0), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    found = exact_quantiles(df, ["a"], [0.25, 0.5, 0.9], budget=3, accuracy=10)["a"]
    assert found == pytest.approx([linear(values, p) for p in (0.25, 0.5, 0.9)], abs=1e-6)


def test_centres_give_count_and_mean(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (float("nan"),)], "a double")
    centre = centres(df, ["a"], [0.5])["a"]
    assert (centre.count, centre.mean, centre.quantiles) == (2, 2.5, [2.5])


def test_index_is_consecutive_with_hot_keys_and_nulls(spark):
    rng = random.Random(3)
    data = [(i, 1 if rng.random() < 0.4 else rng.randint(0, 50) if rng.random() < 0.9 else None) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, k int").repartition(7)
    found = {r["id"]: r["n"] for r in OrderedRows(df, ["k", "id"]).with_index("n").collect()}
    wanted = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [found[i] for i, _ in wanted] == list(range(2000))


def test_running_sum(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    found = sorted((r["id"], r["s"]) for r in OrderedRows(df, ["id"]).with_running_sum(F.col("v"), "s").collect())
    total, wanted = 0, []
    for i in range(1000):
        total += i % 7
        wanted.append((i, total))
    assert found == wanted


@pytest.mark.parametrize("share", [0.02, 0.5, 0.98])
def test_fill_matches_brute_force(spark, share):
    rng = random.Random(11)
    data = [(i, None if rng.random() < share else i * 10, None if rng.random() < share else bool(i % 2)) for i in range(1500)]
    df = spark.createDataFrame(data, "id int, x int, b boolean").repartition(9)
    filled = {r["id"]: (r["x"], r["b"]) for r in OrderedRows(df, ["id"]).fill(forward=["b"], both=["x"]).collect()}
    first = next(x for _, x, _ in data if x is not None)
    last_x = last_b = None
    for i, x, b in data:
        last_x, last_b = x if x is not None else last_x, b if b is not None else last_b
        assert filled[i] == (last_x if last_x is not None else first, last_b)


def test_order_is_required(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id int, d string").select("id", F.col("d").cast("date").alias("d"))
    with pytest.raises(ValueError, match="order_by"):
        MissingValueFiller().fit(df)
    with pytest.raises(ValueError):
        OrderedRows(df, [])


def test_filler_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, "b", None, None), (2, None, "a", None, None), (3, 4, "a", None, None), (4, None, "b", None, None), (5, 9, None, None, None)],
        "id int, n int, t string, all_null string, empty double",
    )
    model = MissingValueFiller().fit(df)
    filled = model.transform(df)
    assert model.constants == {"id": 3.0, "n": 4.0, "t": "a"}  # ties go to the smallest text
    assert dict(filled.dtypes)["n"] == "double"
    assert [r["t"] for r in filled.orderBy("id").collect()] == ["b", "a", "a", "b", "a"]
    assert filled.where("all_null IS NOT NULL OR empty IS NOT NULL").count() == 0
    assert {r["column"]: (r["missing_before"], r["missing_after"]) for r in model.report(df).collect()}["n"] == (2, 0)


def test_nan_counts_as_missing_and_median_skips_it(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    filled = MissingValueFiller().fit(df).transform(df)
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0]


def test_mean_of_window_free_numbers(spark):
    values = [float(v) for v in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert centres(df, ["x"], [0.5])["x"].mean == statistics.mean(values)


def test_ranges_do_not_follow_the_optimizer(spark):
    """Estimates of joins and of rows that were never written are no basis for the number of ranges."""
    folder = "/root/testdata/sf0.01"
    lineitem, orders, customer = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    totals = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n"))
    given = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(50)], "a long, s string")
    for df, keys in ((joined, ["l_orderkey", "l_linenumber"]), (totals, ["l_orderkey"]), (given, ["a"]), (given.where("false"), ["a"])):
        rows = OrderedRows(df, keys)
        assert rows.ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbers = rows.with_index("i").agg(F.count("i"), F.count_distinct("i"), F.min("i"), F.max("i")).first()
        n = df.count()
        assert tuple(numbers) == ((n, n, 0, n - 1) if n else (0, 0, None, None))


def test_more_ranges_for_larger_rows(spark):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    size = measured_bytes(df)
    assert 4_000_000 <= size <= 4_300_000
    assert range_partitions(df, target_bytes=size // 9) == 10 and range_partitions(df) is None
    with pytest.raises(ValueError):
        range_partitions(df, target_bytes=1)


def test_windows_meet_one_range_for_each_task(spark):
    """Ranges are dealt by their number, so no two of them share a task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = OrderedRows(spark.range(1000).withColumn("v", F.col("id") % 3), ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows.ranges == 4
    running = rows.with_running_sum(F.col("v"), "s")
    plan = running._jdf.queryExecution().executedPlan().toString()
    # Only the sums, one row for each range, are dealt by hash.
    assert plan.count("shufflepartitionidpassthrough") == 1 and plan.count("hashpartitioning(__range") == 1
    assert [r.s for r in running.orderBy("id").collect()][-1] == sum(i % 3 for i in range(1000))

"""Mergeable column states, and modes that are named by a sketch and verified by a count."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators.frequencies import text_modes, top_error, verified_modes
from tablewright.operators.states import DISTINCT_ERROR, RANK_ERROR, TRACKED, merged_states, profile_of, profile_state

SCHEMA = "id bigint, amount double, name string, day date, at timestamp_ntz, flag boolean"


def _rows(seed, n):
    r = random.Random(seed)
    return [
        (
            None if r.random() < 0.1 else r.randrange(10 * n),
            r.choice([None, float("nan"), float("inf"), 0.0, r.gauss(50, 20), r.expovariate(0.01), r.gauss(50, 20)]),
            r.choice(["hot", "hot", "hot", "", " ", f"user{r.randrange(n)}@example.com", "x" * 200, None]),
            dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(900)),
            dt.datetime(2020, 1, 1, 0, 0, 0, 123456) + dt.timedelta(minutes=r.randrange(100_000)),
            r.choice([True, False, None]),
        )
        for _ in range(n)
    ]


def _profile(states):
    return {r["column"]: r.asDict() for r in profile_of(states).collect()}


SKETCHED = ("distinct", "quantiles", "most_frequent", "most_frequent_count")


def test_merged_states_are_the_state_of_the_union(spark, tmp_path):
    parts = [_rows(1, 4_000), _rows(2, 700), [], _rows(3, 1)]
    frames = [spark.createDataFrame(p, SCHEMA).repartition(3) for p in parts]
    # Kept states are read again, as those of an earlier day are.
    profile_state(frames[0]).write.parquet(str(tmp_path / "state"))
    kept = spark.read.parquet(str(tmp_path / "state"))
    merged = _profile(merged_states(merged_states(kept, profile_state(frames[1])), *map(profile_state, frames[2:])))
    rows = [r for p in parts for r in p]
    whole = _profile(profile_state(spark.createDataFrame(rows, SCHEMA)))
    assert set(merged) == set(whole) == {"id", "amount", "name", "day", "at", "flag"}
    for column, state in whole.items():
        for key, value in state.items():
            if key in SKETCHED:
                continue
            got = merged[column][key]
            assert got == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value), (column, key)
    for states in (merged, whole):
        for i, column in enumerate(["id", "amount", "name", "day", "at", "flag"]):
            values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
            assert states[column]["non_null"] == len(values)
            assert abs(states[column]["distinct"] - len(set(values))) <= 1 + DISTINCT_ERROR * len(set(values))
        for column, i in (("id", 0), ("amount", 1)):
            values = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i] and abs(r[i]) < math.inf)
            for p, q in zip((0.25, 0.5, 0.75), states[column]["quantiles"]):
                low, high = sum(v < q for v in values), sum(v <= q for v in values)
                assert low - RANK_ERROR * len(values) - 1 <= p * len(values) <= high + RANK_ERROR * len(values) + 1
            mean = sum(values) / len(values)
            assert states[column]["mean"] == pytest.approx(mean)
            assert states[column]["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)))
            m2, m3, m4 = (sum((v - mean) ** k for v in values) / len(values) for k in (2, 3, 4))
            assert states[column]["population_skewness"] == pytest.approx(m3 / m2**1.5)
            assert states[column]["population_kurtosis"] == pytest.approx(m4 / m2**2 - 3)
        hot = sum(r[2] == "hot" for r in rows)
        assert states["name"]["most_frequent"] == "hot"
        times = Counter(str(r[0]) for r in rows if r[0] is not None)
        if (likely := states["id"]["most_frequent"]) is not None:
            assert times[likely] >= max(times.values()) - top_error(TRACKED) * len(rows)
        assert abs(states["name"]["most_frequent_count"] - hot) <= top_error(TRACKED) * len(rows)
    assert merged["at"]["first"] == min(r[4] for r in rows)
    assert merged["day"]["last"].date() == max(r[3] for r in rows)


def test_states_of_tables_without_rows_or_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    void = spark.createDataFrame([(None,) * 6] * 3, SCHEMA)
    for states, rows in ((profile_state(empty), 0), (merged_states(profile_state(empty), profile_state(void)), 3)):
        found = _profile(states)
        assert len(found) == 6
        for state in found.values():
            assert (state["row_count"], state["non_null"], state["distinct"]) == (rows, 0, 0)
            assert state["mean"] is None and state["quantiles"] is None and state["most_frequent"] is None


def test_states_of_constants_and_of_different_types(spark):
    same = profile_state(spark.createDataFrame([(5.0, "a")] * 4, "v double, `odd.name` string"))
    found = _profile(merged_states(same, same))
    assert (found["v"]["std"], found["v"]["mean"], found["v"]["row_count"]) == (0.0, 5.0, 8)
    assert found["odd.name"]["most_frequent_count"] == 8
    other = profile_state(spark.createDataFrame([("5",)], "v string"))
    with pytest.raises(Exception, match="types differ in column v"):
        merged_states(same, other).collect()
    with pytest.raises(ValueError):
        merged_states()


def test_verified_modes_are_the_modes(spark):
    r = random.Random(4)
    long = ["L" * 100 + c for c in "ba"]
    rows = [
        (r.choice(["b", "a"]) if i % 3 else f"rare{i}", long[i % 2], f"only{i}", None, f"{i % 40}")
        for i in range(6_000)
    ]
    df = spark.createDataFrame(rows, "two string, tied_long string, unique string, void string, spread string").repartition(5)
    names = df.columns
    assert verified_modes(df, names) == text_modes(df, names)
    # With few tracked values more columns are left to the full count; the result stays.
    assert verified_modes(df, names, tracked=20) == text_modes(df, names)
    assert verified_modes(df.limit(0), names) == text_modes(df.limit(0), names)
    assert verified_modes(df, []) == {}


def test_merged_states_read_their_tables_once(spark):
    read = spark.sparkContext.accumulator(0)

    def met(v):
        read.add(1)
        return v

    told = F.udf(met, "bigint").asNondeterministic()
    parts = [spark.range(start, start + 50).select(told("id").alias("id")) for start in (0, 50)]
    merged = merged_states(*map(profile_state, parts))
    for _ in range(2):
        row = profile_of(merged).first()
        assert (row["row_count"], row["min"], row["max"], row["mean"]) == (100, 0.0, 99.0, 49.5)
    assert read.value == 100

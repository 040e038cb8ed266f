"""Exact interpolated quantiles of many columns.

``percentile`` keeps every distinct value of a column in one task. That is fine while the table is known to be small
and impossible when it is not, so the count of the rows decides:

* at most ``budget`` cells: one ``percentile`` aggregate;
* more: narrow down. A sketch of fixed size brackets each wanted rank, a scan counts what lies below and inside the
  bracket, and the step repeats inside it until the bracket holds few values. These are gathered as (value, count)
  and read off exactly. A step keeps less than a hundredth of a bracket, so two or three steps serve any size, and
  before the last one only sketches and counts are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.operators.longform import fields_of, lookup
from tablewright.types import number

CELL_BUDGET = 1_000_000
SKETCH_ACCURACY = 2_000


@dataclass
class _Rank:
    """One wanted rank (from 0) of one column, and the open interval known to hold it."""

    column: int
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    slack: float = 3.0
    answer: float | None = None

    def holds(self, value: Column) -> Column:
        return value.isNotNull() if self.low is None else (value > self.low) & (value < self.high)


@dataclass
class Centre:
    """Count, mean and quantiles of one column; ``None`` where there are no values."""

    count: int
    mean: float | None
    quantiles: list[float | None]


def centres(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    budget: int = CELL_BUDGET,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, Centre]:
    """Counts, means and exact linear-interpolated quantiles per column, nulls left out."""
    if not columns:
        return {}
    view = df.select(*[number(field).alias(f"v{i}") for i, field in enumerate(fields_of(df, columns))])
    values = [F.col(f"v{i}") for i in range(len(columns))]
    small = df.count() * len(columns) <= budget
    points = list(probs) if small else _around(probs, 3.0 / accuracy)
    middles = [F.percentile(v, points) if small else F.percentile_approx(v, points, accuracy) for v in values]
    row = view.agg(*[x for v, q in zip(values, middles) for x in (F.count(v), F.avg(v), q)]).first()
    basics = [tuple(row[3 * i : 3 * i + 3]) for i in range(len(columns))]
    if small:
        exact = [list(q) if q is not None else [None] * len(probs) for _, _, q in basics]
    else:
        exact = _by_narrowing(view, [(n, q) for n, _, q in basics], probs, budget, accuracy)
    return {name: Centre(n, mean, q) for name, (n, mean, _), q in zip(columns, basics, exact)}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    budget: int = CELL_BUDGET,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, nulls left out; ``None`` for a column without values."""
    return {name: c.quantiles for name, c in centres(df, columns, probs, budget, accuracy).items()}


def _around(probs: Sequence[float], slack: float) -> list[float]:
    return [edge for p in probs for edge in (max(0.0, p - slack), min(1.0, p + slack))]


def _by_narrowing(view, first, probs, budget, accuracy) -> list[list[float | None]]:
    """``first`` holds the count of each column and the sketched values around each wanted quantile."""
    ranks: dict[tuple[int, int], _Rank] = {}
    bounds = []
    for i, (n, edges) in enumerate(first):
        for k, p in enumerate(probs if n else ()):
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                if (i, rank) not in ranks:
                    ranks[i, rank] = _Rank(i, rank, n)
                    bounds.append((ranks[i, rank], edges[2 * k], edges[2 * k + 1]))
    _close_in(view, bounds)
    share = max(1, budget // max(1, len(ranks)))
    while wide := [r for r in ranks.values() if r.answer is None and (r.low is None or r.inside > share)]:
        _close_in(view, _sketch(view, wide, accuracy))
    _gather(view, [r for r in ranks.values() if r.answer is None])

    def quantile(i: int, p: float) -> float | None:
        n = first[i][0]
        if not n:
            return None
        position = p * (n - 1)
        floor, ceil = ranks[i, math.floor(position)].answer, ranks[i, math.ceil(position)].answer
        step = position - math.floor(position)
        return floor if floor == ceil else (1 - step) * floor + step * ceil

    return [[quantile(i, p) for p in probs] for i in range(len(first))]


def _sketch(view: DataFrame, ranks: list[_Rank], accuracy: int) -> list[tuple[_Rank, float, float]]:
    """New bounds for each rank from a sketch of the values inside its interval."""
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.column, r.low, r.high), []).append(r)
    sketches = []
    for group in groups.values():
        points = [e for r in group for e in _around([(r.rank - r.below) / max(1, r.inside - 1)], r.slack / accuracy)]
        value = F.col(f"v{group[0].column}")
        sketches.append(F.percentile_approx(F.when(group[0].holds(value), value), points, accuracy))
    edges = view.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    return [(r, edges[i][2 * j], edges[i][2 * j + 1]) for i, group in enumerate(groups.values()) for j, r in enumerate(group)]


def _close_in(view: DataFrame, bounds: list[tuple[_Rank, float, float]]) -> None:
    """Count the values around the bounds and shrink the intervals accordingly.

    A bound is either the answer itself, when the rank falls among its copies, or left out of the interval with all
    its copies. So a value that fills a third of the column cannot stay inside an interval.
    """
    edges: dict[int, list[float]] = {}
    for r, low, high in bounds:
        edges.setdefault(r.column, []).extend((low, high))
    edges = {c: sorted(set(values)) for c, values in edges.items()}
    entries = [
        F.struct(F.lit(c).alias("column"), _slot(F.col(f"v{c}"), values).alias("slot")) for c, values in edges.items()
    ]
    slots = view.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.column", "e.slot").agg(F.count(F.lit(1)).alias("n"))
    counts = {(row["column"], row["slot"]): row["n"] for row in slots.collect()}

    def counted(column: int, upto_slot: int) -> int:
        return sum(n for (c, slot), n in counts.items() if c == column and slot is not None and slot <= upto_slot)

    for r, low, high in bounds:
        at_low, at_high = (2 * edges[r.column].index(e) + 1 for e in (low, high))
        under_low, upto_low = counted(r.column, at_low - 1), counted(r.column, at_low)
        under_high, upto_high = counted(r.column, at_high - 1), counted(r.column, at_high)
        if not under_low <= r.rank < upto_high:
            r.slack *= 8
        elif r.rank < upto_low:
            r.answer = low
        elif r.rank >= under_high:
            r.answer = high
        else:
            r.low, r.high, r.below, r.inside = low, high, upto_low, under_high - upto_low


def _slot(value: Column, edges: Sequence[float]) -> Column:
    """Twice the number of edges below the value, plus one if it equals the next; by halving, so with few comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        here = F.when(value == edges[middle], 2 * middle + 1).when(value < edges[middle], search(low, middle))
        return here.otherwise(search(middle + 1, high))

    return F.when(value.isNotNull(), search(0, len(edges)))


def _gather(view: DataFrame, ranks: list[_Rank]) -> None:
    """Read the answers from the few values left inside the intervals."""
    if not ranks:
        return
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.column, r.low, r.high), []).append(r)
    sharing = list(groups.values())
    hits = [group[0].holds(F.col(f"v{group[0].column}")) for group in sharing]
    entries = [
        F.struct(F.lit(i).alias("target"), F.when(hit, F.col(f"v{group[0].column}")).alias("value"))
        for i, (group, hit) in enumerate(zip(sharing, hits))
    ]
    inside = view.where(reduce(Column.__or__, hits)).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    counted = inside.where("value IS NOT NULL").groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))
    # The budget bounds the rows of a target.
    upto = F.sum("n").over(
        Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    most = max(len(group) for group in sharing)
    wanted = [
        lookup([group[k].rank - group[k].below if k < len(group) else None for group in sharing], F.col("target"), "bigint")
        for k in range(most)
    ]
    picks = [F.min(F.when(F.col("upto") > w, F.col("value"))).alias(f"a{k}") for k, w in enumerate(wanted)]
    for row in counted.withColumn("upto", upto).groupBy("target").agg(*picks).collect():
        for k, r in enumerate(sharing[row["target"]]):
            r.answer = row[f"a{k}"]


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One scan with a sketch of fixed size; rank error at most ``rows / accuracy``."""
    if not columns:
        return {}
    fields = fields_of(df, columns)
    row = df.agg(*[F.percentile_approx(number(f), list(probs), accuracy).alias(f"v{i}") for i, f in enumerate(fields)]).first()
    return {name: list(row[i]) if row[i] is not None else [None] * len(probs) for i, name in enumerate(columns)}


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True):
    return exact_quantiles(df, columns, probs) if exact else approximate_quantiles(df, columns, probs)

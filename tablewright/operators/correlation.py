"""Pearson correlations of all numeric column pairs, pairwise complete."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.formats import fixed
from tablewright.session import spread
from tablewright.types import NUMERIC, columns_of, number

STRONG = 0.7
_PAIRS_PER_PASS = 64
_TILE = 8


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(i, j, column_a, column_b, n, r)`` for every pair i < j; ``r`` is NULL when either side is constant.

    Sums of products of centred values need a handful of additions per pair. Columns without nulls share their own sums
    with all partners. Many pairs are split over several scans of few columns, so that each stays small enough to be compiled.
    """
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, column_a string, column_b string, n bigint, r double")
    fields = [df.schema[n] for n in names]
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(number(x)).alias(f"{tag}{i}") for i, x in enumerate(fields) for tag, f in (("n", F.count), ("m", F.avg))],
    ).first()
    rows, complete = base[0], [base[1 + 2 * i] == base[0] for i in range(len(names))]
    centre = [base[2 + 2 * i] or 0.0 for i in range(len(names))]
    plain = spread(df.select(*[number(x).alias(f"c{i}") for i, x in enumerate(fields)]))
    centred = plain.select(*[(F.col(f"c{i}") - F.lit(centre[i])).alias(f"c{i}") for i in range(len(names))])
    return reduce(lambda a, b: a.unionAll(b), [_pass(centred, names, chunk, complete) for chunk in _passes(pairs)])


def _passes(pairs: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs that share a scan: all of them if few, else square tiles, so that a scan reads at most two tile sides."""
    if len(pairs) <= _PAIRS_PER_PASS:
        return [list(pairs)]
    tiles: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in pairs:
        tiles.setdefault((i // _TILE, j // _TILE), []).append((i, j))
    return list(tiles.values())


def _pass(centred: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]], complete: Sequence[bool]) -> DataFrame:
    sums: dict[str, Column] = {}

    def total(key: str, value: Column) -> Column:
        sums.setdefault(key, value)
        return F.col(key)

    def own(k: int, partner: int, tag: str) -> Column:
        """Sum (``s``) or sum of squares (``q``) of a column over the rows where its partner is known."""
        value = F.col(f"c{k}") if tag == "s" else F.col(f"c{k}") * F.col(f"c{k}")
        if complete[partner]:
            return total(f"{tag}_{k}", F.sum(value))
        return total(f"{tag}_{k}_{partner}", F.sum(F.when(F.col(f"c{partner}").isNotNull(), value)))

    entries = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.lit(names[i]).alias("column_a"),
            F.lit(names[j]).alias("column_b"),
            total(f"n_{i}_{j}", F.count(F.col(f"c{i}") + F.col(f"c{j}"))).alias("n"),
            own(i, j, "s").alias("sa"), own(j, i, "s").alias("sb"), own(i, j, "q").alias("qa"), own(j, i, "q").alias("qb"),
            total(f"p_{i}_{j}", F.sum(F.col(f"c{i}") * F.col(f"c{j}"))).alias("ab"),
        )
        for i, j in pairs
    ]
    one_row = centred.agg(*[value.alias(key) for key, value in sums.items()])
    pair = one_row.select(F.explode(F.array(*entries)).alias("pair")).select("pair.*")
    return pair.select("i", "j", "column_a", "column_b", "n", pearson("n", "sa", "sb", "qa", "qb", "ab").alias("r"))


def pearson(n: str, sx: str, sy: str, xx: str, yy: str, xy: str) -> Column:
    """Correlation from the count and the sums of two centred columns; NULL when one of them does not vary.

    Rounding leaves a constant column with a spread of almost nothing, so spread is compared with the sum of squares.
    """
    count = F.col(n).cast("double")
    vx = F.col(xx) - F.try_divide(F.col(sx) * F.col(sx), count)
    vy = F.col(yy) - F.try_divide(F.col(sy) * F.col(sy), count)
    spread = F.sqrt(F.when(vx > F.col(xx) * 1e-14, vx)) * F.sqrt(F.when(vy > F.col(yy) * 1e-14, vy))
    r = F.try_divide(F.col(xy) - F.try_divide(F.col(sx) * F.col(sy), count), spread)
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix, one row per column. Schema-sized, so a pivot is safe."""
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    if len(names) < 2:
        raise ValueError("a correlation matrix needs two numeric columns")
    pairs = correlations(df, names)
    both = pairs.select("column_a", "column_b", "r").unionAll(pairs.select("column_b", "column_a", "r"))
    wide = both.groupBy(F.col("column_a").alias("column")).pivot("column_b", names).agg(F.first("r"))
    # A column correlates with itself unless it is constant, in which case it correlates with nothing.
    spread = F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()
    return wide.select(
        "column", *[F.when((F.col("column") == n) & spread, F.lit(1.0)).otherwise(F.col(f"`{n}`")).alias(n) for n in names]
    )


def strong_pairs(df: DataFrame, threshold: float = STRONG, columns: Sequence[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs beyond the threshold, with the direction and a sentence."""
    pairs = correlations(df, columns) if pairs is None else pairs
    found = pairs.where(F.abs("r") > threshold)
    direction = F.when(F.col("r") > 0, "positive").otherwise("negative")
    return found.select(
        "i",
        "j",
        "column_a",
        "column_b",
        "r",
        direction.alias("direction"),
        F.concat(
            F.lit("Strong "), F.concat(direction, F.lit("ly")), F.lit(" correlated variables: '"), "column_a",
            F.lit("' and '"), "column_b", F.lit("' (r="), fixed(F.col("r"), 3), F.lit(")"),
        ).alias("message"),
    )


def summarize_strong_pairs(strong: DataFrame, limit: int = 3) -> DataFrame:
    """One sentence naming the first strong pairs in column order."""
    first = strong.withColumn("place", F.row_number().over(Window.orderBy("i", "j"))).where(F.col("place") <= limit)
    piece = F.concat("column_a", F.lit(" and "), "column_b", F.lit(" ("), "direction", F.lit(", r="), fixed(F.col("r"), 3), F.lit(")"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("text")))).alias("items"))
    text = F.array_join(F.col("items.text"), "; ")
    return listed.select(
        F.when(F.size("items") > 0, F.concat(F.lit("Strong correlations: "), text))
        .otherwise("No strong correlations found")
        .alias("summary")
    )

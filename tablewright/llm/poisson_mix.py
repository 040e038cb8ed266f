"""Mixing sources to target weights by Poisson replication.

A source that should be seen r times on average has each of its rows repeated by a Poisson number with mean r, which is
the inverse of the distribution at a uniform number hashed from the row's id. Rows are exploded by it, and every copy
gets a hashed key that orders the whole mix. Nothing depends on partitions, so lost tasks come back with the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.batches import stored

#: Means above this are drawn as a sum of several Poisson numbers, so that tables stay short.
LARGEST_MEAN = 8.0


def _hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number from 0 to 1."""
    return F.conv(F.substring(_hex(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cumulative(mean: float) -> list[float]:
    """Poisson distribution up to where doubles reach 1."""
    term, total, out = math.exp(-mean), 0.0, []
    k = 0
    while total + term > total:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return [c for c in out if c < 1.0]


def repetition_rates(rows: DataFrame, pool: Column, size: Column, weights: Mapping[str, float], rest: float, epochs: float) -> dict[str, float]:
    """Mean repetitions by pool: weight * epochs * total size / size of the pool, weights scaled to those present.

    ``pool`` must give names in ``weights`` or an empty text for all others; so one number per weight reaches the driver.
    """
    sizes = {r["pool"]: r["bytes"] for r in rows.groupBy(pool.alias("pool")).agg(F.sum(size).alias("bytes")).collect()}
    given = {name: weights.get(name, rest if name == "" else 0.0) for name in sizes}
    whole, total = sum(given.values()), sum(sizes.values())
    return {name: (given[name] / whole * epochs * total / n if whole else 0.0) for name, n in sizes.items()}


def poisson_mix(
    rows: DataFrame, weights: Mapping[str, float], rest: float = 0.0, epochs: float = 1.0, seed: int = 7,
    source: str = "source", row_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``rows`` repeated so that sources have their target share of bytes, with ``copy`` (from 0) and ``shuffle_key``.

    ``weights`` are shares by source; sources without one, and null sources, share ``rest`` in proportion to their size.
    Size is UTF-8 bytes plus one, so empty and null texts count. Rows that repeat an id get the same number of
    copies; a row without id draws by its text. Sorting by ``shuffle_key`` gives the global shuffle. Columns named
    ``copy`` or ``shuffle_key`` are replaced, all others stay. An empty table stays empty.
    """
    if any(w < 0 for w in [*weights.values(), rest, epochs]):
        raise ValueError("weights and epochs must not be negative")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("copy", "shuffle_key")]
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    pool = F.when(name.isin(list(weights)), name).otherwise("")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    rates = repetition_rates(rows, pool, size, weights, rest, epochs)
    key = F.coalesce(F.col(row_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    copies = F.lit(0)
    for source_name, mean in sorted(rates.items()):
        draws = max(1, math.ceil(mean / LARGEST_MEAN))
        table = F.array(*[F.lit(c) for c in _cumulative(mean / draws)])
        count = F.aggregate(
            F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(0),
            lambda n, draw: n + F.size(F.filter(table, lambda c: c <= _uniform(F.lit(f"copies {seed}"), draw.cast("string"), F.col("__key")))),
        )
        copies = F.when(F.col("__pool") == source_name, count if mean > 0 else F.lit(0)).otherwise(copies)
    drawn = rows.select(*kept, pool.alias("__pool"), key.alias("__key")).withColumn("__copies", copies).where("__copies > 0")
    spread = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    order = _hex(F.lit(f"shuffle {seed}"), F.col("__key"), F.col("copy").cast("string"))
    return spread.withColumn("shuffle_key", order).drop("__pool", "__key", "__copies")


def shuffled(mix: DataFrame) -> DataFrame:
    """The mix in its global order, for writing: hashed keys make even ranges whatever the sources."""
    return mix.orderBy("shuffle_key", "copy").drop("shuffle_key", "copy")


def with_positions(mix: DataFrame, tie_break: str = "doc_id", digits: int = 3) -> DataFrame:
    """Add ``position``, the place of each row in the global order, from 0.

    Rows are numbered inside the ranges of equal first ``digits`` of the key, and ranges add their offsets. Take more
    digits for more data: there are 16 ** digits ranges of equal size.
    """
    mix = mix.withColumn("__range", F.substring("shuffle_key", 1, digits))
    counts = mix.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("shuffle_key", tie_break, "copy")) - 1
    numbered = mix.withColumn("__inside", inside).join(offsets, "__range")
    return numbered.withColumn("position", F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")

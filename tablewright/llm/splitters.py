"""Sharding by sampled splitters: equal bytes in each shard, equal texts side by side.

Rows are ordered by (hash of the text, id). Keys are sampled with a chance in proportion to their size, quantiles of the
sample are the splitters of many small ranges, and ranges that turn out overfull are sampled and cut again. Exact sizes
of the ranges then place the ends of the shards, so that only the ranges in which a shard ends matter row by row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges per shard, sampled keys per range, and how much fuller than planned a range may be.
RANGES, SAMPLES, OVERFULL = 64, 16, 4
#: Equal texts stay in one shard when together they are no more than this part of a shard.
TOGETHER = 1 / 50
_LOWEST = -(1 << 63)


def _longs(values: list[int]) -> Column:
    """A constant array, written as one text: an expression for each number would take the driver long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


class Splitters:
    """Sorted (hash, id) keys; a row belongs to the range numbered by how many splitters are at or below it."""

    def __init__(self, keys: list[tuple[int, int]]):
        self.keys = sorted(set(keys))

    def column(self) -> Column:
        """The range of a row by binary search, in Spark itself: rows need not wait beside a Python worker."""
        if not self.keys:
            return F.lit(0)
        hashes, ids = _longs([h for h, _ in self.keys]), _longs([i for _, i in self.keys])
        steps = [1 << bit for bit in reversed(range(len(self.keys).bit_length()))]

        def further(place: Column, step: Column) -> Column:
            # Beyond the last splitter ``get`` gives null, and the place stays.
            h, i = F.get(hashes, place + step - 1), F.get(ids, place + step - 1)
            return F.when((h < F.col("__hash")) | ((h == F.col("__hash")) & (i <= F.col("__id"))), place + step).otherwise(place)

        return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further), F.lit(0))


def _quantiles(sample: pd.DataFrame, step: float) -> list[tuple[int, int]]:
    """Keys at every ``step`` of the summed weights. A text met once begins at its first id, so that it is not cut."""
    if not len(sample):
        return []
    sample = sample.sort_values(["h", "i"], kind="stable")
    upto = np.cumsum(sample["k"].to_numpy())
    at = np.searchsorted(upto, np.arange(1, int(upto[-1] / step) + 1) * step, "left")
    picked = sample.iloc[np.unique(at[at < len(sample)])]
    keys = list(zip(picked["h"].tolist(), picked["i"].tolist()))
    often = {h for h, n in Counter(h for h, _ in keys).items() if n > 1}
    out = [(h, i if h in often else _LOWEST) for h, i in keys]
    return out + [(h, _LOWEST) for h in often] + [(h + 1, _LOWEST) for h in often if h < (1 << 63) - 1]


def _sample(rows: DataFrame, per_sample: float, seed: int) -> pd.DataFrame:
    """Each row counts once per ``per_sample`` bytes, with a hashed draw for the remainder."""
    draw = F.pmod(F.xxhash64("__hash", "__id", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = rows.select(F.col("__hash").alias("h"), F.col("__id").alias("i"), F.floor(F.col("__size") / per_sample + draw).alias("k"))
    return drawn.where("k > 0").groupBy("h", "i").agg(F.sum("k").alias("k")).toPandas()


def range_shards(rows: DataFrame, text_hash: Column, row_id: Column, size: Column, shards: int = 16, seed: int = 1) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1), ``slot`` (gapless from 0 in each shard).

    Sizes (at least 1) must be whole numbers. Shards differ by about one row, or ``TOGETHER`` of a shard where equal texts
    are kept together; larger groups of equal texts are cut by id. Null ids count as the smallest. Rows that agree in
    text and id are interchangeable. What reaches the driver is the sample and one row per range: at most a few
    times shards * RANGES * SAMPLES numbers, whatever the input. Existing columns stay; ``shard`` and ``slot`` are
    replaced. An empty table stays empty.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(text_hash.cast("long"), F.lit(0)).alias("__hash"),
        F.coalesce(row_id.cast("long"), F.lit(_LOWEST)).alias("__id"),
        size.cast("long").alias("__size"),
    )
    narrow = keyed.select("__hash", "__id", "__size")
    total = narrow.agg(F.sum("__size")).first()[0] or 0
    planned = max(1.0, total / (shards * RANGES))
    per_sample = planned / SAMPLES
    splitters = Splitters(_quantiles(_sample(narrow, per_sample, seed), SAMPLES) if total else [])
    while True:
        ranged = narrow.withColumn("__range", splitters.column())
        ranges = ranged.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")).orderBy("__range").toPandas()
        over = ranges.loc[(ranges["bytes"] > OVERFULL * planned) & (ranges["n"] > 1), "__range"].tolist()
        if not over:
            break
        seed += 1
        finer = _sample(ranged.where(F.col("__range").isin([int(x) for x in over])), per_sample / 4, seed)
        cut = Splitters(splitters.keys + _quantiles(finer, 4 * SAMPLES))
        if cut.keys == splitters.keys:
            break
        splitters = cut
    bytes_in, rows_in = np.zeros((2, len(splitters.keys) + 1), np.int64)
    bytes_in[ranges["__range"]], rows_in[ranges["__range"]] = ranges["bytes"], ranges["n"]
    offsets = (np.cumsum(bytes_in) - bytes_in).tolist(), (np.cumsum(rows_in) - rows_in).tolist()
    counts = _placed(narrow, splitters, offsets, total, shards).groupBy("shard").agg(F.count("*").alias("n")).collect()
    by_shard = {r["shard"]: r["n"] for r in counts}
    firsts = np.concatenate([[0], np.cumsum([by_shard.get(s, 0) for s in range(shards)])[:-1]])
    first = F.array(*[F.lit(int(x)) for x in firsts])[F.col("shard")]
    placed = _placed(keyed, splitters, offsets, total, shards)
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("__place") - first).cast("long").alias("slot"))


def _placed(rows: DataFrame, splitters: Splitters, offsets: tuple[list[int], list[int]], total: int, shards: int) -> DataFrame:
    """Rows with their place in the order of all rows and their shard, which is where their middle byte falls.

    ``offsets`` are the bytes and the rows before each range.
    """
    ranged = rows.withColumn("__range", splitters.column())
    order = Window.partitionBy("__range").orderBy("__hash", "__id", "__size")
    group = Window.partitionBy("__range", "__hash")
    bytes_before, rows_before = (F.get(_longs(before), F.col("__range")) for before in offsets)
    begin = bytes_before + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    placed = ranged.withColumn("__begin", begin).withColumn(
        "__place", rows_before + F.row_number().over(order) - 1
    )
    placed = placed.withColumn("__group_size", F.sum("__size").over(group)).withColumn("__group_begin", F.min("__begin").over(group))
    together = F.col("__group_size") <= F.lit(int(total * TOGETHER / shards))
    middle = F.when(together, 2 * F.col("__group_begin") + F.col("__group_size")).otherwise(2 * F.col("__begin") + F.col("__size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2.0 * max(1, total)))).cast("int")
    return placed.withColumn("shard", shard)

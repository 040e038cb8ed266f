"""Connected components by alternating stars: every link moves to the smallest neighbour until all links are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.batches import stored


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (a, b); the root is the smallest reachable node.

    Minima are combined before each shuffle, and joined back against a written table, so that the join of a node with a
    third of all links can be split. Links to itself or with a null end are ignored; repeated links do no harm. The
    driver sees one count and checksum per round.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.where("a <> b").where(links_known()).distinct(), "links")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        then, seen = seen, _fingerprint(now)
        if then == seen:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stored(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")


def links_known():
    return F.col("a").isNotNull() & F.col("b").isNotNull()

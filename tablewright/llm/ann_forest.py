"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Every tree gives a vector a long string of signs of random projections. A tree is the sorted array of these strings. A
query goes down each tree to its longest matching prefix; then all trees go up together, and each shorter prefix opens a
wider run of its array. All that is opened is compared by exact cosine in double precision.

How far the trees go up depends on what they found. Two vectors at an angle a share a bit with probability
p = 1 - a / pi, and so a prefix of d bits with p ** d. When the k-th cosine found is c, a vector at least that near is
in no opened run with probability of at most the product of 1 - p(c) ** d over the trees, and a query is done as soon as
this is ``MISS`` or less. Vectors in groups are done at long prefixes, so that little is opened; vectors without near
neighbours have to open much, at every size.

First every tree is sorted once over all rows: range partitions of bounded size, each with the rows next to its edges
from its two neighbours. A query opens the entries around its place in each tree (``candidates`` in all of them), so work
and shuffles of this part grow with the rows, and no entry is opened by more queries than stand near it, however hot its
prefix. Only queries that are not done by then go up further: the rows are cut into shards of bounded size, each with the
same trees over all its rows, such queries into blocks, and a task goes up in one shard for one block, to the prefix that
the k-th cosine known by then asks for.

Equal vectors are one entry with their smallest ids, which are the only ones that ties can ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.batches import importable, stored

TREES, BITS, SEED = 48, 48, 3
#: Vectors of a shard, queries of a block, rows of a range of a sorted tree.
SHARD, BLOCK, RANGE = 8192, 1024, 1 << 17
#: Entries that a query opens around its places in the sorted trees, in all trees together.
CANDIDATES = 1536
#: Accepted probability that a vector as near as the k-th one found is in no opened run.
MISS = 0.05
#: Components of the vectors compared at once in a task.
CELLS = 1 << 22


def tree_codes(vectors: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Hash strings as unsigned numbers, (trees, n); the first bit of a string is the highest."""
    rng = np.random.default_rng(seed)
    powers = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    out = np.empty((trees, len(vectors)), np.uint64)
    for tree in range(trees):
        planes = rng.standard_normal((vectors.shape[1], bits))
        out[tree] = ((vectors @ planes) > 0) @ powers
    return out


def sufficient_depth(cosine: float, trees: int, bits: int, miss: float = MISS) -> int:
    """The longest prefix at which ``trees`` runs miss a vector with this cosine with probability ``miss`` at most."""
    shared = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    if shared <= 0:
        return 0
    wanted = 1 - miss ** (1 / trees)
    return bits if shared >= wanted ** (1 / bits) else int(np.log(wanted) / np.log(shared))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``, or with the one vector ``b``."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=-1)))


class PrefixForest:
    """Sorted hash strings of each tree over the rows of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.bits, self.seed = vectors, bits, seed
        codes = tree_codes(vectors, trees, bits, seed)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def runs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of the run that shares a prefix with each query: (trees, queries, bits + 1)."""
        depths = np.arange(self.bits + 1, dtype=np.uint64)
        # Bits below a prefix, all zeros at its first and all ones at its last string.
        below = (np.uint64(1) << (np.uint64(self.bits) - depths)) - np.uint64(1)
        codes = tree_codes(queries, len(self.order), self.bits, self.seed)[:, :, None]
        first = [np.searchsorted(own, code & ~below, "left") for own, code in zip(self.sorted, codes)]
        last = [np.searchsorted(own, code | below, "right") for own, code in zip(self.sorted, codes)]
        return np.array(first, np.int32), np.array(last, np.int32)

    def ascent(self, first: np.ndarray, last: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        """(depth, rows opened first at it), from the longest prefix whose runs hold ``wanted`` entries up to no prefix.

        ``first`` and ``last`` are one query's runs: (trees, bits + 1).
        """
        met = np.zeros(len(self.vectors), bool)
        enough = np.flatnonzero((last - first).sum(axis=0) >= wanted)
        for depth in range(enough[-1] if len(enough) else 0, -1, -1):
            before = met.copy()
            for order, start, end in zip(self.order, first[:, depth], last[:, depth]):
                met[order[start:end]] = True
            yield depth, np.flatnonzero(met & ~before)
            if met.all():
                return

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the rows in the runs of the longest common depth at which there are ``wanted`` entries."""
        first, last = self.runs(queries)
        for q in range(len(queries)):
            yield next(self.ascent(first[:, q], last[:, q], wanted))[1]

    def nearest(self, queries: np.ndarray, k: int, known: np.ndarray, weights: np.ndarray, wanted: int = 1):
        """(rows, cosines) of all rows opened for each query, going up until the ``k``-th cosine allows to stop.

        ``known`` is the ``k``-th cosine that each query has found elsewhere; a row counts as often as ``weights`` says.
        """
        first, last = self.runs(queries)
        for q, (query, least) in enumerate(zip(queries, known)):
            rows, scores = np.empty(0, np.int64), np.empty(0)
            for depth, opened in self.ascent(first[:, q], last[:, q], wanted):
                rows, scores = np.concatenate([rows, opened]), np.concatenate([scores, cosines(self.vectors[opened], query)])
                best = np.argsort(-scores)[:k]
                counts = np.cumsum(weights[rows[best]])
                if len(counts) and counts[-1] >= k:
                    least = max(least, scores[best[np.searchsorted(counts, k)]])
                if depth <= sufficient_depth(least, len(self.order), self.bits):
                    break
            yield rows, scores


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(numbers, lambda x: x != 0)


def nearest_vectors(
    vectors: DataFrame, is_query: Column, k: int = 5, candidates: int = CANDIDATES, shard: int = SHARD, block: int = BLOCK,
    range_rows: int = RANGE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query among all rows but its own.

    ``vectors`` has ``vec_id`` and ``embedding``; rows for which ``is_query`` holds are queries. Rank counts from 1, by
    cosine and then by smaller id; with fewer candidates all are returned. Vectors that are null, zero or hold null or
    non-finite components, and rows without id, take no part. Vectors meet only vectors of their own length. Rows that
    repeat an id and vector count once. Other columns are ignored.
    """
    importable(vectors.sparkSession)
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    smallest = rows.select("vector", "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    entries = stored(
        smallest.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.xxhash64("vector")),
        "entries",
    )
    asked = stored(rows.where("asked").select("vec_id", "vector").distinct().withColumn("point", F.xxhash64("vector")), "asked")
    points = stored(asked.select("point", "vector").distinct(), "points")
    n_entries = entries.count()
    n_shards = max(1, -(-n_entries // shard))
    runs = _opened(entries, points, max(1, candidates // (2 * TREES)), max(1, -(-n_entries * TREES // range_rows)))
    first = stored(_best(_compared(entries, points, runs, n_shards, k), k), "first")
    open_points = stored(_not_done(points, runs, first, k), "open")
    n_blocks = -(-open_points.count() // block)
    best = first if n_blocks == 0 else _best(first.unionByName(_further(entries, open_points, n_shards, n_blocks, k, candidates)), k)
    own = Window.partitionBy("query_id", "point").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), "point").join(best, "point").where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` + 1 nearest of each point; its own row may be among them."""
    nearest = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    each = found.groupBy("point", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")


def _opened(entries: DataFrame, points: DataFrame, reach: int, ranges: int) -> DataFrame:
    """(point, depth, keys) for each point and tree: the ``reach`` entries before and behind it in the sorted tree, and
    the shortest prefix whose run is among them whole; more than ``BITS`` where not even the whole string's is."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["vector"].map(len)):
                codes = tree_codes(np.stack(part["vector"].to_list()).astype(np.float64), TREES, BITS, SEED)
                yield pd.DataFrame({
                    "tree": np.repeat(width * TREES + np.arange(TREES), len(part)), "code": codes.ravel().astype(np.int64),
                    "key": np.tile(part["key"].to_numpy(), TREES), "asked": np.tile(part["asked"].to_numpy(), TREES),
                })

    # Equal strings stand in another order in each tree, so that large groups do not show the same few everywhere.
    order = ["tree", "code", "tie"]
    both = entries.select("key", "vector", F.lit(False).alias("asked")).unionByName(
        points.select(F.col("point").alias("key"), "vector", F.lit(True).alias("asked")))
    trees = stored(
        both.mapInPandas(coded, "tree long, code long, key long, asked boolean").withColumn("tie", F.xxhash64("tree", "key"))
        .repartitionByRange(ranges, *order).withColumn("piece", F.spark_partition_id().cast("long")),
        "trees",
    )
    held = trees.where("NOT asked")
    edge = Window.partitionBy("piece")
    edges = [
        held.withColumn("n", F.row_number().over(edge.orderBy(*[direction(c) for c in order])))
        .where(F.col("n") <= reach + 1).drop("n").withColumn("piece", F.col("piece") + step)
        for direction, step in ((F.asc, -1), (F.desc, 1))
    ]

    def around(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tree", "code", "tie", "asked"], kind="stable", ascending=[True, True, True, False])
        asked = frame["asked"].to_numpy(bool)
        at = np.cumsum(~asked)[asked]
        queries, rows = frame[asked], frame[~asked]
        if rows.empty:
            return pd.DataFrame({"point": [], "depth": [], "keys": pd.Series([], dtype=object)}).astype({"point": "int64", "depth": "int64"})
        tree, code, keys = (rows[c].to_numpy() for c in ("tree", "code", "key"))
        own_tree, own_code = queries["tree"].to_numpy(), queries["code"].to_numpy()
        depth = np.zeros(len(queries), np.int64)
        for beyond in (at - reach - 1, at + reach):
            inside = (beyond >= 0) & (beyond < len(rows))
            where = np.where(inside, beyond, 0)
            # The number of the highest bit that differs is the exponent of the difference.
            shared = BITS - np.frexp((own_code ^ code[where]).astype(np.float64))[1]
            depth = np.maximum(depth, np.where(inside, np.where(tree[where] == own_tree, shared + 1, 0), BITS + 1))
        spans = at[:, None] + np.arange(-reach, reach)
        fits = (spans >= 0) & (spans < len(rows))
        fits &= tree[np.where(fits, spans, 0)] == own_tree[:, None]
        found = [keys[span[fit]] for span, fit in zip(spans, fits)]
        return pd.DataFrame({"point": queries["key"].to_numpy(), "depth": depth, "keys": pd.Series(found, dtype=object)})

    pieces = trees.unionByName(edges[0]).unionByName(edges[1])
    return stored(pieces.groupBy("piece").applyInPandas(around, "point long, depth long, keys array<long>"), "opened")


def _compared(entries: DataFrame, points: DataFrame, runs: DataFrame, n_shards: int, k: int) -> DataFrame:
    """(point, vec_id, score) of the entries that the points opened, the ``k`` + 1 nearest of each shard."""
    dealt = F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard")
    pairs = runs.select("point", F.explode("keys").alias("key")).select(dealt, "point", "key")
    # One row for what a point opened in a shard: rows of single pairs cost more than comparing them.
    opened = pairs.groupBy("shard", "point").agg(F.collect_set("key").alias("keys")).join(points, "point")
    no_ids = F.array().cast("array<long>")
    everything = (
        entries.select(dealt, F.lit(False).alias("asked"), F.col("key").alias("name"), "vector", "ids", no_ids.alias("keys"))
        .unionByName(opened.select("shard", F.lit(True).alias("asked"), F.col("point").alias("name"), "vector", no_ids.alias("ids"), "keys"))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["asked"].to_numpy(bool)
        queries, held = frame[asked], frame[~asked]
        if queries.empty or held.empty:
            return _found([])
        held = pd.DataFrame({"key": held["name"].to_numpy(), "e": np.arange(len(held)), "vector": held["vector"].to_numpy(), "ids": held["ids"].to_numpy()})
        points, opened = queries["name"].to_numpy(), queries["keys"].to_numpy()
        pairs = pd.DataFrame({"q": np.repeat(np.arange(len(queries)), [len(keys) for keys in opened]), "key": np.concatenate(opened)})
        # Vectors that differ under one key are all compared.
        pairs = pairs.merge(held[["key", "e"]], on="key")
        a, b = held["vector"].to_numpy(), queries["vector"].to_numpy()
        width, asked = np.array([len(v) for v in a], int), np.array([len(v) for v in b], int)
        ids, out = held["ids"].to_numpy(), []
        pairs = pairs[width[pairs["e"]] == asked[pairs["q"]]].sort_values("q", kind="stable")
        starts = np.append(np.flatnonzero(np.diff(pairs["q"], prepend=-1)), len(pairs))
        e, q = pairs["e"].to_numpy(), pairs["q"].to_numpy()
        for start, end in zip(starts, starts[1:]):
            step = max(1, CELLS // max(1, asked[q[start]]))
            scores = np.concatenate([
                cosines(np.stack(a[e[i : min(i + step, end)]]).astype(np.float64), np.asarray(b[q[start]], np.float64))
                for i in range(start, end, step)])
            out += [(int(points[q[start]]), i, s) for i, s in _listed(e[start:end], scores, ids, k)]
        return _found(out)

    return everything.groupBy("shard").applyInPandas(compare, "point long, vec_id long, score double")


def _listed(rows: np.ndarray, scores: np.ndarray, ids, k: int) -> list[tuple[int, float]]:
    """The ``k`` + 1 nearest ids among the rows, ties to the smaller id."""
    near = np.argsort(-scores)
    limit = scores[near[min(k, len(near) - 1)]]
    rows, scores = rows[scores >= limit], scores[scores >= limit]
    return [(i, -s) for s, i in sorted((-float(s), int(i)) for r, s in zip(rows, scores) for i in ids[r])[: k + 1]]


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["point", "vec_id", "score"]).astype({"point": "int64", "vec_id": "int64", "score": "float64"})


def _not_done(points: DataFrame, runs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Points whose opened runs may miss a vector as near as the ``k``-th one found, with that cosine as ``known``."""
    known = found.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("known"))
    known = known.select("point", F.when(F.col("n") > k, F.col("known")).otherwise(-1.0).alias("known"))
    shared = 1 - F.acos(F.least(F.greatest("known", F.lit(-1.0)), F.lit(1.0))) / F.lit(float(np.pi))
    # A run that holds every such vector makes the probability nothing; one that is not whole does not count.
    tree = F.when(F.col("depth") > BITS, 0.0).otherwise(F.coalesce(F.log1p(-F.pow(shared, F.col("depth"))), F.lit(-1e9)))
    done = (
        runs.select("point", "depth").join(known, "point").groupBy("point")
        .agg(F.sum(tree).alias("missed")).where(F.col("missed") <= float(np.log(MISS))).select("point")
    )
    return points.join(done, "point", "left_anti").join(known, "point", "left").withColumn("known", F.coalesce("known", F.lit(-1.0)))


def _further(entries: DataFrame, points: DataFrame, n_shards: int, n_blocks: int, k: int, wanted: int) -> DataFrame:
    """(point, vec_id, score): what the points find by going up in the trees of every shard."""
    numbers = [F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) for n in (n_blocks, n_shards)]
    held = entries.select(
        F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard"), F.explode(numbers[0]).alias("block"),
        F.lit(False).alias("asked"), F.lit(0).cast("long").alias("point"), "vector", "ids", F.lit(0.0).alias("known"),
    )
    queries = points.select(
        F.explode(numbers[1]).alias("shard"), F.pmod(F.hash("point"), F.lit(n_blocks)).cast("long").alias("block"),
        F.lit(True).alias("asked"), "point", "vector", F.array().cast("array<long>").alias("ids"), "known",
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["asked"].to_numpy(bool)
        queries, held = frame[asked], frame[~asked]
        out: list[tuple] = []
        if len(queries) and len(held):
            ids = held["ids"].to_numpy()
            weights = np.array([len(own) for own in ids])
            forest = PrefixForest(np.stack(held["vector"].to_list()).astype(np.float64))
            vectors = np.stack(queries["vector"].to_list()).astype(np.float64)
            opened = forest.nearest(vectors, k + 1, queries["known"].to_numpy(), weights, max(1, wanted // n_shards))
            for point, (rows, scores) in zip(queries["point"].tolist(), opened):
                out += [(int(point), i, s) for i, s in _listed(rows, scores, ids, k)]
        return _found(out)

    both = held.unionByName(queries).withColumn("width", F.size("vector"))
    return both.groupBy("shard", "block", "width").applyInPandas(search, "point long, vec_id long, score double")

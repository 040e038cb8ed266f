"""K-means over the standardized numeric columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tablewright.operators.deal import dealt
from tablewright.operators.starts import parallel_starts
from tablewright.types import NUMERIC, col, columns_of, number

# Largest number of clusters tried, and the least number of rows.
MAX_CLUSTERS = 10
MIN_ROWS = 10
SEED = 42
#: Rounds of the fits among which k is chosen, and the move of a centre below which they stop.
TRIED_ROUNDS, TRIED_MOVE = 20, 1e-4
#: Rounds after which a fit that still moves is taken as it is, and the move below which a centre stands still. Spreads are
#: 1, so one row that changes its group moves a centre further up to 10**9 rows; sums in another order move it less.
MAX_ROUNDS, STILL = 300, 1e-10
#: Tasks of a round for each core. A piece of the deal is too small for a task of its own.
_TASKS = 3


def choose_k(costs: Sequence[float], rule: str = "elbow") -> int:
    """Number of clusters from the costs of k = 2, 3, ...

    ``elbow``: where the drop in cost slows down most. ``flattest``: two more than the place of the smallest drop.
    """
    if len(costs) < 2:
        return 3 if not costs else 2
    steps = [b - a for a, b in zip(costs, costs[1:])]
    if rule == "flattest":
        return steps.index(max(steps)) + 2
    if rule != "elbow":
        raise ValueError("rule is 'elbow' or 'flattest'")
    bends = [b - a for a, b in zip(steps, steps[1:])]
    return bends.index(max(bends)) + 3 if bends else 2


def _scaling(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, PipelineModel]:
    """The named numeric columns as x0, x1, ... (missing as 0), and the step that adds their standardized vector."""
    if len(names) < 2:
        raise ValueError("clustering needs two numeric columns")
    values = df.select(*[F.coalesce(number(df.schema[n]), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)])
    values = dealt(values, df.count()).persist(StorageLevel.MEMORY_AND_DISK)
    assembler = VectorAssembler(inputCols=values.columns, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return values, PipelineModel([assembler, scaler.fit(assembler.transform(values))])


def _scaled(scaler: PipelineModel) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Standardizes a batch."""
    mean, spread = (np.array(v) for v in (scaler.stages[1].mean, scaler.stages[1].std))
    factor = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread != 0)

    def scaled(batch):
        rows = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(mean))])
        return (rows - mean) * factor

    return scaled


def _nearest(scaler: PipelineModel) -> Callable[[pa.RecordBatch, dict], Iterator[tuple]]:
    """Standardizes a batch, and gives for each set of centres its key, the rows, their nearest centres and distances."""
    scaled = _scaled(scaler)

    def nearest(batch, sets):
        rows = scaled(batch)
        for key, centres in sets.items():
            # The square of the row itself is the same for all centres.
            near = (centres * centres).sum(axis=1) - 2 * (rows @ centres.T)
            best = near.argmin(axis=1)
            apart = rows - centres[best]
            yield key, rows, best, np.einsum("ij,ij->i", apart, apart)

    return nearest


def _rounds(
    values: DataFrame, scaler: PipelineModel, sets: dict[int, np.ndarray], limit: int, move: float
) -> dict[int, tuple[np.ndarray, float, bool]]:
    """Lloyd's rounds for several sets of centres at once: ``(centres, cost, whether they stand still)`` of each.

    One pass over the rows serves all sets that still move; a task sends counts, sums and cost for each centre. A centre
    without rows stays. The cost is that of the last assignment, as in MLlib.
    """
    nearest = _nearest(scaler)
    tasks = _TASKS * values.sparkSession.sparkContext.defaultParallelism
    input_rows = values.coalesce(tasks)
    done: dict[int, tuple[np.ndarray, float, bool]] = {k: (c, 0.0, False) for k, c in sets.items()}
    for _ in range(limit):
        open_sets = {k: c for k, (c, _, still) in done.items() if not still}
        if not open_sets:
            break

        def sums(batches: Iterator[pa.RecordBatch], open_sets=open_sets) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((c.shape[0], c.shape[1] + 2)) for k, c in open_sets.items()}
            for batch in batches:
                for k, rows, best, squares in nearest(batch, open_sets):
                    part = total[k]
                    member = (best[:, None] == np.arange(len(part))).astype(np.float64)
                    part[:, :-2] += member.T @ rows
                    part[:, -2] += member.sum(axis=0)
                    part[:, -1] += squares @ member
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "sums"])

        parts = input_rows.mapInArrow(sums, "k int, sums binary").collect()
        for k, old in open_sets.items():
            width = old.shape[1] + 2
            total = sum(np.frombuffer(r["sums"]).reshape(-1, width) for r in parts if r["k"] == k)
            count = total[:, -2:-1]
            new = np.divide(total[:, :-2], count, out=old.copy(), where=count > 0)
            done[k] = new, float(total[:, -1].sum()), bool((((new - old) ** 2).sum(axis=1) <= move * move).all())
    return done


def _assigned(values: DataFrame, scaler: PipelineModel, centres: np.ndarray) -> DataFrame:
    """The rows with their standardized vector and the nearest centre."""
    nearest = _nearest(scaler)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, best, _ in nearest(batch, {0: centres}):
                yield batch.append_column("prediction", pa.array(best, pa.int32()))

    schema = ", ".join([*[f"{c} double" for c in values.columns], "prediction int"])
    return scaler.transform(values.mapInArrow(told, schema)).drop("raw")


def scaled_vectors(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The numeric columns (missing as 0) and their standardized vector (mean 0, sample spread 1)."""
    values, scaler = _scaling(df, [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)])
    return scaler.transform(values).drop("raw")


@dataclass
class Clustering:
    """A fitted clustering at its fixpoint: every row belongs to the nearest centre, every centre is the mean of its rows."""

    names: list[str]
    k: int
    cost: float
    #: Numeric columns x0, x1, ... (missing as 0), their standardized vector ``features``, and ``prediction``.
    assigned: DataFrame
    #: Standardized centres.
    centres: list[list[float]]
    #: The numeric columns alone, persisted until ``release`` is called.
    values: DataFrame

    def release(self) -> None:
        self.values.unpersist()

    def assignments(self) -> DataFrame:
        """The numeric columns of each row under their names, and ``cluster``. Rows are in no order; equal rows stay."""
        return self.assigned.select(*[F.col(f"x{i}").alias(n) for i, n in enumerate(self.names)], F.col("prediction").alias("cluster"))

    def centre_table(self) -> DataFrame:
        """``(cluster, column, centre)``: the standardized centres, a row per cluster and column."""
        rows = [(c, n, float(v)) for c, centre in enumerate(self.centres) for n, v in zip(self.names, centre)]
        return self.assigned.sparkSession.createDataFrame(rows, "cluster int, column string, centre double")


def fit_clusters(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int | None = None,
    max_k: int = MAX_CLUSTERS,
    rule: str = "elbow",
    seed: int = SEED,
) -> Clustering:
    """K-means with the given or the best number of clusters; the chosen fit goes on until no centre moves.

    The numeric columns stay persisted for the result; its ``release`` ends that.
    """
    names = [c for c in (columns or columns_of(df, NUMERIC)) if c in columns_of(df, NUMERIC)]
    values, scaler = _scaling(df, names)
    total = values.count()
    if total < MIN_ROWS:
        values.unpersist()
        raise ValueError(f"clustering needs {MIN_ROWS} rows, got {total}")
    tried = [k] if k else range(2, max(2, min(max_k, total // 2)) + 1)
    starts = parallel_starts(values, _scaled(scaler), tried, seed, _TASKS * df.sparkSession.sparkContext.defaultParallelism)
    found = _rounds(values, scaler, starts, TRIED_ROUNDS, TRIED_MOVE)
    if k is None:
        k = choose_k([found[i][1] for i in tried], rule)
    # The chosen fit goes on from where it stands.
    centres, cost, _ = _rounds(values, scaler, {k: found[k][0]}, MAX_ROUNDS - TRIED_ROUNDS, STILL)[k]
    return Clustering(names, k, cost, _assigned(values, scaler, centres), centres.tolist(), values)


def clusters(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int | None = None,
    max_k: int = MAX_CLUSTERS,
    rule: str = "elbow",
    seed: int = SEED,
) -> DataFrame:
    """``(cluster, k, size, percentage, column, mean_value, silhouette)``: a row per cluster and numeric column."""
    fit = fit_clusters(df, columns, k, max_k, rule, seed)
    names, assigned = fit.names, fit.assigned.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        score = silhouette_score(assigned)
        means = assigned.groupBy("prediction").agg(
            F.count(F.lit(1)).alias("size"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))]
        ).orderBy("prediction").collect()
    finally:
        assigned.unpersist()
        fit.release()
    total = sum(r["size"] for r in means)
    rows = [
        (r["prediction"], fit.k, r["size"], r["size"] * 100.0 / total, name, r[f"x{i}"], score)
        for r in means
        for i, name in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(
        rows, "cluster int, k int, size bigint, percentage double, column string, mean_value double, silhouette double"
    )


def silhouettes(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``df`` with the silhouette of each row for the groups in ``label``, with squared Euclidean distance.

    The mean squared distance of a row to a group follows from the group's size, sum and sum of squares, so one
    aggregate with a row per group and one projection are all it takes. Missing numbers count as 0. A row that is alone in
    its group has 0, as has every row if there is but one group; rows without label have none. The number of groups
    must be small enough for a list in a query.
    """
    names = list(columns)
    number_of = {n: F.coalesce(number(df.schema[n]), F.lit(0.0)) for n in names}
    square = sum((number_of[n] * number_of[n] for n in names), F.lit(0.0))
    groups = df.where(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(square).alias("squares"), *[F.avg(number_of[n]).alias(f"m{i}") for i, n in enumerate(names)]
    ).orderBy("label").collect()

    def distance(g) -> Column:
        inner = sum((number_of[n] * F.lit(g[f"m{i}"]) for i, n in enumerate(names)), F.lit(0.0))
        return F.greatest(square - F.lit(2.0) * inner + F.lit(g["squares"]), F.lit(0.0))

    own, others = F.lit(None).cast("double"), []
    for g in groups:
        mine = col(label) == F.lit(g["label"])
        # Without the row itself, whose distance to itself is 0.
        own = F.when(mine, distance(g) * F.lit(g["n"] / (g["n"] - 1.0)) if g["n"] > 1 else F.lit(None).cast("double")).otherwise(own)
        others.append(F.when(~mine, distance(g)))
    other = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    spread_out = F.greatest(own, other)
    value = F.when(own.isNull() | other.isNull() | (spread_out == 0), 0.0).otherwise((other - own) / spread_out)
    return df.withColumn("silhouette", F.when(col(label).isNotNull(), value))


def silhouette_score(assigned: DataFrame) -> float:
    """Mean silhouette of a fit, with squared Euclidean distance between its vectors; 0 for a single cluster.

    The same measure as :func:`silhouettes`, from vectors instead of columns.
    """
    low, high = assigned.agg(F.min("prediction"), F.max("prediction")).first()
    if low == high:
        return 0.0
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(assigned))

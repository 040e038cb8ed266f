"""Random forests for numeric targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tablewright.operators.deal import dealt
from tablewright.operators.forest import Forest, grown_forests, predictions
from tablewright.operators.quantiles import quantiles
from tablewright.types import NUMERIC, columns_of, number

# Number of targets, split, and size of the forest.
MAX_TARGETS = 3
TRAIN_SHARE = 0.7
SEED = 42
TREES = 50
DEPTH = 5
MIN_ROWS = 10
MODEL_SCHEMA = "target string, feature string, importance double, r2_score double, rmse double, train_rows bigint, test_rows bigint, model_type string"


def _filled(df: DataFrame, names: Sequence[str], exact: bool) -> tuple[DataFrame, int]:
    """All numeric columns as doubles, gaps filled with the median, and the number of rows.

    Columns without any value get 0. Only columns with gaps are searched for their median.
    """
    values = [number(df.schema[n]) for n in names]
    rows, *held = df.agg(F.count(F.lit(1)), *[F.count(v) for v in values]).first()
    gaps = [n for n, k in zip(names, held) if k < rows]
    medians = quantiles(df, gaps, [0.5], exact) if gaps else {}
    fills = [medians[n][0] if n in medians and medians[n][0] is not None else 0.0 for n in names]
    return df.select(*[F.coalesce(v, F.lit(f)).alias(f"x{i}") for i, (v, f) in enumerate(zip(values, fills))]), rows


def predictive_models(
    df: DataFrame,
    targets: Sequence[str] | None = None,
    max_targets: int = MAX_TARGETS,
    seed: int = SEED,
    trees: int = TREES,
    depth: int = DEPTH,
    exact: bool = True,
) -> DataFrame:
    """One forest per target with all other numeric columns as features: a row per (target, feature).

    Rows are assigned to training or test by a hash of their content, so a recomputed partition gets the same rows
    again and equal rows never sit on both sides. They are dealt to tasks by content as well, so the forest does not
    depend on the cluster or on the partitions in which the rows come.
    """
    names = columns_of(df, NUMERIC)
    if len(names) < 2:
        raise ValueError("modeling needs two numeric columns")
    chosen = [t for t in (targets or names[:max_targets]) if t in names]
    data = dealt(*_filled(df, names, exact))
    lot = F.pmod(F.xxhash64(F.lit(seed), *data.columns), F.lit(10_000))
    data = data.withColumn("train", lot < int(TRAIN_SHARE * 10_000)).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        sizes = data.agg(F.count_if("train"), F.count_if(~F.col("train"))).first()
        if sum(sizes) >= MIN_ROWS and sizes[0] and sizes[1] > 1:
            columns = [c for c in data.columns if c != "train"]
            places = [names.index(t) for t in chosen]
            forests, thresholds = grown_forests(data.where("train").select(*columns), sizes[0], places, trees, depth, seed)
            for forest, (n, squares, variance) in zip(forests, _scores(data.where("NOT train").select(*columns), forests, thresholds)):
                r2, rmse = 1 - squares / (n * variance) if variance else 0.0, (squares / n) ** 0.5
                rows += [
                    (names[forest.target], names[c], float(share), float(r2), float(rmse), *sizes, "RandomForest")
                    for c, share in zip(forest.features, forest.importances())
                ]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, MODEL_SCHEMA)


def _scores(rows: DataFrame, forests: list[Forest], thresholds: list) -> list[tuple[int, float, float]]:
    """Rows, squared error and variance of each target over the rows."""
    figures = []
    for i in range(len(forests)):
        error = F.col(f"label{i}") - F.col(f"prediction{i}")
        figures.append(F.struct(F.count("*"), F.sum(error * error), F.var_pop(f"label{i}")))
    return [tuple(s) for s in predictions(rows, forests, thresholds).agg(*figures).first()]

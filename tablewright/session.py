"""Session helpers: suggested settings and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Settings the operators were written for. Shuffle partitions are left to the cluster: adaptive execution
# merges small ones and splits skewed ones.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, when it is not installed on their path."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tablewright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table written once and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and cut the lineage, so lost executors cannot change them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects the result to occupy; an upper bound for scans and projections."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Ranges that one sort may have. Each is a row in the small table that carries counts and values from range to range.
MAX_RANGES = 1_000_000


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows by one aggregate over them: lengths of texts, binaries and nested values, and fixed widths.

    Columns of fixed width are not read for it. Nothing is taken from the optimizer, whose estimate of a join or of rows
    that were never written can be wrong by any factor.
    """
    fixed, lengths = 16, []
    for field in df.schema.fields:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.coalesce(F.sum(F.octet_length(value)), F.lit(0)))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            lengths.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(value)))), F.lit(0)))
        else:
            fixed += 16 if isinstance(field.dataType, T.DecimalType) else 8
    rows, text = df.agg(F.count(F.lit(1)), sum(lengths, F.lit(0)).cast("decimal(38,0)")).first()
    return rows * (fixed + 8 * len(lengths)) + int(text)


def range_partitions(df: DataFrame, target_bytes: int = 256 << 20) -> int | None:
    """Number of ranges for a sort when the configured shuffle partitions would be too big; otherwise ``None``."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-measured_bytes(df) // target_bytes)
    if wanted > MAX_RANGES:
        raise ValueError(f"{wanted} ranges of {target_bytes} bytes: allow larger ones")
    return wanted if wanted > configured else None


def spread(df: DataFrame, min_bytes: int = 1 << 17) -> DataFrame:
    """Give every core a share of a small input that comes in too few pieces, such as one file of one row group.

    Applies only before heavy work per row, and never to an input that has a split for each core anyway: then the scan
    is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    splits = size // _bytes_setting(spark, "spark.sql.files.maxPartitionBytes")
    pieces = min(cores, size // min_bytes)
    return df.repartition(int(pieces)) if splits < cores and pieces > 1 else df


def _bytes_setting(spark: SparkSession, key: str) -> int:
    """A size setting such as ``128MB`` or ``134217728b`` in bytes."""
    text = spark.conf.get(key).strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 1)
    return int(text.rstrip("kmgt")) * unit

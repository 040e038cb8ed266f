"""A corpus from raw documents to shards: each stage is written as Parquet and read again as the next one's input.

    python -c "import corpus_pipeline; ..."   # run(spark, "/data/tables")

Stages take (spark, docs, sf_dir) and work on all that their predecessor kept. All but the last return the columns of
``documents``; the last one adds the place of each row in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.llm.batches import stored
from tablewright.llm.language_cnn import UNKNOWN, fit_language_model, language_of, least_share
from tablewright.llm.minhash import near_duplicates
from tablewright.llm.poisson_mix import poisson_mix, shuffled
from tablewright.llm.queries import MIX_REST, MIX_WEIGHTS
from tablewright.llm.spaced_seeds import benchmark_overlaps
from tablewright.llm.splitters import range_shards

SHARDS = 16
#: Texts are near-duplicates from this similarity of their word shingles on, in percent.
SIMILAR = 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a hash of id and text, by which decisions find their rows. Equal rows share it."""
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows; null texts, texts without letters and doubtful ones go.

    The model learns from rows of ``docs`` with text and ``lang``; a text is doubtful if its score lies well below those
    of all labelled rows outside the training sample (:func:`least_share`), however many languages there are. Every row is
    told once and stored with its score. Without labelled rows nothing can be told, and only texts without letters go.
    Repeated rows are told alike, all columns stay.
    """
    model = fit_language_model(docs)
    rows = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).where("__letters").drop("__letters")
    if model is None:
        return rows
    told = stored(rows.withColumn("__told", language_of(model, F.col("text"))), "told")
    known = (F.col("__told.lang_pred") != UNKNOWN) & (F.col("__told.score") >= least_share(told, model, told="__told"))
    return told.where(known).drop("__told")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (``SIMILAR``): the one with the smallest id.

    A document is an id with its text: unrelated texts under one id are told apart and all stay. Rows without id all
    stay. Of rows with equal id and text one stays.
    """
    keyed = _row_key(docs).where("doc_id IS NOT NULL")
    groups = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), percent=SIMILAR)
    placed = groups.select(F.col("doc_id").alias("__row"), "component_id").distinct()
    ids = keyed.select("__row", "doc_id").distinct()
    best = placed.join(ids.hint("merge"), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("best"))
    kept = stored(best.select("best.__row"), "kept")
    named = keyed.join(kept, "__row", "left_semi")
    first = Window.partitionBy("__row").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    named = named.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(_columns(docs))
    return named.unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark.

    Null and empty texts hold none and stay. Equal rows are decided alike. An empty benchmark takes nothing.
    """
    keyed = _row_key(docs)
    found = benchmark_overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=("__row",))
    leaks = stored(found.select("__row").distinct(), "leaks")
    return keyed.join(leaks, "__row", "left_anti").select(_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated until sources have their target share of bytes, in one global shuffled order.

    Null texts count one byte; null and unnamed sources share the rest. Columns named like those of the mix stay as they are.
    """
    return shuffled(poisson_mix(docs, MIX_WEIGHTS, MIX_REST, seed=7)).select(_columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ``shard`` and ``slot``: ``SHARDS`` shards of near equal bytes.

    Null texts count one byte. Equal texts are told apart by id, rows of equal text and id stay together. Columns of the
    documents named ``shard`` or ``slot`` are replaced.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return range_shards(docs, F.xxhash64("text"), F.col("doc_id"), size, shards=SHARDS)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The language network cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

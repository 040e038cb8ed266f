"""The registered queries on the small tables, against their SQL or against facts that must hold."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return {name: run(spark, SF_DIR).toPandas() for name, run in QUERIES.items()}


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def plain(frame) -> list[str]:
    """Rows as text. Whole numbers beside nulls are whole numbers, however a frame holds them."""
    def cell(x):
        return None if x is None or str(x) == "<NA>" or x != x else int(x) if isinstance(x, float) and x == int(x) else x

    return sorted(str([cell(x) for x in row]) for row in frame.astype(object).values.tolist())


def test_against_sql(results):
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM '{path}'")
    for name, sql in ORACLES.items():
        want, got = db.execute(sql).df(), results[name]
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert plain(got[columns]) == plain(want[columns]), name


def test_rows_are_whole(spark, results):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = sorted(r.doc_id for r in documents.select("doc_id").collect())
    for name in ("op3", "op4", "op5", "op6", "op7", "op8", "op12"):
        frame = next(f for n, f in results.items() if n.startswith(f"{name}_"))
        assert sorted(frame["doc_id"]) == ids
    shards = next(f for n, f in results.items() if n.startswith("op6_"))
    sizes = shards.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * shards["size"].max()
    held = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).select("doc_id", "lang").toPandas()
    told = next(f for n, f in results.items() if n.startswith("op8_")).merge(held, on="doc_id")
    assert told["held_out"].all() and (told["lang"] == told["lang_pred"]).mean() >= 0.9

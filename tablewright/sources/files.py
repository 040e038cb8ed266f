"""Reading any supported file, and listing files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.formats import format_bytes
from tablewright.sources.delimited import read_delimited
from tablewright.sources.nested import read_json, read_xml
from tablewright.sources.sqldump import read_sql_dump

MAX_MB = 100

_READERS = {
    "csv": read_delimited,
    "tsv": lambda spark, path, **o: read_delimited(spark, path, sep="\t", **o),
    "txt": lambda spark, path, **o: read_delimited(spark, path, sep="\t", **o),
    "json": read_json,
    "jsonl": lambda spark, path, **o: read_json(spark, path, lines=True, **o),
    "xml": read_xml,
    "sql": read_sql_dump,
    "parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
    "orc": lambda spark, path, **o: spark.read.options(**o).orc(path),
}


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("unknown")


def list_files(spark: SparkSession, path, max_mb: int = MAX_MB) -> DataFrame:
    """Name, extension, size and a size check of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_mb * 1024 * 1024
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        extension(F.col("path")).alias("extension"),
        F.col("length").alias("size"),
        format_bytes(F.col("length")).alias("formatted"),
        "modificationTime",
        fits.alias("size_ok"),
        F.when(fits, "File size is acceptable")
        .otherwise(
            F.concat(F.lit("File size ("), format_bytes(F.col("length")), F.lit(f") exceeds maximum allowed size ({max_mb} MB)"))
        )
        .alias("size_message"),
    )


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a file, a folder or a pattern of files of one format, which is told by the extension unless named."""
    if fmt is None:
        fmt = path.rstrip("/*").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
        if fmt not in _READERS:
            listed = list_files(spark, path).where("extension <> 'unknown'").select("extension").distinct().head(2)
            fmt = listed[0]["extension"] if len(listed) == 1 else fmt
    if fmt in ("xlsx", "xls", "pdf"):
        raise ValueError(f"{fmt} containers are not decoded: export the sheets or the text, then use union_sources or table_lines")
    if fmt not in _READERS:
        raise ValueError(f"unsupported file format: {fmt}")
    return _READERS[fmt](spark, path, **options)

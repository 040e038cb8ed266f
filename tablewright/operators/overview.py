"""Whole-table views: size, composition, completeness, validation, fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.formats import as_text, format_bytes
from tablewright.operators.frequencies import cardinalities
from tablewright.operators.longform import cells, lookup, one_row_per_column, percent, ratio
from tablewright.operators.profile import complete_rows, duplicate_count
from tablewright.types import BOOLEAN, DATETIME, NUMERIC, OTHER, TEXT, col, present, type_class

# Bytes taken by one value of a fixed-size type.
FIXED_SIZES = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4,
    "timestamp": 8, "timestamp_ntz": 8,
}


def _data_bytes(field: T.StructField) -> Column:
    """Bytes of data in a cell: the fixed size of the type, or the length of the text form."""
    size = FIXED_SIZES.get(field.dataType.simpleString())
    if size is None and isinstance(field.dataType, T.DecimalType):
        size = 8 if field.dataType.precision <= 18 else 16
    if size is not None:
        return F.lit(size).cast("bigint")
    return F.coalesce(F.octet_length(as_text(col(field.name), field.dataType)), F.lit(0)).cast("bigint")


def memory_usage(df: DataFrame) -> DataFrame:
    """Bytes of data per column: ``(cid, column, row_count, bytes, formatted, percentage)``."""
    summed = cells(df, df.columns, {"b": _data_bytes}).groupBy("cid").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("b").alias("size")
    )
    full = one_row_per_column(df, df.columns, summed).select(
        "cid", "column", F.coalesce("rows", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("bytes"),
    )
    # One row per column of the schema, so a window over all of them is small.
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)))
    return full.select(
        "cid", "column", "row_count", "bytes", format_bytes(F.col("bytes")).alias("formatted"),
        percent(F.col("bytes"), total).alias("percentage"),
    )


def table_size(df: DataFrame) -> DataFrame:
    """Rows, columns, bytes, and bytes per row. One row."""
    usage = memory_usage(df).agg(F.max("row_count").alias("total_rows"), F.sum("bytes").alias("total_bytes"))
    per_row = ratio(F.col("total_bytes"), F.col("total_rows"))
    return usage.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "total_bytes",
        (F.col("total_bytes") / F.lit(1024.0 * 1024.0)).alias("total_mb"),
        format_bytes(F.col("total_bytes")).alias("total_formatted"),
        F.coalesce(per_row, F.lit(0.0)).alias("bytes_per_row"),
        format_bytes(F.coalesce(per_row, F.lit(0.0))).alias("bytes_per_row_formatted"),
    )


def type_composition(df: DataFrame) -> dict[str, int]:
    """Columns per type class, and the number of different types. Read from the schema alone."""
    kinds = [type_class(f.dataType) for f in df.schema.fields]
    counts = {k: kinds.count(k) for k in (NUMERIC, TEXT, DATETIME, BOOLEAN, OTHER)}
    return {**counts, "distinct_types": len({f.dataType.simpleString() for f in df.schema.fields})}


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One row out of several frames of one row each, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def profile_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Size, composition, missing values, complete rows and uniqueness of the table. One row."""
    counts = cardinalities(df, df.columns, exact)
    rows, distinct = F.col("row_count"), F.col("distinct")
    columns = counts.agg(
        F.sum(rows - F.col("non_null")).alias("total_missing"),
        F.sum(rows).alias("cells"),
        F.count_if(distinct == rows).alias("columns_with_all_unique"),
        F.count_if(distinct < rows).alias("columns_with_duplicates"),
        F.coalesce(F.avg(ratio(distinct, rows)), F.lit(0.0)).alias("avg_uniqueness_ratio"),
    )
    kinds = type_composition(df)
    one = side_by_side(columns, complete_rows(df), duplicate_count(df).select("duplicate_rows"))
    return one.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "duplicate_rows",
        *[F.lit(kinds[k]).cast("bigint").alias(f"{k}_columns") for k in (NUMERIC, TEXT, DATETIME, BOOLEAN, OTHER)],
        F.lit(kinds["distinct_types"]).cast("bigint").alias("distinct_types"),
        "total_missing",
        percent(F.col("total_missing"), F.col("cells")).alias("missing_pct"),
        "complete_rows",
        F.coalesce(percent(F.col("complete_rows"), F.col("total_rows")), F.lit(0.0)).alias("complete_rows_pct"),
        "columns_with_all_unique",
        "columns_with_duplicates",
        "avg_uniqueness_ratio",
    )


def validate_table(df: DataFrame, min_rows: int = 1, min_columns: int = 1) -> DataFrame:
    """``(rule, passed, detail)`` for each requirement on the table."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(present(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    rows = F.col("rows")
    empty = F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(n)) for i, n in enumerate(df.columns)]))
    width = len(df.columns)

    def rule(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), passed.alias("passed"), detail.alias("detail"))

    rules = [
        rule("not_empty", rows > 0, F.concat(rows.cast("string"), F.lit(" rows"))),
        rule("min_rows", rows >= min_rows, F.concat(rows.cast("string"), F.lit(f" rows, minimum {min_rows}"))),
        rule("min_columns", F.lit(width >= min_columns), F.lit(f"{width} columns, minimum {min_columns}")),
        rule("no_empty_columns", F.size(empty) == 0, F.concat(F.lit("empty columns: "), F.coalesce(F.nullif(F.array_join(empty, ", "), F.lit("")), F.lit("none")))),
    ]
    return counts.select(F.explode(F.array(*rules)).alias("r")).select("r.*")


def basic_info(df: DataFrame) -> DataFrame:
    """Type, missing values and bytes per column, with the shape and duplicates of the table on each row."""
    usage = memory_usage(df).select("cid", "bytes")
    counts = cardinalities(df, df.columns)
    types = lookup([f.dataType.simpleString() for f in df.schema.fields], F.col("cid"), "string")
    duplicates = duplicate_count(df).first()["duplicate_rows"]
    joined = counts.join(F.broadcast(usage), "cid")
    return joined.select(
        "cid", "column", types.alias("data_type"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        (F.col("row_count") - F.col("non_null")).alias("missing_values"), "bytes", F.lit(duplicates).cast("bigint").alias("duplicate_rows"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """A content hash that does not depend on row order: schema, row count and a folded hash of all rows. One row."""
    row_hash = F.xxhash64(*[_hashable(f) for f in df.schema.fields])
    schema = F.lit(df.schema.simpleString())
    folded = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("x"), F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return folded.select(
        F.substring(F.md5(F.concat_ws("|", schema, F.col("n").cast("string"), F.hex("x"), F.col("s").cast("string"))), 1, 16).alias("fingerprint"),
        F.col("n").alias("row_count"),
    )


def _hashable(field: T.StructField) -> Column:
    return F.to_json(F.map_entries(col(field.name))) if isinstance(field.dataType, T.MapType) else col(field.name)


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """As :func:`fingerprint`, from MD5 sums of the text form of each row, so that any engine can compute it."""
    pieces = [F.coalesce(as_text(col(f.name), f.dataType), F.lit("\\N")) for f in df.schema.fields]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *pieces)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content_sum"))


def summary_sheet(df: DataFrame, name: str, processed_on: str | None = None) -> DataFrame:
    """``(key, value)`` rows: name, rows, columns, size, and a date when one is given."""
    size = table_size(df)
    pairs = [
        ("Dataset Name", F.lit(name)),
        ("Total Rows", F.col("total_rows").cast("string")),
        ("Total Columns", F.col("total_columns").cast("string")),
        ("Memory Usage", F.col("total_formatted")),
    ]
    if processed_on is not None:
        pairs.append(("Processing Date", F.lit(processed_on)))
    entries = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]
    return size.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

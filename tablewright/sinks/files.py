"""Writing tables, reports and SQL scripts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.types import col


def _flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, for formats without nesting."""
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header in every part file; quotes are doubled."""
    layout = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    writer = _flat(df).write.mode(mode).option("timestampNTZFormat", layout)
    writer.csv(
        path, header=True, escape='"', timestampFormat=layout, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; missing values are written as nulls."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(sections: Mapping[str, DataFrame], path: str, info: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Each section as a JSON data set in its own folder."""
    tables = dict(sections) if info is None else {"info": info, **sections}
    for name, df in tables.items():
        df.write.mode(mode).json(f"{path.rstrip('/')}/{name}")


def report_sections(df: DataFrame, name: str, options: Mapping[str, str], results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All that a report of one table holds: ``info``, ``options``, ``schema``, then the results. Each has few rows."""
    spark = df.sparkSession
    info = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
    listed = spark.createDataFrame([(str(k), str(v)) for k, v in options.items()], "option string, value string").coalesce(1)
    schema = spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column string, data_type string, nullable boolean"
    ).coalesce(1)
    return {"info": info, "options": listed, "schema": schema, **results}


def report_document(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row with one JSON document. Only for sections with a row per column or rule, never for data rows."""
    parts = [
        df.select(F.struct(*map(col, df.columns)).alias("row"))
        .agg(F.to_json(F.collect_list("row"), {"ignoreNullFields": "false"}).alias("rows"))
        .select(F.lit(i).alias("place"), F.concat(F.lit(f'"{name}":'), "rows").alias("part"))
        for i, (name, df) in enumerate(sections.items())
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionAll(part)
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))["part"]
    return stacked.agg(F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}")).alias("document"))


def write_sql(script: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The lines of a script in order; the part files follow each other."""
    script.orderBy("part", "seq").select("line").write.mode(mode).text(path)

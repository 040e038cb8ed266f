"""JSON and XML documents as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.types import col


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns become dotted columns, at any depth; arrays stay cells."""

    def leaves(schema: T.StructType, path, name):
        for f in schema.fields:
            inner = path.getField(f.name) if path is not None else col(f.name)
            label = f"{name}{separator}{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                yield from leaves(f.dataType, inner, label)
            else:
                yield inner.alias(label)

    return df.select(*leaves(df.schema, None, ""))


def _record_arrays(schema: T.StructType) -> list[str]:
    return [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    ]


def _one(names: list[str], option: str) -> str | None:
    if len(names) > 1:
        raise ValueError(f"several candidates for the records, {sorted(names)}: name one with {option}")
    return names[0] if names else None


def read_json(spark: SparkSession, path, records_path: str | None = None, lines: bool | None = None) -> DataFrame:
    """A list of objects gives a row per object; an object gives the rows of its record list, or one row.

    If every line of the files is an object of its own, they are JSON Lines, split over tasks, with a row per line and
    lists as cells, however many lines there are. Other documents are one task per file. ``lines`` says which, instead
    of looking at all lines. ``records_path`` names the record list (a path with dots); a document with several lists of
    objects needs it. Invalid documents raise.
    """
    text = F.trim("value")
    kinds = spark.read.text(path).where(text != "").agg(
        F.count("*").alias("n"), F.bool_and(text.rlike(r"^\{.*\}$")).alias("objects"),
        F.bool_or(text.rlike(r"^[\[{]")).alias("opened"),
    ).first()
    if not kinds["n"]:
        raise ValueError(f"no content in {path}")
    if not kinds["opened"]:
        raise ValueError("the document is neither a list nor an object")
    lines = kinds["objects"] if lines is None else lines
    df = spark.read.json(path, multiLine=not lines, mode="FAILFAST")
    if records_path is None and not lines and _is_object(spark, path):
        records_path = _one(_record_arrays(df.schema), "records_path")
    if records_path is not None:
        value = reduce(lambda c, part: c.getField(part), records_path.split(".")[1:], col(records_path.split(".")[0]))
        df = df.select(F.explode(value).alias("record")).select("record.*")
    return flatten(df)


def _is_object(spark: SparkSession, path) -> bool:
    """Whether the documents are objects rather than lists, by their first character."""
    return spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*\{")).limit(1).count() > 0


# An element that holds another element right after its opening tag.
_PARENT = r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?(?<!/)>(?=\s*<(?![/!?]))"
_ANY_TAG = r"<([A-Za-z_][\w.-]*)"


def _row_tag(spark: SparkSession, path) -> str:
    """The only repeated element that has child elements; the root when nothing repeats. Whole documents are counted."""
    texts = spark.read.text(path, wholetext=True).select("value")
    tags = texts.select(F.explode(F.regexp_extract_all("value", F.lit(_PARENT), 1)).alias("tag"))
    repeated = [r["tag"] for r in tags.groupBy("tag").count().where("count > 1").limit(20).collect()]
    tag = _one(repeated, "row_tag")
    root = tag or texts.select(F.regexp_extract("value", _ANY_TAG, 1).alias("tag")).where("tag <> ''").agg(F.min("tag")).first()[0]
    if root is None:
        raise ValueError("no XML element found")
    return root


def read_xml(spark: SparkSession, path, row_tag: str | None = None, attribute_prefix: str = "_") -> DataFrame:
    """One row per ``row_tag`` element; attributes are columns with a prefix. Without ``row_tag`` there must be but one
    repeated element with children."""
    row_tag = row_tag or _row_tag(spark, path)
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", attribute_prefix).load(path)
    return flatten(df)

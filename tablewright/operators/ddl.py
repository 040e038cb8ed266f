"""A table as SQL text: column types and constraints found in the data, statements as rows of lines.

The data is scanned by Spark; only schema-sized results become statements on the driver. INSERT lines stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.formats import fixed, sql_literal
from tablewright.functions.names import sql_identifier, unique_names
from tablewright.functions.patterns import WHOLE_EMAIL
from tablewright.operators.frequencies import cardinalities, smallest_values
from tablewright.operators.longform import cells, lookup, one_row_per_column, percent, ratio
from tablewright.operators.ordered import OrderedRows
from tablewright.operators.profile import length_profile
from tablewright.types import NUMERIC, TEXT, col, columns_of, is_integral, number, type_class

# Limits of the type rules.
SHORT_TEXT = 10
VARCHAR_MAX = 255
VARCHAR_MEAN = 50
MEDIUM_TEXT = 1000
HEADROOM = 1.2
EMAIL_SHARE = 0.8
LOW_CARDINALITY = 0.1
HIGH_CARDINALITY = 0.9
SMALLINT = (-32768, 32767)
INTEGER = (-2147483648, 2147483647)
BATCH = 100


def _base_type(dtype: T.DataType) -> str:
    if is_integral(dtype):
        return {"bigint": "BIGINT", "int": "INTEGER"}.get(dtype.simpleString(), "SMALLINT")
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.DateType):
        return "DATE"
    named = {"float": "REAL", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}
    return named.get(dtype.simpleString(), "TEXT")


def _whole(field: T.StructField) -> Column:
    return col(field.name).cast("bigint") if is_integral(field.dataType) else F.lit(None).cast("bigint")


def _column_facts(df: DataFrame, exact: bool) -> DataFrame:
    """Counts, ranges and lengths of every column."""
    facts = cardinalities(df, df.columns, exact)
    numeric, texts = columns_of(df, NUMERIC), columns_of(df, TEXT)
    empty = {"lo": "bigint", "hi": "bigint", "never_negative": "boolean", "max_length": "bigint", "average_length": "double", "distinct_lengths": "bigint", "emails": "bigint"}
    sides = []
    if numeric:
        ranges = cells(df, numeric, {"w": _whole, "v": number}).groupBy("cid").agg(
            F.min("w").alias("lo"), F.max("w").alias("hi"), F.coalesce(F.bool_and(F.col("v") >= 0), F.lit(True)).alias("never_negative")
        )
        sides.append((one_row_per_column(df, numeric, ranges), ["lo", "hi", "never_negative"]))
    if texts:
        sides.append((length_profile(df), ["max_length", "average_length", "distinct_lengths"]))
        emails = cells(df, texts, {"e": lambda f: col(f.name).rlike(WHOLE_EMAIL)}).groupBy("cid").agg(F.count_if("e").alias("emails"))
        sides.append((one_row_per_column(df, texts, emails), ["emails"]))
    for side, wanted in sides:
        facts = facts.join(F.broadcast(side.select("column", *wanted)), "column", "left")  # schema-sized
        for name in wanted:
            empty.pop(name, None)
    return facts.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])


def column_mapping(df: DataFrame, samples: bool = True, exact: bool = True) -> DataFrame:
    """``(cid, column, sql_name, sql_type, nullable, is_unique, checks, comment, sample_values)`` for every column."""
    fields = df.schema.fields
    names = unique_names(sql_identifier(f.name) for f in fields)
    cid = F.col("cid")
    facts = _column_facts(df, exact)
    base = lookup([_base_type(f.dataType) for f in fields], cid, "string")
    rows, known, distinct = F.col("row_count"), F.col("non_null"), F.col("distinct")
    longest, mean = F.col("max_length"), F.col("average_length")
    roomy = F.floor(longest * HEADROOM).cast("bigint")
    text_type = (
        F.when(longest.isNull(), "TEXT")
        .when((F.col("distinct_lengths") == 1) & (longest <= SHORT_TEXT), F.format_string("CHAR(%d)", longest))
        .when((longest <= VARCHAR_MAX) & (mean <= VARCHAR_MEAN), F.format_string("VARCHAR(%d)", F.least(F.lit(VARCHAR_MAX), roomy)))
        .when(longest <= MEDIUM_TEXT, F.format_string("VARCHAR(%d)", roomy))
        .otherwise("TEXT")
    )
    low, high = F.col("lo"), F.col("hi")
    whole_type = (
        F.when(low.isNull(), base)
        .when((low >= SMALLINT[0]) & (high <= SMALLINT[1]), "SMALLINT")
        .when((low >= INTEGER[0]) & (high <= INTEGER[1]), "INTEGER")
        .otherwise("BIGINT")
    )
    is_text = lookup([type_class(f.dataType) == TEXT for f in fields], cid, "boolean")
    is_whole = lookup([is_integral(f.dataType) for f in fields], cid, "boolean")
    sql_name = lookup(names, cid, "string")
    email_check = F.when(
        is_text & (ratio(F.col("emails"), known) > EMAIL_SHARE),
        F.concat(F.lit("CHECK ("), sql_name, F.lit(f" ~* '{WHOLE_EMAIL}')")),
    )
    sign_check = F.when(F.col("never_negative"), F.concat(F.lit("CHECK ("), sql_name, F.lit(" >= 0)")))
    share = ratio(distinct, rows)
    remark = (
        F.when(distinct == rows, "unique values")
        .when(distinct == 1, "constant value")
        .when(share < LOW_CARDINALITY, "low cardinality")
        .when(share > HIGH_CARDINALITY, "high cardinality")
    )
    gaps = F.when(known < rows, F.concat(fixed(percent(rows - known, rows), 1), F.lit("% null")))
    mapped = facts.select(
        "cid",
        "column",
        sql_name.alias("sql_name"),
        F.when(is_text, text_type).when(is_whole, whole_type).otherwise(base).alias("sql_type"),
        (known < rows).alias("nullable"),
        (distinct == known).alias("is_unique"),
        F.array_join(F.array_compact(F.array(email_check, sign_check)), " ").alias("checks"),
        F.concat_ws("; ", gaps, remark).alias("comment"),
        rows.alias("row_count"),
        distinct.alias("distinct"),
    )
    if not samples:
        return mapped
    first = smallest_values(df, df.columns, 3)
    return mapped.join(F.broadcast(first), "cid", "left").withColumn(
        "sample_values", F.coalesce(F.array_join("samples", " | "), F.lit(""))
    ).drop("samples")


@dataclass
class SqlScript:
    """SQL text for one table."""

    df: DataFrame
    table: str
    order_by: Sequence[str] = ()
    with_checks: bool = False
    exact: bool = True

    def __post_init__(self):
        self.table = sql_identifier(self.table)
        self._mapping = None

    def mapping(self) -> list:
        """The column mapping, one row per column; computed once."""
        if self._mapping is None:
            self._mapping = column_mapping(self.df, samples=False, exact=self.exact).orderBy("cid").collect()
        return self._mapping

    def create_lines(self) -> list[str]:
        definitions = []
        for c in self.mapping():
            words = [f"    {c['sql_name']} {c['sql_type']}"]
            if not c["nullable"]:
                words.append("NOT NULL UNIQUE" if c["is_unique"] else "NOT NULL")
            if self.with_checks and c["checks"]:
                words.append(c["checks"])
            definitions.append(" ".join(words))
        lines = [f"CREATE TABLE {self.table} ("]
        lines += [d + "," for d in definitions[:-1]] + definitions[-1:] + [");"]
        comments = [
            f"COMMENT ON COLUMN {self.table}.{c['sql_name']} IS '{c['comment']}';" for c in self.mapping() if c["comment"]
        ]
        return lines + (["", "-- Column comments", *comments] if comments else [])

    def index_lines(self) -> list[str]:
        def statement(kind: str, name: str) -> str:
            return f"CREATE {kind} idx_{self.table}_{name} ON {self.table} ({name});"

        keys = [statement("UNIQUE INDEX", name) for name in self.primary_keys()]
        others = [
            statement("INDEX", c["sql_name"])
            for c in self.mapping()
            if not c["is_unique"] and c["row_count"] and LOW_CARDINALITY < c["distinct"] / c["row_count"] < HIGH_CARDINALITY
        ]
        return keys + others

    def primary_keys(self) -> list[str]:
        """Columns whose values are unique and never missing."""
        return [c["sql_name"] for c in self.mapping() if c["is_unique"] and not c["nullable"]]

    def rows_total(self) -> int:
        mapping = self.mapping()
        return mapping[0]["row_count"] if mapping else 0

    def insert_statements(self, batch: int = BATCH, limit: int | None = None) -> DataFrame:
        """``(seq, statement)``: one INSERT per batch of rows in the given order, for the whole table unless limited."""
        source = self.df
        if limit is not None:
            source = source.orderBy(*[col(c).asc_nulls_last() for c in self.order_by]).limit(limit)
        names = unique_names(sql_identifier(c) for c in self.df.columns)
        head = f"INSERT INTO {self.table} ({', '.join(names)}) VALUES"
        values = F.concat_ws(", ", *[sql_literal(col(f.name), f.dataType) for f in self.df.schema.fields])
        keyed = source.select(
            *[col(c).alias(f"k{i}") for i, c in enumerate(self.order_by)], values.alias("v")
        )
        indexed = OrderedRows(keyed, [f"k{i}" for i in range(len(self.order_by))]).with_index("idx")
        # A batch is a fixed number of rows, so a group can never grow.
        grouped = indexed.groupBy(F.floor(F.col("idx") / batch).alias("seq")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("rows")
        )
        single = F.concat(F.lit(head + " ("), F.col("rows")[0]["v"], F.lit(");"))
        many = F.concat(
            F.lit(head + "\n"),
            F.array_join(F.transform("rows", lambda r: F.concat(F.lit("    ("), r["v"], F.lit(")"))), ",\n"),
            F.lit(";"),
        )
        return grouped.select("seq", F.when(F.size("rows") == 1, single).otherwise(many).alias("statement"))

    def script(self, parts: Sequence[str] = ("create", "indexes", "inserts"), limit: int | None = None) -> DataFrame:
        """``(part, seq, line)``: the whole script in order of part and seq."""
        spark = self.df.sparkSession
        total = self.rows_total()
        fixed_lines = [(0, i, line) for i, line in enumerate([f"-- Table: {self.table}", f"-- Rows: {total:,}", ""])]
        if "create" in parts:
            fixed_lines += [(1, i, line) for i, line in enumerate(["-- Create table structure", *self.create_lines(), ""])]
        if "indexes" in parts and self.index_lines():
            fixed_lines += [(2, i, line) for i, line in enumerate(["-- Create indexes", *self.index_lines(), ""])]
        if "inserts" in parts:
            shown = total if limit is None else min(total, limit)
            note = f"-- INSERT statements for {self.table} ({shown} rows)" if total else f"-- No data available for {self.table}"
            fixed_lines.append((3, -1, note))
        lines = spark.createDataFrame(fixed_lines, "part int, seq bigint, line string")
        if "inserts" in parts and total:
            inserts = self.insert_statements(limit=limit)
            lines = lines.unionByName(inserts.select(F.lit(3).alias("part"), "seq", F.col("statement").alias("line")))
        return lines


def mapping_lines(df: DataFrame, lines: Sequence[str]) -> DataFrame:
    """Schema-sized lines as rows ``(seq, line)``."""
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "seq bigint, line string")

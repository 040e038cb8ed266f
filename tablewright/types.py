"""One place for the type classes and the missing-value rule.

A value is missing when it is NULL or, in a float column, NaN. Infinity is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = "numeric"
TEXT = "text"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    """Names of the columns whose type belongs to one of the classes, in schema order."""
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL."""
    value = col(field.name)
    return F.when(~F.isnan(value), value) if is_float(field.dataType) else value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply the missing-value rule to every float column; other columns pass unchanged."""
    if not any(is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[present(f).alias(f.name) for f in df.schema.fields])


def number(field: T.StructField) -> Column:
    """A numeric column as double, NaN as NULL."""
    return present(field).cast("double")


def epoch_micros(field: T.StructField) -> Column:
    """A date or timestamp as microseconds since 1970.

    Dates and timestamps without a zone are taken apart by calendar, so that no session time zone moves them.
    """
    value = col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(value)
    days = F.unix_date(value.cast("date")).cast("bigint") * 86_400_000_000
    if isinstance(field.dataType, T.DateType):
        return days
    seconds = F.hour(value).cast("bigint") * 3600 + F.minute(value) * 60
    return days + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")


def has_zone(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.TimestampType)


def require_columns(df: DataFrame, names) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}; the table has {df.columns}")


def fields_are(df: DataFrame, kind: str) -> list[bool]:
    """For each column, whether it belongs to the class."""
    return [type_class(f.dataType) == kind for f in df.schema.fields]

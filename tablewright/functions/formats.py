"""Numbers and values as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tablewright.types import DATETIME, NUMERIC, TEXT, is_float, type_class

_UNITS = ["B", "KB", "MB", "GB", "TB"]


def fixed(value: Column, digits: int) -> Column:
    """Fixed number of decimals without thousands separators, ties to the even digit."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def _scientific(raw: Column) -> Column:
    """``1.0E16`` as ``1e+16`` and ``2.5E-5`` as ``2.5e-05``."""
    text = F.regexp_replace(raw, r"\.0E", "E")
    for pattern, replacement in ((r"E(\d+)$", "e+$1"), (r"E-(\d)$", "e-0$1"), (r"E-(\d+)$", "e-$1")):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def float_text(value: Column) -> Column:
    """Shortest text that reads back as the same double, in plain notation from 1e-4 to 1e16."""
    raw = value.cast("double").cast("string")
    plain = F.regexp_replace(raw.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value.cast("double"))
    return (
        F.when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(_scientific(raw))
    )


def format_bytes(size: Column) -> Column:
    """Bytes as ``1.5 KB``; the largest unit is TB."""
    amount = size.cast("double")
    text = F.when(amount == 0, F.lit("0 B"))
    for power, unit in enumerate(_UNITS):
        scaled = F.concat(float_text(F.bround(amount / float(1024**power), 2)), F.lit(f" {unit}"))
        text = text.when(amount < float(1024 ** (power + 1)), scaled) if unit != _UNITS[-1] else text.otherwise(scaled)
    return F.when(amount >= 0, text).otherwise(F.lit("Unknown size"))


def format_number(value: Column, precision: int = 2) -> Column:
    """Whole numbers with thousands separators; otherwise more decimals the smaller the number."""
    number = value.cast("double")
    size = F.abs(number)
    return (
        F.when(number.isNull() | F.isnan(number), F.lit("N/A"))
        .when(number == F.floor(number), F.format_number(number, 0))
        .when(size >= 1000, F.format_number(number, precision))
        .when(size >= 1, fixed(number, precision))
        .when(size >= 0.01, fixed(number, precision + 1))
        .otherwise(F.format_string(f"%.{precision}e", number))
    )


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    """The value as an SQL literal."""
    kind = type_class(dtype)
    if is_float(dtype):
        text = F.when(~F.isnan(value), float_text(value))
    elif kind == NUMERIC:
        text = value.cast("string")
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, "TRUE").otherwise(F.when(~value, "FALSE"))
    elif isinstance(dtype, T.DateType):
        text = F.date_format(value, "''yyyy-MM-dd''")
    elif kind == DATETIME:
        whole = F.date_format(value, "''yyyy-MM-dd'T'HH:mm:ss''")
        parts = F.date_format(value, "''yyyy-MM-dd'T'HH:mm:ss.SSSSSS''")
        text = F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(parts)
    else:
        plain = value if kind == TEXT else as_text(value, dtype)
        text = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Any value as text; nested values as JSON."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    return float_text(value) if is_float(dtype) else value.cast("string")

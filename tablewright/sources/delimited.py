"""Delimited text: separator detection, quoted line breaks, missing-value tokens, types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.patterns import NULL_TOKENS
from tablewright.operators.typing import retype_text
from tablewright.types import TEXT, col, type_class

# Separators in the order in which they are tried.
SEPARATORS = [",", ";", "\t", "|"]


def detect_separator(header: str) -> str:
    """The separator that gives most fields; the earlier one on ties."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def nulls_from_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Cells that hold one of the tokens become NULL."""
    return df.select(
        *[
            F.when(~col(f.name).isin(list(tokens)), col(f.name)).alias(f.name) if type_class(f.dataType) == TEXT else col(f.name)
            for f in df.schema.fields
        ]
    )


def text_encoding(spark: SparkSession, path) -> str:
    """UTF-8 if every line of the files is valid UTF-8, otherwise ISO-8859-1, in which every byte is a character."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def _unclosed(sep: str) -> str:
    """A line on which a cell begins with a quote and does not end with one before the next separator or the line end."""
    part = re.escape(sep)
    plain, quoted = rf'(?:[^"{part}][^{part}]*+)?+', r'"(?:[^"]++|"")*+"'
    return rf'^(?:(?:{quoted}[^{part}]*+|{plain}){part})*+"(?:[^"]++|"")*+$'


def _check_lines(spark: SparkSession, path, encoding: str, sep: str) -> None:
    lines = spark.read.option("encoding", encoding).text(path)
    broken = lines.where(F.regexp_replace("value", r"\r$", "").rlike(_unclosed(sep))).limit(1).collect()
    if broken:
        raise ValueError(f"a quoted cell does not end on its line; read with multiline=True: {broken[0]['value'][:200]!r}")


def read_delimited(
    spark: SparkSession,
    path,
    sep: str | None = None,
    encoding: str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    types: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Files with one header. All cells are read as text, then tokens become NULL and columns get types.

    Every line is a row, and files stay split over tasks; a cell that opens with a quote and does not close on its line
    raises. ``multiline=True`` lets quoted cells hold line breaks; a file is then one task, because where a quoted cell
    begins cannot be told from the middle of a file. A quote inside an unquoted cell is an ordinary character. Without
    ``encoding`` the files are checked for valid UTF-8.
    """
    encoding = encoding or text_encoding(spark, path)
    first = spark.read.option("encoding", encoding).text(path).head(1)
    if not first:
        raise ValueError(f"no content in {path}")
    header = first[0]["value"].lstrip("\ufeff").rstrip("\r")
    sep = sep or detect_separator(header)
    if not multiline:
        _check_lines(spark, path, encoding, sep)
    raw = spark.read.csv(
        path, sep=sep, header=True, encoding=encoding, escape='"', mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=multiline,
        enforceSchema=False,  # a file with other headers is an error, not shifted columns
    )
    cleaned = nulls_from_tokens(raw, null_tokens)
    return retype_text(cleaned) if types else cleaned

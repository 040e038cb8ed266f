"""Naming rules for columns and SQL identifiers. They work on the schema only, never on rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from tablewright.functions.patterns import COLUMN_SYNONYMS, RESERVED_WORDS

_WORD = re.compile(r"[^\W_]+")
_WORD_OR_DASH = re.compile(r"(?:[^\W_]|-)+")


def _words(name: str) -> str:
    return "_".join(_WORD.findall(str(name).lower()))


def _hashed(name: str) -> str:
    """A stable stand-in for a name with nothing usable in it."""
    return f"column_{zlib.crc32(str(name).encode('utf-8')) % 1000}"


def _lead_with_letter(name: str) -> str:
    return f"col_{name}" if name[:1].isdigit() else name


def standard_name(name: str, synonyms: Mapping[str, Sequence[str]] = COLUMN_SYNONYMS) -> str:
    """Lower case words joined by underscores, then the standard name if the result is a known spelling."""
    plain = _words(name)
    return next((standard for standard, spellings in synonyms.items() if plain in spellings), plain)


def schema_name(name: str, position: int) -> str:
    """A database-friendly name; ``position`` names a column that has no usable characters."""
    return _lead_with_letter(_words(name)) or f"column_{position}"


def sql_identifier(name: str) -> str:
    """Like :func:`schema_name`, and never a reserved word."""
    plain = _lead_with_letter(_words(name))
    return _hashed(name) if not plain or plain in RESERVED_WORDS else plain


def sanitized_name(name: str) -> str:
    """Keeps case and dashes; other special characters become underscores."""
    return "_".join(_WORD_OR_DASH.findall(str(name))) or _hashed(name)


def unique_names(names: Iterable[str]) -> list[str]:
    """Number repeated names ``x, x_1, x_2``, skipping any number that a real column already has."""
    wanted = list(names)
    taken: set[str] = set()
    reserved = set(wanted)
    counters: dict[str, int] = {}
    result = []
    for name in wanted:
        candidate = name
        if candidate in taken:
            while candidate in taken or candidate in reserved:
                counters[name] = counters.get(name, 0) + 1
                candidate = f"{name}_{counters[name]}"
        taken.add(candidate)
        result.append(candidate)
    return result


def standardize_columns(df: DataFrame, synonyms: Mapping[str, Sequence[str]] = COLUMN_SYNONYMS) -> DataFrame:
    """Rename every column by :func:`standard_name`; no data moves."""
    return df.toDF(*unique_names(standard_name(c, synonyms) for c in df.columns))


def schema_columns(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`schema_name`."""
    return df.toDF(*unique_names(schema_name(c, i) for i, c in enumerate(df.columns)))


def sql_columns(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`sql_identifier`."""
    return df.toDF(*unique_names(sql_identifier(c) for c in df.columns))


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`sanitized_name`."""
    return df.toDF(*unique_names(sanitized_name(c) for c in df.columns))

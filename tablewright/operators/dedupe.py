"""Exact and near duplicates.

Both run in one shuffle. The keep-first rank filter becomes a group limit below the exchange: every task sends at most
one row per key, so a row copied into a third of the table reaches the reducer once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.functions.text import normalize_text
from tablewright.operators.profile import comparable
from tablewright.types import TEXT, col, columns_of, require_columns, type_class

_LONG_TEXT = 256


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows that agree in every column are kept once; nulls are equal to each other."""
    if not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        return df.dropDuplicates()
    keys = {f"__key{i}": comparable(f) for i, f in enumerate(df.schema.fields)}
    return df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)


def near_duplicate_keys(df: DataFrame, text_columns: Sequence[str], extra_keys: Sequence[str]) -> list:
    """Comparison keys: normalized texts (a SHA-256 digest when long) and the other columns as they are."""
    texts = []
    for name in text_columns:
        plain = normalize_text(col(name))
        texts.append(F.when(F.length(plain) > _LONG_TEXT, F.sha2(plain, 256)).otherwise(plain))
    return texts + [comparable(df.schema[name]) for name in extra_keys]


def drop_near_duplicates(
    df: DataFrame,
    order_by: Sequence[str],
    text_columns: Sequence[str] | None = None,
    extra_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Of rows whose normalized texts agree, keep the first by ``order_by``.

    By default all text columns are compared after normalization and all others but ``order_by`` as they are, so rows
    that differ in a number or date both stay, whatever their keys. Rows that agree in ``order_by`` too are ordered by
    the remaining columns. ``extra_keys`` names the other columns to compare; with ``[]`` the texts alone
    decide. Exact duplicates fall out in the same step.
    """
    if not order_by:
        raise ValueError("keeping the first row needs order_by columns")
    require_columns(df, order_by)
    texts = list(columns_of(df, TEXT) if text_columns is None else text_columns)
    require_columns(df, texts)
    if not texts:
        return drop_exact_duplicates(df)
    if extra_keys is None:
        extra_keys = [f.name for f in df.schema.fields if type_class(f.dataType) != TEXT and f.name not in order_by]
    keys = {f"__key{i}": key for i, key in enumerate(near_duplicate_keys(df, texts, extra_keys))}
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType) and f.name not in order_by]
    order = [col(c).asc_nulls_last() for c in (*order_by, *(c for c in sortable if c in texts))]
    first = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumns(keys).withColumn("__rank", F.row_number().over(first))
    return ranked.where("__rank = 1").select(*map(col, df.columns))


def remove_duplicates(df: DataFrame, order_by: Sequence[str] | None = None, **options) -> DataFrame:
    """Exact duplicates, then near duplicates when an order to keep the first by is known."""
    if order_by is None:
        return drop_exact_duplicates(df)
    return drop_near_duplicates(df, order_by, **options)

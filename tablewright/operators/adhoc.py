"""Ad-hoc questions about a loaded table: declarative queries, derived columns, question routing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.patterns import QUERY_PHRASES
from tablewright.types import col, columns_of, require_columns

# Functions allowed in a derived column, and in the answer to a question.
EXPRESSION_FUNCTIONS = {"abs", "greatest", "least", "length", "round", "cast", "coalesce", "int", "bigint", "double", "string", "boolean"}
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "stddev": F.stddev_samp, "distinct": F.count_distinct,
}
# Words of the expression language, and functions that Spark calls without parentheses.
_WORDS = {
    "and", "or", "not", "in", "is", "null", "true", "false", "between", "like", "case", "when", "then", "else", "end", "as",
    "int", "bigint", "double", "string", "boolean", "date", "timestamp", "decimal",
}
_BARE_CALLS = {
    "current_catalog", "current_database", "current_date", "current_schema", "current_time", "current_timestamp",
    "current_timezone", "current_user", "grouping__id", "localtimestamp", "session_user", "user",
}
_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`(?:[^`]|``)+`)|(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+)"""
    r"""|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign><=>|<>|<=|>=|!=|==|\|\||[-+*/%=<>!(),.]))"""
)


def checked_expression(text: str, columns: Sequence[str] | None = None) -> Column:
    """An SQL expression over columns that calls nothing but the allowed functions.

    The text is taken apart into literals, numbers, names and operators; anything else raises. A name before a
    parenthesis must be an allowed function, however it is quoted; any other name must be a word of the language or, if
    ``columns`` are given, a column or a field of one.
    """
    tokens, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        # Comments and lambdas.
        if not found or found["sign"] and text[found.end() - 1 : found.end() + 1] in ("--", "->", "/*"):
            raise ValueError(f"not a plain expression: {text!r}")
        tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    known = None if columns is None else {c.lower() for c in columns}
    for i, (kind, token) in enumerate(tokens):
        if kind not in ("word", "quoted"):
            continue
        called = tokens[i + 1 : i + 2] == [("sign", "(")]
        name = token.lower() if kind == "word" else token[1:-1].replace("``", "`").lower()
        after_dot = tokens[i - 1 : i] == [("sign", ".")] if i else False
        if called:
            allowed = kind == "word" and not after_dot and name in EXPRESSION_FUNCTIONS | _WORDS
        elif kind == "word" and name in _WORDS:
            allowed = True
        else:
            allowed = after_dot or (name in known if known is not None else kind == "quoted" or name not in _BARE_CALLS)
        if not allowed or name == "select":
            raise ValueError(f"not allowed in an expression: {token!r}")
    return F.expr(text)


def with_expression(df: DataFrame, name: str, text: str) -> DataFrame:
    """Add a column computed from a restricted expression over the row."""
    return df.withColumn(name, checked_expression(text, df.columns))


@dataclass
class QuerySpec:
    """What to filter, group, aggregate, sort and show. ``aggs`` maps a result name to (function, column)."""

    select: Sequence[str] = ()
    where: str | None = None
    group_by: Sequence[str] = ()
    aggs: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    order_by: Sequence[str] = ()  # a leading minus sorts descending
    limit: int | None = None

    def run(self, df: DataFrame) -> DataFrame:
        require_columns(df, [*self.select, *self.group_by])
        rows = df.where(checked_expression(self.where, df.columns)) if self.where else df
        if self.aggs or self.group_by:
            unknown = {f for f, _ in self.aggs.values()} - set(AGGREGATES)
            if unknown:
                raise ValueError(f"unknown aggregates: {sorted(unknown)}")
            made = [
                (F.count(F.lit(1)) if c == "*" else AGGREGATES[f](col(c))).alias(name) for name, (f, c) in self.aggs.items()
            ]
            keys = [col(c) for c in self.group_by]
            rows = rows.groupBy(*keys).agg(*made) if made else rows.select(*keys).distinct()
        elif self.select:
            rows = rows.select(*map(col, self.select))
        if self.order_by:
            rows = rows.orderBy(*[col(c[1:]).desc_nulls_last() if c.startswith("-") else col(c).asc_nulls_last() for c in self.order_by])
        return rows if self.limit is None else rows.limit(self.limit)


def run_sql(df: DataFrame, query: str, **args) -> DataFrame:
    """Run SQL over the table, named ``{t}`` in the text; values are passed as named parameters."""
    return df.sparkSession.sql(query, args=args or None, t=df)


def needs_query(question: Column, phrases: Sequence[str] = QUERY_PHRASES) -> Column:
    """Whether a question asks for rows or numbers rather than an explanation."""
    return F.lower(question).rlike("|".join(re.escape(p) for p in phrases))


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 100) -> DataFrame:
    """The first rows in a given order: a distributed top-n."""
    require_columns(df, order_by)
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(rows)


def select_types(df: DataFrame, *classes: str) -> DataFrame:
    """Only the columns of the given type classes."""
    return df.select(*map(col, columns_of(df, *classes)))

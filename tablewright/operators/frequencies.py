"""Value frequencies of all columns in one shuffle, and what follows from them: distinct counts, modes, samples.

Counting distinct values of many columns in one ``agg`` makes Spark expand each row once per column as well, but can
give nothing else. The frequency table costs the same shuffle, is combined on the map side (a value that fills a
third of the table arrives as one row per map task), and answers all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.formats import as_text, float_text
from tablewright.operators.longform import cells, fields_of, lookup, one_row_per_column
from tablewright.session import materialize
from tablewright.types import DATETIME, col, epoch_micros, has_zone, is_float, is_integral, present, type_class


# Texts longer than a digest are counted by digest.
_LONG_TEXT = 64
# A side of at most this many (number, digest) rows is broadcast.
_BROADCAST_ROWS = 50_000


def _is_whole(dtype: T.DataType) -> bool:
    return is_integral(dtype) or isinstance(dtype, T.BooleanType) or type_class(dtype) == DATETIME


def _whole(field: T.StructField) -> Column:
    if not _is_whole(field.dataType):
        return F.lit(None).cast("bigint")
    if type_class(field.dataType) == DATETIME:
        return epoch_micros(field)
    return present(field).cast("bigint")


def _float(field: T.StructField) -> Column:
    return present(field).cast("double") if is_float(field.dataType) else F.lit(None).cast("double")


def _string(field: T.StructField) -> Column:
    if _is_whole(field.dataType) or is_float(field.dataType):
        return F.lit(None).cast("string")
    return as_text(present(field), field.dataType)


def _digest(field: T.StructField) -> Column:
    """A short text as it is, a long one by its SHA-256, so that long texts are not shuffled."""
    text = _string(field)
    return F.when(F.length(text) > _LONG_TEXT, F.sha2(text, 256)).otherwise(text)


def _is_long(field: T.StructField) -> Column:
    return F.coalesce(F.length(_string(field)) > _LONG_TEXT, F.lit(False))


def value_frequencies(df: DataFrame, columns: Sequence[str], digests: bool = False) -> DataFrame:
    """Rows ``(cid, whole, float, string, n)``; each type has its own value column so nothing loses precision.

    The missing value is one of the rows, with all three value columns NULL. With ``digests``, long texts are replaced
    by a digest and marked in a column ``hashed``.
    """
    parts = {"whole": _whole, "float": _float, "string": _digest if digests else _string}
    if digests:
        parts["hashed"] = _is_long
    return cells(df, columns, parts).groupBy("cid", *parts).agg(F.count(F.lit(1)).alias("n"))


def has_value() -> Column:
    return F.coalesce(F.col("whole").isNotNull() | F.col("float").isNotNull() | F.col("string").isNotNull(), F.lit(False))


def value_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The value of a frequency row as text."""
    kinds = [
        "instant" if has_zone(f)
        else "time" if type_class(f.dataType) == DATETIME
        else "bool" if isinstance(f.dataType, T.BooleanType)
        else "plain"
        for f in fields_of(df, columns)
    ]
    kind = lookup(kinds, F.col("cid"), "string")
    local = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(whole / 1000000BD AS decimal(18, 6)))")
    whole = (
        F.when(kind == "instant", F.timestamp_micros("whole").cast("string"))
        .when(kind == "time", local.cast("string"))
        .when(kind == "bool", (F.col("whole") == 1).cast("string"))
        .otherwise(F.col("whole").cast("string"))
    )
    return F.coalesce(whole, float_text(F.col("float")), F.col("string"))


def cardinalities(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Rows ``(cid, column, row_count, non_null, distinct)``.

    ``exact=False`` answers from one scan with sketches of fixed size and shuffles no values at all.
    """
    if exact:
        rows = value_frequencies(df, columns, digests=True).groupBy("cid").agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(has_value(), F.col("n"))).alias("non_null"),
            F.count_if(has_value()).alias("distinct"),
        )
    else:
        digest = cells(df, columns, {"hash": lambda f: F.when(present(f).isNotNull(), F.xxhash64(as_text(present(f), f.dataType)))})
        rows = digest.groupBy("cid").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("hash").alias("non_null"),
            F.approx_count_distinct("hash", 0.02).alias("distinct"),
        )
    numbers = ["row_count", "non_null", "distinct"]
    full = one_row_per_column(df, columns, rows)
    return full.select("cid", "column", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers])


def text_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, int]]:
    """Most frequent value of each text column and its count, the smallest value on ties.

    Long texts are counted by digest. Only for columns whose winner is long, the texts behind the winning digests are
    looked up in a second scan.
    """
    counted = value_frequencies(df, columns, digests=True).where(F.col("string").isNotNull())
    levels = counted.groupBy("cid", "n").agg(
        F.min("string").alias("smallest"), F.bool_or("hashed").alias("hashed"), F.count(F.lit(1)).alias("ties")
    )
    best = levels.groupBy("cid").agg(F.max("n").alias("n"), F.max_by(F.struct("smallest", "hashed", "ties"), "n").alias("top"))
    winners = {r["cid"]: r for r in best.collect()}
    found = {columns[cid]: (r["top"]["smallest"], r["n"]) for cid, r in winners.items()}
    long_ones = [cid for cid, r in winners.items() if r["top"]["hashed"]]
    if long_ones:
        names = [columns[cid] for cid in long_ones]
        most = lookup([winners[cid]["n"] for cid in long_ones], F.col("cid"), "bigint")
        tied = value_frequencies(df, names, digests=True).where(F.col("n") == most).select("cid", "string")
        if sum(winners[cid]["top"]["ties"] for cid in long_ones) <= _BROADCAST_ROWS:
            tied = F.broadcast(tied)
        texts = cells(df, names, {"string": _digest, "text": _string})
        smallest = texts.join(tied, ["cid", "string"], "left_semi").groupBy("cid").agg(F.min("text").alias("text"))
        for r in smallest.collect():
            found[names[r["cid"]]] = (r["text"], winners[long_ones[r["cid"]]]["n"])
    return found


def moment(micros: str) -> Column:
    """Microseconds since 1970 as a timestamp without zone."""
    seconds = f"make_dt_interval(0, 0, 0, cast({micros} / 1000000BD AS decimal(18, 6)))"
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + {seconds}")


def top_error(tracked: int) -> float:
    """The share of the rows that a value outside the list of frequent values can have at most.

    A sketch that tracks that many values has a table of a power of two of places, each value may be counted wrong by 3.5
    rows in so many, and is listed when even its least possible count lies above that error.
    """
    places = 1 << math.ceil(math.log2(tracked / 0.75))
    return 2 * 3.5 / places


def verified_modes(df: DataFrame, columns: Sequence[str], tracked: int = 10_000) -> dict[str, tuple[str, int]]:
    """As :func:`text_modes`, without an exchange of all values where one value is frequent.

    A sketch of fixed size per task names the values that may be the most frequent; a second scan counts these alone. The
    result is exact if the best count lies above what any other value can have. Columns where it does not (every value is
    rare) are counted in full.
    """
    columns = list(columns)
    if not columns:
        return {}
    texts = cells(df, columns, {"string": _digest, "hashed": _is_long}).where(F.col("string").isNotNull())
    # The accumulated items are the digests; at most one in ``top_error`` rows is listed.
    sketches = texts.groupBy("cid").agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k_accumulate(string, {tracked})").alias("sketch")
    )
    listed = sketches.select("cid", "rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("top"))
    # An estimate is never too low, and too high by half the error at most.
    best = Window.partitionBy("cid")
    close = listed.withColumn("most", F.max("top.count").over(best)).where(
        F.col("top.count") >= F.col("most") - F.ceil(F.col("rows") * top_error(tracked) / 2)
    )
    candidates = materialize(close.select("cid", F.col("top.item").alias("string"), "rows"))
    # There are at most 1 / top_error candidates in a column.
    counted = texts.join(F.broadcast(candidates), ["cid", "string"]).groupBy("cid", "string").agg(
        F.count(F.lit(1)).alias("n"), F.first("hashed").alias("hashed"), F.first("rows").alias("rows")
    )
    ranked = counted.withColumn("most", F.max("n").over(best)).where(F.col("n") == F.col("most"))
    sure = materialize(ranked.where(F.col("n") > F.col("rows") * top_error(tracked)))
    winners = sure.groupBy("cid").agg(F.min("string").alias("text"), F.max("n").alias("n"), F.bool_or("hashed").alias("hashed")).collect()
    found = {columns[r["cid"]]: (r["text"], r["n"]) for r in winners}
    if any(r["hashed"] for r in winners):
        whole = cells(df, columns, {"string": _digest, "text": _string}).join(F.broadcast(sure.select("cid", "string")), ["cid", "string"])
        for r in whole.groupBy("cid").agg(F.min("text").alias("text")).collect():
            found[columns[r["cid"]]] = (r["text"], found[columns[r["cid"]]][1])
    rest = [c for c in columns if c not in found]
    return {**found, **(text_modes(df, rest) if rest else {})}


#: Columns whose bounds are found in one scan; wider tables are read in groups of columns.
_BOUNDED_COLUMNS = 40


def _sample_order(field: T.StructField) -> Column:
    """A value by which the samples of a column are ordered: numbers and times as such, other values as text."""
    return _whole(field) if _is_whole(field.dataType) else _float(field) if is_float(field.dataType) else _string(field)


def _upper_bounds(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, object]:
    """For each column a value that at least ``limit`` distinct values do not exceed, or None if all of them are wanted.

    Values are dealt by hash into twice as many classes as are wanted. The smallest values of different classes differ,
    so the ``limit``-th smallest of these is a bound, and few values lie below it. A task passes on one value per class.
    """
    bounds: dict[str, object] = {}
    classes = 2 * limit
    for at in range(0, len(columns), _BOUNDED_COLUMNS):
        group = columns[at : at + _BOUNDED_COLUMNS]
        orders = [_sample_order(f) for f in fields_of(df, group)]
        keyed = df.select(*[c for i, o in enumerate(orders) for c in (o.alias(f"v{i}"), F.pmod(F.xxhash64(o), F.lit(classes)).alias(f"h{i}"))])
        least = keyed.agg(*[F.min(F.when(F.col(f"h{i}") == k, F.col(f"v{i}"))).alias(f"m{i}_{k}") for i in range(len(group)) for k in range(classes)]).first()
        for i, name in enumerate(group):
            met = sorted(v for k in range(classes) if (v := least[f"m{i}_{k}"]) is not None)
            bounds[name] = met[limit - 1] if len(met) >= limit else None
    return bounds


def smallest_values(df: DataFrame, columns: Sequence[str], limit: int = 3) -> DataFrame:
    """The ``limit`` smallest distinct values of each column as an array of texts: ``(cid, samples)``.

    A first scan bounds them, so that the second one exchanges only values that may be among them.
    """
    columns = list(columns)
    bounds = _upper_bounds(df, columns, limit)
    order = {f.name: _sample_order(f) for f in fields_of(df, columns)}
    kept = df.select(
        *[(col(n) if bounds[n] is None else F.when(order[n] <= F.lit(bounds[n]), col(n))).alias(n) for n in columns]
    )
    rank = Window.partitionBy("cid").orderBy("whole", "float", "string")
    first = (
        value_frequencies(kept, columns)
        .where(has_value())
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= limit)
    )
    listed = first.groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("rank", value_text(df, columns).alias("value")))).alias("ranked")
    )
    return listed.select("cid", F.col("ranked.value").alias("samples"))

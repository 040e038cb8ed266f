"""Rows of an SQL dump: its INSERT statements, split over tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.functions.text import strip
from tablewright.operators.typing import retype_text
from tablewright.session import materialize
from tablewright.types import col

# Possessive quantifiers keep long texts from recursing.
_LITERAL = r"'(?:[^']++|'')*+'"
_QUOTED = rf'{_LITERAL}|"[^"]*+"|`[^`]*+`'
_COMMENT = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_TUPLE = rf"\((?:[^()']++|{_LITERAL}|\([^()]*+\))*+\)"
_ROW = rf"\(((?:[^()']++|{_LITERAL}|\([^()]*+\))*+)\)"
_FIELD = rf"((?:{_LITERAL}|\([^()]*+\)|[^,'(])++)"
_NAME = r"[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)?(\w+)[`\"\]]?"
_INSERT = rf"(?is)^\s*INSERT\s+INTO\s+{_NAME}\s*(?:\(([^)]*)\))?\s*VALUES\s*({_TUPLE}(?:\s*+,\s*+{_TUPLE})*+)\s*$"
_INSERT_NAME = rf"(?is)^\s*INSERT\s+INTO\s+{_NAME}"
_CREATE = rf"(?is)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\((.*)\)[^)]*$"
#: Different column lists that one table may be filled through; their number is checked.
_MAX_LISTS = 1000
_CONSTRAINTS = {"primary", "unique", "constraint", "foreign", "check", "key", "index"}
# What a declared type begins with if its literals are text and nothing else.
_TEXT_TYPES = ("char", "varchar", "nvarchar", "nchar", "text", "clob", "string", "uuid", "json", "enum", "longtext", "mediumtext", "tinytext")


# What a text can be inside of at some place, and how that begins: code, a literal, quoted names, a comment.
_OPENERS = ["", "'", '"', "`", "/*"]
_CLOSERS = ["", "'", '"', "`", "*/"]
_OPEN = r"""'(?:[^']++|'')*+\z|"[^"]*+\z|`[^`]*+\z|/\*(?:[^*]++|\*(?!/))*+\z"""
#: A statement with its semicolon, from the end of the one before.
_ENDED = rf"""(?s)\G((?:[^;'"`/-]++|{_QUOTED}|{_COMMENT}|/(?!\*)|-(?!-)|{_OPEN})*+);"""
#: Bytes of a block, from line to line.
BLOCK_BYTES = 1 << 20
_SPLIT, _BLOCK = ["file", "start"], ["file", "start", "block"]


def _opened(text: Column, state: int) -> Column:
    return F.concat(F.lit(_OPENERS[state]), text) if state else text


def _end_state(text: Column, state: int) -> Column:
    """What the text leaves open if it begins in ``state``: the first opening mark that no closed one explains."""
    left = F.regexp_replace(_opened(text, state), rf"(?s){_QUOTED}|{_COMMENT}", " ")
    mark = F.regexp_extract(left, r"""(?s)('|"|`|/\*)""", 1)
    end = F.coalesce(*[F.when(mark == opener, F.lit(i)) for i, opener in enumerate(_OPENERS) if i], F.lit(0))
    # What is not closed anywhere in the text stays open; few blocks hold marks of every kind.
    return F.when(text.contains(_CLOSERS[state]), end).otherwise(F.lit(state)) if state else end


def _blocks(spark: SparkSession, path, block_bytes: int) -> DataFrame:
    """(file, start, block, text): runs of whole lines of about ``block_bytes`` inside the splits in which files are read."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    before = Window.partitionBy(*_SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))
    numbered = lines.withColumn("block", F.floor(size / block_bytes).cast("long"))
    held = F.array_sort(F.collect_list(F.struct("line", "value")))
    return numbered.groupBy(*_BLOCK).agg(F.array_join(F.transform(held, lambda x: x["value"]), "\n").alias("text"))


def _block_states(blocks: DataFrame) -> DataFrame:
    """(file, start, block, state): what each block begins inside of.

    A block maps each state at its beginning to one at its end, whatever comes before it. These maps are composed: over
    the blocks of a split, then over the splits of a file, where one row stands for each. A file that ends inside a literal,
    a quoted name or a comment raises.
    """
    states = range(len(_OPENERS))
    step = F.array(*[_end_state(F.col("text"), s) for s in states])
    maps = materialize(blocks.select(*_BLOCK, step.alias("step")))
    listed = F.array_sort(F.collect_list(F.struct("block", "step")))
    same = F.array(*[F.lit(s) for s in states])

    def then(state: Column, step: Column) -> Column:
        return F.transform(state, lambda s: F.element_at(step, s + 1))

    splits = maps.groupBy(*_SPLIT).agg(listed.alias("blocks"))
    splits = splits.withColumn("step", F.aggregate("blocks", same, lambda state, x: then(state, x["step"])))
    begun = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<key: bigint, state: int>>").alias("seen"))

    def walk(entries: str, key: str, first: Column) -> Column:
        """The state before each entry, and after the last one."""
        start = F.struct(first.alias("state"), begun["seen"].alias("seen"))
        return F.aggregate(entries, start, lambda acc, x: F.struct(
            F.element_at(x["step"], acc["state"] + 1).alias("state"),
            F.concat(acc["seen"], F.array(F.struct(x[key].alias("key"), acc["state"].alias("state")))).alias("seen"),
        ))

    files = splits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "step"))).alias("splits"))
    walked = files.select("file", walk("splits", "start", F.lit(0)).alias("way"))
    ended = F.when(F.col("way.state") == 0, F.col("way.seen")).otherwise(
        F.raise_error(F.concat(F.lit("a literal or comment does not end in "), "file")).cast("array<struct<key: bigint, state: int>>")
    )
    starts = walked.select("file", F.inline(ended)).select("file", F.col("key").alias("start"), F.col("state").alias("first"))
    placed = splits.join(starts, _SPLIT).select(*_SPLIT, walk("blocks", "block", F.col("first")).alias("way"))
    return placed.select(*_SPLIT, F.inline("way.seen")).select(*_SPLIT, F.col("key").alias("block"), "state")


def _statements(spark: SparkSession, path, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, place, sql): statements without comments, cut at semicolons outside literals and comments.

    A file is read by as many tasks as it has splits. Blocks are cut once it is known what they begin inside of; a
    statement that lies in several blocks is put together again. A text that ends inside a literal or comment raises.
    """
    blocks = materialize(_blocks(spark, path, block_bytes))
    stated = blocks.join(_block_states(blocks), _BLOCK)
    state = F.col("state")
    text = F.concat(F.element_at(F.array(*map(F.lit, _OPENERS)), state + 1), "text")
    ended = F.regexp_extract_all(text, F.lit(_ENDED), 1)
    pieces = F.concat(ended, F.array(F.regexp_replace(text, _ENDED, "")))
    # What opens a block in the middle of a literal was put in front of it only to read it.
    bare = F.transform(pieces, lambda p, i: F.when(i == 0, F.substring(p, F.length(F.element_at(F.array(*map(F.lit, _OPENERS)), state + 1)) + 1, F.length(p))).otherwise(p))
    cut = materialize(stated.select(*_BLOCK, bare.alias("pieces")))
    # One row for each block of a file.
    earlier = Window.partitionBy("file").orderBy("start", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.select(*_BLOCK, (F.size("pieces") - 1).cast("long").alias("n")).select(*_BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = cut.join(bases, _BLOCK).select(
        *_BLOCK, "base", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("i", "piece")
    ).withColumn("place", F.col("base") + F.col("i"))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("last"))
    whole = placed.where(inner).select("file", "place", F.col("piece").alias("sql"))
    held = F.array_sort(F.collect_list(F.struct("start", "block", "piece")))
    joined = placed.where(~inner).groupBy("file", "place").agg(F.array_join(F.transform(held, lambda x: x["piece"]), "\n").alias("sql"))
    code = F.regexp_replace("sql", rf"(?s)({_QUOTED})|{_COMMENT}", "$1")
    return materialize(whole.unionByName(joined).select("file", "place", strip(code).alias("sql")).where("sql <> ''"))


def _names(text: str) -> list[str]:
    return [n.strip().strip('`"[]') for n in text.split(",")]


def _defined_columns(body: str) -> dict[str, str]:
    """Columns of a CREATE TABLE body and the first word of their types; commas inside parentheses do not separate."""
    flat = body
    while (simpler := re.sub(r"\([^()]*\)", "", flat)) != flat:
        flat = simpler
    words = [part.split() for part in flat.split(",") if part.split()]
    return {w[0].strip('`"[]'): w[1].lower() if len(w) > 1 else "" for w in words if w[0].lower() not in _CONSTRAINTS}


def _cell(text: Column) -> Column:
    """A field of a VALUES tuple as text; NULL stays missing."""
    plain = strip(text)
    quoted = F.replace(F.substring(plain, F.lit(2), F.length(plain) - 2), F.lit("''"), F.lit("'"))
    return F.when(plain.startswith("'"), quoted).when(F.upper(plain) != "NULL", plain)


def read_sql_dump(spark: SparkSession, path, table: str | None = None, columns: Sequence[str] | None = None, types: bool = True) -> DataFrame:
    """Rows that the dump inserts into one table: the named one, or the first that it creates, or else fills.

    Columns follow the CREATE TABLE statement, or the column lists of the INSERTs. Columns declared as text stay text,
    and so do columns without declaration that hold a quoted literal; the others get the narrowest type that reads all
    their values. An INSERT into the table that is no plain list of VALUES raises.
    """
    statements = _statements(spark, path)
    inserts = statements.select(
        "file", "place", "sql",
        F.regexp_extract("sql", _INSERT_NAME, 1).alias("name"),
        F.regexp_extract("sql", _INSERT, 2).alias("listed"),
        F.regexp_extract("sql", _INSERT, 3).alias("body"),
    ).where("name <> ''")
    created = statements.select(
        "file", "place", F.regexp_extract("sql", _CREATE, 1).alias("name"), F.regexp_extract("sql", _CREATE, 2).alias("body")
    ).where("name <> ''")

    def first(found: DataFrame, column: str) -> str | None:
        return found.agg(F.min_by(column, F.struct("file", "place"))).first()[0]

    table = table or first(created, "name") or first(inserts, "name")
    if table is None:
        raise ValueError(f"no INSERT statements found in {path}")
    mine = inserts.where(F.lower("name") == table.lower())
    definition = first(created.where(F.lower("name") == table.lower()), "body")
    lists = [r["listed"] for r in mine.select("listed").distinct().limit(_MAX_LISTS + 1).collect()]
    if len(lists) > _MAX_LISTS:
        raise ValueError(f"more than {_MAX_LISTS} different column lists: pass a cleaned dump")
    if not lists:
        raise ValueError(f"no INSERT statements for table {table!r} in {path}")
    declared = _defined_columns(definition) if definition else {}
    defined = list(declared)
    if columns is None:
        columns = defined or list(dict.fromkeys(n for text in sorted(lists) if text for n in _names(text)))
    if not columns:
        raise ValueError("the dump names no columns: pass them")
    body = F.when(F.col("body") != "", F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("not a plain list of VALUES: "), F.substring("sql", 1, 200))).cast("string")
    )
    rows = mine.select("listed", F.explode(F.regexp_extract_all(body, F.lit(_ROW), 1)).alias("row"))
    fields = rows.select("listed", F.regexp_extract_all("row", F.lit(_FIELD), 1).alias("cells"))

    def value(name: str) -> Column:
        places = {}
        for text in lists:
            order = _names(text) if text else (defined or list(columns))
            if name in order:
                places[text] = order.index(name)
        cell = F.lit(None).cast("string")
        for text, place in places.items():
            cell = F.when(F.col("listed") == text, F.try_element_at("cells", F.lit(place + 1))).otherwise(cell)
        return strip(cell).alias(name)

    raw = fields.select(*[value(n) for n in columns])
    flat = raw.select(*[_cell(col(n)).alias(n) for n in columns])
    if not types:
        return flat
    open_columns = [n for n in columns if n not in declared]
    quoted = raw.agg(*[F.bool_or(F.coalesce(col(n).startswith("'"), F.lit(False))).alias(n) for n in open_columns]).first() if open_columns else {}
    kept = {n for n in columns if declared.get(n, "").split("(")[0] in _TEXT_TYPES or (n in open_columns and quoted[n])}
    return retype_text(flat, [n for n in columns if n not in kept]) if len(kept) < len(columns) else flat

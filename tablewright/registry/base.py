"""Registration, table loading, and the derived views that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Views with dirt in them, as text that both engines run. Every view holds every row of its table.
VIEWS = {
    # Gaps in three types, and outliers.
    "orders_dirty": """
        SELECT o_orderkey, o_custkey,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20
            ELSE o_totalprice END AS o_totalprice,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
          o_orderpriority FROM {orders}""",
    # Every part again as an exact copy, and again as a near copy under another key.
    "part_copies": """
        SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}
        UNION ALL SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}
        UNION ALL SELECT p_partkey + 1000000, concat('  ', upper(p_name), '! '), p_brand, p_type, p_size,
          p_retailprice FROM {part}""",
    # One column per kind of personal data.
    "contacts": """
        SELECT c_custkey,
          concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') AS email_address,
          concat('555-', substr(c_name, 13, 3), '-', substr(c_name, 15, 4)) AS phone,
          concat(substr(c_name, 10, 3), '-', substr(c_name, 13, 2), '-', substr(c_name, 15, 4)) AS ssn,
          concat('4000 1234 ', substr(c_name, 11, 4), ' ', substr(c_name, 15, 4)) AS card,
          concat('40001234', substr(c_name, 11, 4), substr(c_name, 15, 4)) AS card_raw,
          concat('10.0.', CAST(c_custkey % 256 AS VARCHAR(3)), '.7') AS ip,
          c_mktsegment AS note FROM {customer}""",
    # Text that holds numbers, dates, or words.
    "typed_text": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS int_text,
          concat(CAST(o_orderkey AS VARCHAR(20)), '.5') AS dbl_text,
          concat('2024-01-', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(2)), 2, '0')) AS date_text,
          CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS mostly_int,
          o_orderpriority AS word FROM {orders}""",
    # A table inside prose.
    "text_tables": """
        SELECT o_orderkey AS doc_id, concat('Report ', CAST(o_orderkey AS VARCHAR(20)), chr(10),
          'key|status|priority', chr(10), CAST(o_custkey AS VARCHAR(20)), '|', o_orderstatus, '|',
          o_orderpriority) AS body FROM {orders}""",
    # A constant column and one without values.
    "consts": """
        SELECT l_orderkey, l_linenumber, l_quantity, CAST(5 AS DOUBLE) AS konst, CAST(NULL AS DOUBLE) AS empty
        FROM {lineitem}""",
    # Four groups on a line, far apart beside what tells their rows apart. Every line item twice.
    "planted": """
        SELECT 1000 * (l_orderkey % 4) + l_discount AS u, 700 * (l_orderkey % 4) + 0.01 * (l_linenumber % 3) AS v FROM {lineitem}
        UNION ALL SELECT 1000 * (l_orderkey % 4) + l_discount, 700 * (l_orderkey % 4) + 0.01 * (l_linenumber % 3) FROM {lineitem}""",
    # Few rows, mostly empty texts.
    "sparse": """
        SELECT n_nationkey, CASE WHEN n_nationkey % 9 = 0 THEN n_name END AS name,
          CASE WHEN n_nationkey % 8 = 0 THEN concat(n_name, '; ', n_name, '; ', n_name) END AS note FROM {nation}""",
    # A flag with gaps.
    "flags": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 200000 END AS is_big
        FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})


def with_views(sql: str) -> str:
    """Put the views that a query mentions in front of it."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def query(sql: str | None = None):
    """Register the function under its own name; ``sql`` gives the same rows."""

    def register(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all doubles, so that engines which add in another order agree."""
    return df.select(
        *[
            # Adding zero turns a negative zero into a plain one.
            (F.round(F.col(f"`{n}`"), special.get(n, digits)) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def union_all(template: str, names) -> str:
    """One SELECT per column name."""
    return "\nUNION ALL ".join(template.replace("<c>", n) for n in names)

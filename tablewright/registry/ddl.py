"""Tables as SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.ddl import SqlScript, column_mapping, mapping_lines
from tablewright.registry.base import query, table

ORDERS = {
    "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "DOUBLE PRECISION",
    "o_orderdate": "TIMESTAMP", "o_orderpriority": "text",
}
PART = {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "DOUBLE PRECISION"}
CONTACTS = {"c_custkey": "whole"} | {c: "text" for c in ("email_address", "phone", "ssn", "card", "card_raw", "ip", "note")}
DOCUMENTS = {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"}


def _type_sql(c: str, kind: str) -> str:
    if kind == "whole":
        return (
            f"CASE WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'SMALLINT' "
            f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END"
        )
    if kind == "text":
        n = f"max(length({c}))"
        return (
            f"CASE WHEN count(DISTINCT length({c})) = 1 AND {n} <= 10 THEN 'CHAR(' || {n} || ')' "
            f"WHEN {n} <= 255 AND avg(length({c})) <= 50 THEN 'VARCHAR(' || least(255, floor({n} * 1.2::DOUBLE)::BIGINT) || ')' "
            f"WHEN {n} <= 1000 THEN 'VARCHAR(' || floor({n} * 1.2::DOUBLE)::BIGINT || ')' ELSE 'TEXT' END"
        )
    return f"'{kind}'"


def _checks_sql(c: str, kind: str) -> str:
    if kind == "text":
        return (
            f"CASE WHEN avg(regexp_matches({c}, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$')::INTEGER) > 0.8 THEN "
            f"'CHECK ({c} ~* ''^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$'')' ELSE '' END"
        )
    if kind == "TIMESTAMP":
        return "''"
    return f"CASE WHEN coalesce(min({c}) >= 0, true) THEN 'CHECK ({c} >= 0)' ELSE '' END"


def _mapping_sql(t: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT {i} AS place, '{c}' AS "column", '{c}' AS sql_name, {_type_sql(c, kind)} AS sql_type, count({c}) < count(*) AS nullable,
        count(DISTINCT {c}) = count({c}) AS is_unique, {_checks_sql(c, kind)} AS checks,
        concat_ws('; ', CASE WHEN count({c}) < count(*) THEN printf('%.1f', 100.0 * (count(*) - count({c})) / count(*)) || '% null' END,
          CASE WHEN count(DISTINCT {c}) = count(*) THEN 'unique values' WHEN count(DISTINCT {c}) = 1 THEN 'constant value'
            WHEN count(DISTINCT {c})::DOUBLE / count(*) < 0.1 THEN 'low cardinality'
            WHEN count(DISTINCT {c})::DOUBLE / count(*) > 0.9 THEN 'high cardinality' END) AS comment,
        count(*) AS row_count, count(DISTINCT {c}) AS n_distinct FROM {t}"""
        for i, (c, kind) in enumerate(columns.items())
    )


def _samples_sql(t: str, columns) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v::VARCHAR, ' | ' ORDER BY v) AS sample_values
        FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)"""
        for c in columns
    )


def _full_mapping_sql(t: str, columns: dict[str, str]) -> str:
    shown = '"column", sql_name, sql_type, nullable, is_unique, checks, comment, row_count, n_distinct'
    return f"""WITH m AS ({_mapping_sql(t, columns)}), s AS ({_samples_sql(t, columns)})
    SELECT {shown}, sample_values FROM m JOIN s USING ("column")"""


def _mapping(spark, sf_dir, name, columns=None):
    df = table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    return column_mapping(df).drop("cid").withColumnRenamed("distinct", "n_distinct")


@query(_full_mapping_sql("orders_dirty", ORDERS))
def column_mapping_orders(spark, sf_dir):
    return _mapping(spark, sf_dir, "orders_dirty")


@query(_full_mapping_sql("part", PART))
def column_mapping_part(spark, sf_dir):
    return _mapping(spark, sf_dir, "part")


@query(_full_mapping_sql("contacts", CONTACTS))
def column_mapping_contacts(spark, sf_dir):
    return _mapping(spark, sf_dir, "contacts")


@query(_full_mapping_sql("documents", DOCUMENTS))
def column_mapping_documents(spark, sf_dir):
    return _mapping(spark, sf_dir, "documents")


def _create_sql(t: str, name: str, columns: dict[str, str]) -> str:
    last = len(columns) - 1
    return f"""WITH m AS ({_mapping_sql(t, columns)}),
    c AS (SELECT row_number() OVER (ORDER BY place) AS k, sql_name, comment FROM m WHERE comment <> '')
    SELECT 0::BIGINT AS seq, 'CREATE TABLE {name} (' AS line
    UNION ALL SELECT place + 1, '    ' || sql_name || ' ' || sql_type || CASE WHEN NOT nullable THEN ' NOT NULL' ELSE '' END
      || CASE WHEN is_unique AND NOT nullable THEN ' UNIQUE' ELSE '' END || CASE WHEN place < {last} THEN ',' ELSE '' END FROM m
    UNION ALL SELECT {last + 2}, ');'
    UNION ALL SELECT {last + 3}, '' WHERE EXISTS (SELECT 1 FROM c) UNION ALL SELECT {last + 4}, '-- Column comments' WHERE EXISTS (SELECT 1 FROM c)
    UNION ALL SELECT {last + 4} + k, 'COMMENT ON COLUMN {name}.' || sql_name || ' IS ''' || comment || ''';' FROM c"""


@query(_create_sql("orders_dirty", "orders_dirty", ORDERS))
def create_table_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return mapping_lines(df, SqlScript(df, "Orders Dirty").create_lines())


@query(_create_sql("part", "part", PART))
def create_table_part(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return mapping_lines(df, SqlScript(df, "part").create_lines())


def _keys_sql(t: str, columns: dict[str, str]) -> str:
    return f"""WITH m AS ({_mapping_sql(t, columns)})
    SELECT row_number() OVER (ORDER BY place) - 1 AS seq, sql_name AS line FROM m WHERE is_unique AND NOT nullable"""


@query(_keys_sql("orders_dirty", ORDERS))
def primary_keys_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return mapping_lines(df, SqlScript(df, "orders").primary_keys())


def _index_sql(t: str, name: str, columns: dict[str, str]) -> str:
    return f"""WITH m AS ({_mapping_sql(t, columns)}), i AS (
    SELECT 0 AS part, place, 'CREATE UNIQUE INDEX idx_{name}_' || sql_name || ' ON {name} (' || sql_name || ');' AS line FROM m
      WHERE is_unique AND NOT nullable
    UNION ALL SELECT 1, place, 'CREATE INDEX idx_{name}_' || sql_name || ' ON {name} (' || sql_name || ');' FROM m
      WHERE NOT is_unique AND n_distinct::DOUBLE / row_count > 0.1 AND n_distinct::DOUBLE / row_count < 0.9)
    SELECT row_number() OVER (ORDER BY part, place) - 1 AS seq, line FROM i"""


@query(_index_sql("orders_dirty", "orders", ORDERS))
def index_suggestions_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return mapping_lines(df, SqlScript(df, "orders").index_lines())


@query(_index_sql("part", "part", PART))
def index_suggestions_part(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return mapping_lines(df, SqlScript(df, "part").index_lines())


_ORDER_VALUES = """concat_ws(', ', o_orderkey::VARCHAR, o_custkey::VARCHAR,
    coalesce('''' || replace(o_orderstatus, '''', '''''') || '''', 'NULL'), coalesce(o_totalprice::VARCHAR, 'NULL'),
    coalesce('''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '''', 'NULL'), '''' || replace(o_orderpriority, '''', '''''') || '''')"""


def _insert_sql(t: str, name: str, columns, values: str, key: str, batch: int = 100) -> str:
    head = f"INSERT INTO {name} ({', '.join(columns)}) VALUES"
    return f"""WITH r AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS idx, {values} AS v FROM {t})
    SELECT idx // {batch} AS seq, CASE WHEN count(*) = 1 THEN '{head} (' || any_value(v) || ');'
      ELSE '{head}' || chr(10) || string_agg('    (' || v || ')', ',' || chr(10) ORDER BY idx) || ';' END AS statement
    FROM r GROUP BY 1"""


@query(_insert_sql("orders_dirty", "orders", ORDERS, _ORDER_VALUES, "o_orderkey"))
def insert_statements_orders(spark, sf_dir):
    return SqlScript(table(spark, sf_dir, "orders_dirty"), "orders", ["o_orderkey"]).insert_statements()


_TEXT_VALUES = "concat_ws(', ', item_id::VARCHAR, '''' || replace(text, '''', '''''') || '''')"


@query(_insert_sql("benchmark", "benchmark", ["item_id", "text"], _TEXT_VALUES, "item_id", 1))
def insert_statements_benchmark(spark, sf_dir):
    return SqlScript(table(spark, sf_dir, "benchmark"), "benchmark", ["item_id"]).insert_statements(batch=1)


@query(
    "SELECT seq, statement FROM ("
    + _insert_sql("(SELECT * FROM orders_dirty ORDER BY o_orderkey LIMIT 5)", "orders", ORDERS, _ORDER_VALUES, "o_orderkey", 1)
    + ")"
)
def sample_inserts_orders(spark, sf_dir):
    return SqlScript(table(spark, sf_dir, "orders_dirty"), "orders", ["o_orderkey"]).insert_statements(batch=1, limit=5)


@query()
def sql_script_orders(spark, sf_dir):
    script = SqlScript(table(spark, sf_dir, "orders_dirty"), "orders", ["o_orderkey"], with_checks=True).script()
    return script.select("part", "seq", F.col("line"))

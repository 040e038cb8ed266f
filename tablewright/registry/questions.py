"""Ad-hoc queries, derived columns, previews, question routing, and value formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.formats import fixed, format_bytes, format_number, sql_literal
from tablewright.functions.patterns import QUERY_PHRASES
from tablewright.functions.text import display_text
from tablewright.operators.adhoc import QuerySpec, needs_query, preview, run_sql, select_types, with_expression
from tablewright.registry.base import query, rounded, table
from tablewright.types import NUMERIC

_PHRASES = "|".join(QUERY_PHRASES)


@query(f"SELECT conv_id, turn, role, regexp_matches(lower(text), '{_PHRASES}') AS needs_query FROM conversations")
def question_routing(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations")
    return asked.select("conv_id", "turn", "role", needs_query(F.col("text")).alias("needs_query"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_orders(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 100)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_columns_lineitem(spark, sf_dir):
    return select_types(table(spark, sf_dir, "lineitem"), NUMERIC)


@query(
    """SELECT o_orderkey, round(o_totalprice, 1) AS rounded, abs(o_custkey - 500) AS gap, length(o_orderpriority) AS width,
    greatest(o_orderkey, o_custkey) AS larger, CAST(o_totalprice AS BIGINT) > 200000 AS is_big FROM orders"""
)
def derived_columns_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    wanted = {
        "rounded": "round(o_totalprice, 1)",
        "gap": "abs(o_custkey - 500)",
        "width": "cast(length(o_orderpriority) as bigint)",
        "larger": "greatest(o_orderkey, o_custkey)",
        "is_big": "cast(round(o_totalprice) as bigint) > 200000",
    }
    for name, text in wanted.items():
        df = with_expression(df, name, text)
    return df.select("o_orderkey", *wanted)


@query(
    """SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderstatus = 'F'
    GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 25"""
)
def top_customers_by_spend(spark, sf_dir):
    spec = QuerySpec(
        where="o_orderstatus = 'F'",
        group_by=["o_custkey"],
        aggs={"orders": ("count", "*"), "spent": ("sum", "o_totalprice")},
        order_by=["-spent", "o_custkey"],
        limit=25,
    )
    return rounded(spec.run(table(spark, sf_dir, "orders")), 2)


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 3) AS avg_price,
    min(l_discount) AS min_discount, max(l_discount) AS max_discount, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2"""
)
def lineitem_by_status(spark, sf_dir):
    spec = QuerySpec(
        group_by=["l_returnflag", "l_linestatus"],
        aggs={
            "lines": ("count", "*"), "quantity": ("sum", "l_quantity"), "avg_price": ("avg", "l_extendedprice"),
            "min_discount": ("min", "l_discount"), "max_discount": ("max", "l_discount"), "parts": ("distinct", "l_partkey"),
        },
    )
    return rounded(spec.run(table(spark, sf_dir, "lineitem")), 3)


@query("SELECT event_id, user_id, value FROM events WHERE value > 100 ORDER BY value DESC, event_id LIMIT 50")
def highest_events(spark, sf_dir):
    spec = QuerySpec(["event_id", "user_id", "value"], "value > 100", order_by=["-value", "event_id"], limit=50)
    return spec.run(table(spark, sf_dir, "events"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events WHERE value >= 10 GROUP BY event_type"""
)
def sql_over_events(spark, sf_dir):
    text = "SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM {t} WHERE value >= :least GROUP BY event_type"
    return rounded(run_sql(table(spark, sf_dir, "events"), text, least=10), 4)


@query(
    """SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN round_even(b::DOUBLE, 2)::VARCHAR || ' B'
    WHEN b < 1048576 THEN round_even(b / 1024.0::DOUBLE, 2)::VARCHAR || ' KB' ELSE round_even(b / 1048576.0::DOUBLE, 2)::VARCHAR || ' MB' END
    AS shown FROM (SELECT doc_id, strlen(text) AS b FROM documents)"""
)
def formatted_document_sizes(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", format_bytes(F.octet_length("text")).alias("shown"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT)
    WHEN v >= 1000 THEN format('{:,.2f}', v) WHEN v >= 1 THEN format('{:.2f}', v)
    WHEN v >= 0.01 THEN format('{:.3f}', v) ELSE format('{:.2e}', v) END AS shown_price,
    CASE WHEN l_discount = 0 THEN '0' ELSE format('{:.3f}', l_discount) END AS shown_discount
    FROM (SELECT *, l_extendedprice AS v FROM lineitem)"""
)
def formatted_prices(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        format_number(F.col("l_extendedprice")).alias("shown_price"), format_number(F.col("l_discount")).alias("shown_discount"),
    )


@query(
    r"""SELECT doc_id, CASE WHEN length(t) > 100 THEN left(t, 97) || '...' ELSE t END AS shown
    FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', '', 'g') AS t FROM documents)"""
)
def display_text_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", display_text(F.col("text")).alias("shown"))


@query(
    """SELECT p_partkey, p_partkey::VARCHAR AS key_literal, '''' || replace(p_name, '''', '''''') || '''' AS name_literal,
    p_retailprice::VARCHAR AS price_literal FROM part"""
)
def sql_literals_part(spark, sf_dir):
    df = table(spark, sf_dir, "part")

    def literal(name: str):
        return sql_literal(F.col(name), df.schema[name].dataType)

    return df.select(
        "p_partkey", literal("p_partkey").alias("key_literal"), literal("p_name").alias("name_literal"),
        literal("p_retailprice").alias("price_literal"),
    )


@query("SELECT c_custkey, printf('%.1f', c_acctbal) AS shown FROM customer")
def fixed_decimals_customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fixed(F.col("c_acctbal"), 1).alias("shown"))

"""Files written from the tables and read back, and tables inside text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.ddl import SqlScript
from tablewright.plans.analysis import AnalysisPlan
from tablewright.registry.base import query, table
from tablewright.registry.profiling import _ORDER_TYPES
from tablewright.session import scratch_path
from tablewright.sinks.files import report_document, report_sections, write_csv, write_json, write_sql
from tablewright.sources.files import read_any
from tablewright.sources.texttables import table_from_text

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders_dirty"


@query(_ORDERS)
def csv_round_trip_orders(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    write_csv(table(spark, sf_dir, "orders_dirty"), path)
    return read_any(spark, path, "csv")


@query("SELECT item_id, text FROM benchmark")
def csv_round_trip_texts(spark, sf_dir):
    path = scratch_path(spark, "benchmark-csv")
    write_csv(table(spark, sf_dir, "benchmark"), path)
    return read_any(spark, path, "csv", multiline=True)


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def csv_round_trip_documents(spark, sf_dir):
    path = scratch_path(spark, "documents-csv")
    write_csv(table(spark, sf_dir, "documents"), path)
    return read_any(spark, path, "csv", multiline=True).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def tsv_round_trip_part(spark, sf_dir):
    path = scratch_path(spark, "part-tsv")
    table(spark, sf_dir, "part").write.csv(path, header=True, sep="\t")
    return read_any(spark, path, "tsv")


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_round_trip_customer(spark, sf_dir):
    path = scratch_path(spark, "customer-json")
    write_json(table(spark, sf_dir, "customer"), path)
    return read_any(spark, path, "json").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    """SELECT n_nationkey::BIGINT AS "key", n_name AS "place.name", n_regionkey::BIGINT AS "place.region.key" FROM nation"""
)
def nested_json_nation(spark, sf_dir):
    path = scratch_path(spark, "nation-json")
    region = F.struct(F.col("n_regionkey").alias("key"))
    nested = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), region.alias("region")).alias("place")
    )
    nested.write.json(path)
    return read_any(spark, path, "json")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def xml_round_trip_supplier(spark, sf_dir):
    path = scratch_path(spark, "supplier-xml")
    table(spark, sf_dir, "supplier").write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return read_any(spark, path, "xml").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(_ORDERS)
def sql_dump_round_trip_orders(spark, sf_dir):
    path = scratch_path(spark, "orders-sql")
    write_sql(SqlScript(table(spark, sf_dir, "orders_dirty"), "orders", ["o_orderkey"]).script(), path)
    return read_any(spark, path, "sql")


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def sql_dump_round_trip_texts(spark, sf_dir):
    path = scratch_path(spark, "benchmark-sql")
    write_sql(SqlScript(table(spark, sf_dir, "benchmark"), "benchmark", ["item_id"]).script(), path)
    return read_any(spark, path, "sql").select("item_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, 1::BIGINT AS row_number, split_part(line, '|', 1) AS key, split_part(line, '|', 2) AS status, "
       "split_part(line, '|', 3) AS priority FROM (SELECT doc_id, split_part(body, chr(10), 3) AS line FROM text_tables)")
def text_table_rows(spark, sf_dir):
    return table_from_text(table(spark, sf_dir, "text_tables"), "body", ["doc_id"], ["key", "status", "priority"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '" pipe' ELSE p_name END AS p_name, p_brand FROM part""")
def csv_stray_quotes_part(spark, sf_dir):
    path = scratch_path(spark, "stray-csv")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit('" pipe'))).otherwise(F.col("p_name"))
    lines = table(spark, sf_dir, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), name, "p_brand").alias("value"))
    header = spark.sql("SELECT 'p_partkey,p_name,p_brand' AS value")
    # One file, the header first.
    header.withColumn("n", F.lit(0)).unionAll(lines.withColumn("n", F.lit(1))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return read_any(spark, path, "csv")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, lpad(n_nationkey::VARCHAR, 5, '0') AS code, n_name FROM nation")
def sql_dump_two_tables_crlf(spark, sf_dir):
    """A dump with two tables, CRLF line ends, comments, several statements in a line and codes that look like numbers."""
    path = scratch_path(spark, "two-sql")
    nation = table(spark, sf_dir, "nation").select(
        F.format_string(
            "/* nation; ' */ INSERT INTO zz VALUES (%d, '%s', '%s'); INSERT INTO aa (x) VALUES (%d);\r",
            "n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 5, "0"), "n_name", "n_nationkey",
        ).alias("value")
    )
    create = spark.sql("SELECT 'CREATE TABLE zz (n_nationkey INT, code TEXT, n_name VARCHAR(30)); CREATE TABLE aa (x INT); -- it''s\\r' AS value")
    create.withColumn("n", F.lit(0)).unionAll(nation.withColumn("n", F.lit(1))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return read_any(spark, path, "sql")


@query("SELECT count(*) AS documents, max(o_orderkey) AS top, 2 AS columns FROM orders")
def json_single_row_lines(spark, sf_dir):
    """A JSON Lines file of one row: its list stays a cell, as it would beside other rows."""
    path = scratch_path(spark, "single-json")
    keys = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("top"), F.count("*").alias("n"))
    tags = F.array(F.struct(F.lit("a").alias("k")), F.struct(F.lit("b").alias("k")))
    keys.select("top", "n").withColumn("tags", tags).drop("n").coalesce(1).write.json(path)
    read = read_any(spark, path, "json")
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("documents"))
    return n.crossJoin(read.agg(F.max("top").alias("top"), F.lit(len(read.columns)).alias("columns")))


@query("SELECT p_partkey AS k, p_name AS name FROM part")
def json_late_records(spark, sf_dir):
    """The record list comes after hundreds of lines of other content."""
    path = scratch_path(spark, "late-json")
    part = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))).alias("row"))
    head = spark.range(250).select(F.col("id").alias("n"), F.concat(F.lit('"m'), "id", F.lit('": 1,')).alias("value"))
    opening = spark.sql("SELECT -1L AS n, '{\"meta\": {' AS value UNION ALL SELECT 250L, '\"m\": 1}, \"rows\": [' UNION ALL SELECT 1L << 60, '{\"k\": null}]}'")
    rows = part.select(F.lit(251).cast("long").alias("n"), F.concat("row", F.lit(",")).alias("value"))
    opening.unionByName(head).unionByName(rows).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return read_any(spark, path, "json").where("k IS NOT NULL")


@query("SELECT s_suppkey, s_name FROM supplier")
def xml_long_header(spark, sf_dir):
    """Hundreds of other elements stand before the records, which are named."""
    path = scratch_path(spark, "header-xml")
    records = table(spark, sf_dir, "supplier").select(
        F.lit(1).alias("n"), F.format_string("<rec><s_suppkey>%d</s_suppkey><s_name>%s</s_name></rec>", "s_suppkey", "s_name").alias("value")
    )
    head = spark.range(300).select(F.lit(0).alias("n"), F.lit("<p><i>x</i></p>").alias("value"))
    ends = spark.sql("SELECT -1 AS n, '<d>' AS value UNION ALL SELECT 2, '</d>'")
    ends.unionByName(head).unionByName(records).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return read_any(spark, path, "xml", row_tag="rec")


_REPORT_TEXT = """SELECT '$.' || key || '[' || place || '].' || field AS path, value FROM (
    SELECT 'info' AS key, 0 AS place, 'name' AS field, 'orders' AS value UNION ALL SELECT 'info', 0, 'rows', count(*)::VARCHAR FROM orders_dirty
    UNION ALL SELECT 'info', 0, 'columns', '6' UNION ALL SELECT 'options', 0, 'option', 'order_by' UNION ALL SELECT 'options', 0, 'value', 'o_orderkey'
    UNION ALL SELECT 'schema', p, 'column', c FROM s UNION ALL SELECT 'schema', p, 'data_type', t FROM s
    UNION ALL SELECT 'columns', p, 'null_count', n::VARCHAR FROM s)"""


@query(
    """WITH s AS ("""
    + " UNION ALL ".join(
        f"SELECT {i} AS p, '{c}' AS c, '{t}' AS t, count(*) - count({c}) AS n FROM orders_dirty" for i, (c, t) in enumerate(_ORDER_TYPES.items())
    )
    + ") " + _REPORT_TEXT
)
def report_document_orders(spark, sf_dir):
    """The whole report (info, options, schema, all results of the analysis) as one document, and what is read back from it."""
    df = table(spark, sf_dir, "orders_dirty")
    plan = AnalysisPlan(df, tie_break=["o_orderkey"])
    document = report_document(report_sections(df, "orders", {"order_by": "o_orderkey"}, {**plan.sections, "insights": plan.insights()}))
    fields = [("info", 0, f) for f in ("name", "rows", "columns")] + [("options", 0, f) for f in ("option", "value")]
    fields += [(key, i, f) for i in range(len(df.columns)) for key, f in (("schema", "column"), ("schema", "data_type"), ("columns", "null_count"))]
    paths = [f"$.{key}[{i}].{f}" for key, i, f in fields]
    return document.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("path"), F.get_json_object("document", p).alias("value")) for p in paths
    ])).alias("r")).select("r.*")

"""Names, duplicates, combination, missing values, types, outliers, masks, and the whole cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import names as naming
from tablewright.functions.patterns import PII_PATTERNS
from tablewright.functions.text import normalize_text
from tablewright.operators import combine, dedupe, privacy
from tablewright.operators.missing import MissingValueFiller
from tablewright.operators.outliers import OutlierCapper
from tablewright.operators.typing import infer_types, retype_text
from tablewright.plans.cleaning import CleaningOptions, CleaningPlan
from tablewright.registry.base import query, rounded, table, union_all

# ---- names -------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, o_custkey AS id_1, o_orderstatus AS order_status, o_totalprice AS price,
    o_orderdate AS date, o_orderpriority AS priority_level FROM orders"""
)
def standardized_names_orders(spark, sf_dir):
    messy = table(spark, sf_dir, "orders").toDF("Key", " uid ", "Order  Status!", "Amount", "Created-At", "__priority (level)__")
    return naming.standardize_columns(messy)


@query(
    """SELECT try_cast(int_text AS BIGINT) AS col_1st_value, try_cast(dbl_text AS DOUBLE) AS dbl_text,
    try_cast(date_text AS DATE)::VARCHAR AS date_text, mostly_int AS column_3, word AS word FROM typed_text"""
)
def normalized_schema_typed(spark, sf_dir):
    messy = table(spark, sf_dir, "typed_text").toDF("1st value", "Dbl.Text", "date-text", "!!!", "WORD")
    return retype_text(naming.schema_columns(messy)).withColumn("date_text", F.col("date_text").cast("string"))


@query(
    """SELECT o_orderkey AS column_680, o_custkey AS customer_id, o_orderstatus AS col_2nd_status,
    o_totalprice AS total, o_orderdate AS order_date, o_orderpriority AS column_742 FROM orders"""
)
def sql_identifiers_orders(spark, sf_dir):
    messy = table(spark, sf_dir, "orders").toDF("order", "Customer ID", "2nd status", "total", "order_date", "???")
    return naming.sql_columns(messy)


@query(
    """SELECT c_custkey AS "Cust-Key", c_name AS "Full_Name", c_nationkey AS "nation", c_acctbal AS "Balance_USD",
    c_mktsegment AS "segment" FROM customer"""
)
def sanitized_names_customer(spark, sf_dir):
    messy = table(spark, sf_dir, "customer").toDF("Cust-Key", "Full Name", "_nation_", "Balance ($) USD", "segment!")
    return naming.sanitize_columns(messy)


# ---- duplicates and combination ----------------------------------------------------------------------------

_PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


def _plain(c: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')"
    )


@query(f"SELECT DISTINCT {_PART} FROM part_copies")
def exact_dedupe_part(spark, sf_dir):
    return dedupe.drop_exact_duplicates(table(spark, sf_dir, "part_copies"))


@query(
    f"""SELECT {_PART} FROM (SELECT *, row_number() OVER (PARTITION BY {_plain("p_name")}, {_plain("p_brand")},
    {_plain("p_type")}, p_size, p_retailprice ORDER BY p_partkey) AS place FROM part_copies) WHERE place = 1"""
)
def near_dedupe_part(spark, sf_dir):
    return dedupe.drop_near_duplicates(
        table(spark, sf_dir, "part_copies"), ["p_partkey"], extra_keys=["p_size", "p_retailprice"]
    )


@query(
    f"""SELECT {_PART} FROM (SELECT *, row_number() OVER (PARTITION BY {_plain("p_name")}, {_plain("p_brand")},
    {_plain("p_type")} ORDER BY p_partkey) AS place FROM part_copies) WHERE place = 1"""
)
def near_dedupe_texts_only_part(spark, sf_dir):
    return dedupe.drop_near_duplicates(table(spark, sf_dir, "part_copies"), ["p_partkey"], extra_keys=[])


@query(
    f"""SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (
    PARTITION BY {_plain("text")} ORDER BY doc_id) AS place FROM documents) WHERE place = 1"""
)
def near_dedupe_documents(spark, sf_dir):
    kept = dedupe.drop_near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"], text_columns=["text"], extra_keys=[])
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, md5({_plain('text')}) AS plain_md5, length({_plain('text')}) AS plain_length FROM documents")
def normalized_text_documents(spark, sf_dir):
    plain = normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("bigint").alias("plain_length")
    )


@query(
    """SELECT DISTINCT key, name, balance FROM (SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier)"""
)
def combine_shared_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").toDF("key", "name", "nation", "balance", "segment")
    suppliers = table(spark, sf_dir, "supplier").toDF("key", "name", "country", "balance")
    return combine.combine_tables([customers, suppliers])


@query(
    """SELECT r_regionkey::VARCHAR AS r_regionkey, r_name, NULL::VARCHAR AS doc_id, NULL::VARCHAR AS quality, NULL::VARCHAR AS toxic FROM region
    UNION ALL SELECT DISTINCT NULL, NULL, doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR FROM labels"""
)
def combine_disjoint_columns(spark, sf_dir):
    combined = combine.combine_tables([table(spark, sf_dir, "region"), table(spark, sf_dir, "labels")])
    return combined.select(*[F.col(c).cast("string").alias(c) for c in combined.columns])


@query(
    """SELECT doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars, 'documents' AS _source, NULL AS item_id,
      NULL AS conv_id, NULL AS turn, NULL AS role FROM documents
    UNION ALL SELECT NULL, text, NULL, NULL, NULL, 'benchmark', item_id::VARCHAR, NULL, NULL, NULL FROM benchmark
    UNION ALL SELECT NULL, text, NULL, NULL, NULL, 'conversations', NULL, conv_id::VARCHAR, turn::VARCHAR, role FROM conversations"""
)
def union_text_sources(spark, sf_dir):
    united = combine.union_sources({n: table(spark, sf_dir, n) for n in ("documents", "benchmark", "conversations")})
    return united.select(*[F.col(c).cast("string").alias(c) for c in united.columns])


# ---- missing values ----------------------------------------------------------------------------------------

_FILLED = """SELECT o_orderkey, o_custkey,
    coalesce(o_orderstatus, (SELECT o_orderstatus FROM orders_dirty WHERE o_orderstatus IS NOT NULL GROUP BY 1
      ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus,
    round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_dirty)), 6) AS o_totalprice,
    coalesce(o_orderdate, last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey),
      first_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) AS o_orderdate, o_orderpriority FROM orders_dirty"""


@query(_FILLED)
def fill_missing_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return rounded(MissingValueFiller(order_by=["o_orderkey"]).fit(df).transform(df))


@query(
    union_all(
        """SELECT '<c>' AS "column", count(*) AS row_count, count(*) - count(<c>) AS missing_before, 0::BIGINT AS missing_after
        FROM orders_dirty""",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    )
)
def fill_report_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return MissingValueFiller(order_by=["o_orderkey"]).fit(df).report(df)


@query(
    """SELECT o_orderkey, coalesce(is_big, last_value(is_big IGNORE NULLS) OVER (ORDER BY o_orderkey))::VARCHAR AS is_big FROM flags"""
)
def forward_fill_flags(spark, sf_dir):
    df = table(spark, sf_dir, "flags")
    filled = MissingValueFiller(order_by=["o_orderkey"]).fit(df).transform(df)
    return filled.select("o_orderkey", F.col("is_big").cast("string").alias("is_big"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, konst, empty FROM consts"""
)
def fill_leaves_empty_columns(spark, sf_dir):
    df = table(spark, sf_dir, "consts")
    return MissingValueFiller().fit(df).transform(df)


# ---- types -------------------------------------------------------------------------------------------------


@query(
    union_all(
        r"""SELECT '<c>' AS "column", count(<c>) AS non_null,
        count(*) FILTER (WHERE regexp_matches(<c>, '^[+-]?[0-9]+$')) AS as_bigint,
        count(*) FILTER (WHERE regexp_matches(<c>, '^[+-]?[0-9]+(\.[0-9]+)?$')) AS as_double,
        count(*) FILTER (WHERE try_cast(<c> AS DATE) IS NOT NULL) AS as_date,
        CASE WHEN bool_and(regexp_matches(<c>, '^[+-]?[0-9]+$')) THEN 'bigint'
          WHEN bool_and(regexp_matches(<c>, '^[+-]?[0-9]+(\.[0-9]+)?$')) THEN 'double'
          WHEN bool_and(try_cast(<c> AS DATE) IS NOT NULL) THEN 'date' ELSE 'string' END AS inferred_type FROM typed_text""",
        ["int_text", "dbl_text", "date_text", "mostly_int", "word"],
    )
)
def inferred_types(spark, sf_dir):
    return infer_types(table(spark, sf_dir, "typed_text")).drop("cid", "as_timestamp_ntz")


@query(
    """SELECT int_text::BIGINT AS int_text, dbl_text::DOUBLE AS dbl_text, date_text::DATE::VARCHAR AS date_text, mostly_int, word
    FROM typed_text"""
)
def retyped_text(spark, sf_dir):
    typed = retype_text(table(spark, sf_dir, "typed_text"))
    return typed.select("int_text", "dbl_text", F.col("date_text").cast("string").alias("date_text"), "mostly_int", "word")


# ---- outliers ----------------------------------------------------------------------------------------------


def _fence(c: str, t: str) -> str:
    return f"""SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT quantile_cont({c}, 0.25)::DOUBLE AS a,
    quantile_cont({c}, 0.75)::DOUBLE AS b FROM {t})"""


@query(
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_totalprice IS NOT NULL THEN
    round(least(greatest(o_totalprice, lo), hi), 6) END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders_dirty, ({_fence("o_totalprice", "orders_dirty")})"""
)
def cap_outliers_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    return rounded(OutlierCapper().fit(df).transform(df))


@query(
    f"""SELECT event_id, ts, user_id, event_type, round(least(greatest(value, lo), hi), 6) AS value, props
    FROM events, ({_fence("value", "events")})"""
)
def cap_outliers_events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return rounded(OutlierCapper().fit(df).transform(df))


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(any_value(lo), 3) AS low, round(any_value(hi), 3) AS high, count({c}) AS non_null,
        count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS capped FROM events, ({_fence(c, "events")})"""
        for c in ("event_id", "user_id", "value")
    )
)
def cap_report_events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return rounded(OutlierCapper().fit(df).report(df), 3)


# ---- personal data -----------------------------------------------------------------------------------------

def _scan_sql(t: str, names) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS pii_type, count({c}) AS non_null,
        count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS matches,
        round(count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) / count({c})::DOUBLE, 6) AS share FROM {t}"""
        for c in names
        for kind, pattern in PII_PATTERNS.items()
    )


@query(_scan_sql("contacts", ["email_address", "phone", "ssn", "card", "card_raw", "ip", "note"]))
def pii_scan_contacts(spark, sf_dir):
    return rounded(privacy.pii_scan(table(spark, sf_dir, "contacts")).drop("cid"))


@query(_scan_sql("documents", ["text", "lang", "source"]))
def pii_scan_documents(spark, sf_dir):
    return rounded(privacy.pii_scan(table(spark, sf_dir, "documents")).drop("cid"))


_LAST4 = r"right(regexp_replace({}, '\D', '', 'g'), 4)"
_MASKED_MAIL = "left(email_address, 1) || repeat('*', instr(email_address, '@') - 2) || substr(email_address, instr(email_address, '@'))"


@query(
    f"""SELECT c_custkey, {_MASKED_MAIL} AS email_address, 'XXX-XXX-' || {_LAST4.format("phone")} AS phone,
    'XXX-XX-' || {_LAST4.format("ssn")} AS ssn, 'XXXX-XXXX-XXXX-' || {_LAST4.format("card")} AS card,
    'XXXX-XXXX-XXXX-' || {_LAST4.format("card_raw")} AS card_raw, 'MASKED_IP_ADDRESS' AS ip, note FROM contacts"""
)
def mask_contacts(spark, sf_dir):
    df = table(spark, sf_dir, "contacts")
    return privacy.PiiMasker().fit(df).transform(df)


@query(
    f"""SELECT c_custkey, {_MASKED_MAIL} AS email_address, 'XXX-XXX-' || {_LAST4.format("phone")} AS phone,
    'XXX-XX-' || {_LAST4.format("ssn")} AS ssn, 'XXXX-XXXX-XXXX-' || {_LAST4.format("card")} AS card,
    'XXX-XXX-' || {_LAST4.format("card_raw")} AS card_raw, 'MASKED_IP_ADDRESS' AS ip, note FROM contacts"""
)
def mask_contacts_in_listed_order(spark, sf_dir):
    df = table(spark, sf_dir, "contacts")
    return privacy.PiiMasker(order="listed").fit(df).transform(df)


@query(
    f"""SELECT c_custkey, 'XXX-XX-' || {_LAST4.format("c_name")} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"""
)
def mask_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return privacy.PiiMasker().fit(df).transform(df)


def _spans_sql(c: str) -> str:
    for kind in ("credit_card", "ssn", "email", "ip_address", "phone"):
        c = f"regexp_replace({c}, '{PII_PATTERNS[kind]}', 'MASKED_{kind.upper()}', 'g')"
    return c


@query(f"SELECT doc_id, md5(masked) AS masked_md5, length(masked) AS masked_length FROM (SELECT doc_id, {_spans_sql('text')} AS masked FROM documents)")
def mask_spans_documents(spark, sf_dir):
    masked = table(spark, sf_dir, "documents").select("doc_id", privacy.mask_spans(F.col("text")).alias("masked"))
    return masked.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").cast("bigint").alias("masked_length"))


@query(f"SELECT page_id, md5(masked) AS masked_md5, length(masked) AS masked_length FROM (SELECT page_id, {_spans_sql('html')} AS masked FROM pages)")
def mask_spans_pages(spark, sf_dir):
    masked = table(spark, sf_dir, "pages").select("page_id", privacy.mask_spans(F.col("html")).alias("masked"))
    return masked.select("page_id", F.md5("masked").alias("masked_md5"), F.length("masked").cast("bigint").alias("masked_length"))


@query(
    f"""WITH fitted AS (SELECT median(o_totalprice) AS mid, median(o_custkey) AS cust FROM orders),
    common AS (SELECT o_orderstatus AS status FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS ({_fence("o_totalprice", "orders")}), k AS ({_fence("o_orderkey", "orders")}), c AS ({_fence("o_custkey", "orders")})
    SELECT least(greatest(o_orderkey, ceil(k.lo)::BIGINT), floor(k.hi)::BIGINT) AS o_orderkey,
      least(greatest(o_custkey, ceil(c.lo)::BIGINT), floor(c.hi)::BIGINT) AS o_custkey,
      coalesce(o_orderstatus, status) AS o_orderstatus,
      round(least(greatest(coalesce(o_totalprice, mid), f.lo), f.hi), 6) AS o_totalprice, o_orderpriority
    FROM orders_dirty, fitted, common, f, k, c"""
)
def fitted_elsewhere_orders(spark, sf_dir):
    """Fill and cap, learned from a table without gaps and outliers, applied to one that has both."""
    clean, dirty = (table(spark, sf_dir, n).drop("o_orderdate") for n in ("orders", "orders_dirty"))
    filled = MissingValueFiller().fit(clean).transform(dirty)
    return rounded(OutlierCapper().fit(clean).transform(filled))


@query(
    """SELECT CAST(CAST(o_orderkey % 90000 AS DECIMAL(38,15)) AS VARCHAR) AS v FROM orders
    UNION ALL SELECT CAST(CAST(o_orderkey AS DECIMAL(38,15)) AS VARCHAR) FROM orders"""
)
def stacked_decimals_orders(spark, sf_dir):
    """Decimals with many places beside whole numbers: no place is lost."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    fine = keys.select((F.col("o_orderkey") % 90000).cast("decimal(20,15)").alias("v"))
    return combine.stack([fine, keys.toDF("v")]).select(F.col("v").cast("string").alias("v"))


@query("SELECT '123456789012345678901' || lpad(o_orderkey::VARCHAR, 8, '0') AS code FROM orders")
def long_codes_stay_text(spark, sf_dir):
    """Codes of more digits than a number holds."""
    code = F.concat(F.lit("123456789012345678901"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("code")
    return retype_text(table(spark, sf_dir, "orders").select(code)).select(F.col("code").cast("string").alias("code"))


# ---- the whole plan ----------------------------------------------------------------------------------------


@query(
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, {_plain("o_orderstatus")}, o_totalprice, o_orderdate,
      {_plain("o_orderpriority")} ORDER BY o_orderkey) AS place FROM orders_dirty),
    unique_orders AS (SELECT * EXCLUDE (place) FROM ranked WHERE place = 1),
    filled AS ({_FILLED.replace("orders_dirty", "unique_orders")}), f AS ({_fence("o_totalprice", "filled")})
    SELECT o_orderkey, o_custkey, o_orderstatus, round(least(greatest(o_totalprice, lo), hi), 6) AS o_totalprice, o_orderdate,
    o_orderpriority FROM filled, f"""
)
def cleaned_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    options = CleaningOptions(order_by=["o_orderkey"])
    return rounded(CleaningPlan(options).fit_transform(df))


@query(
    f"""WITH p AS (SELECT {_PART}, row_number() OVER (PARTITION BY {_plain("p_name")}, {_plain("p_brand")}, {_plain("p_type")},
    p_size, p_retailprice ORDER BY p_partkey) AS place FROM part_copies)
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM p WHERE place = 1"""
)
def cleaned_part(spark, sf_dir):
    df = table(spark, sf_dir, "part_copies")
    options = CleaningOptions(order_by=["p_partkey"], extra_keys=["p_size", "p_retailprice"])
    return CleaningPlan(options).fit_transform(df)


@query(
    f"""WITH a AS (SELECT c_custkey AS id, 'XXX-XX-' || {_LAST4.format("c_name")} AS name, c_nationkey AS nation, c_acctbal AS price FROM customer),
    fa AS ({_fence("price", "a")}),
    b AS (SELECT s_suppkey AS id, 'XXX-XX-' || {_LAST4.format("s_name")} AS name, s_nationkey AS nation, s_acctbal AS price FROM supplier),
    fb AS ({_fence("price", "b")}),
    ca AS (SELECT id, name, nation, round(least(greatest(price, lo), hi), 6) AS price FROM a, fa),
    cb AS (SELECT id, name, nation, round(least(greatest(price, lo), hi), 6) AS price FROM b, fb)
    SELECT DISTINCT id, name, nation, price FROM (SELECT * FROM ca UNION ALL SELECT * FROM cb)"""
)
def cleaned_sources(spark, sf_dir):
    """Customers and suppliers with all their columns; one source has a column more, which a union by name leaves out."""
    customers = table(spark, sf_dir, "customer").toDF("Key", "Name", "Nation", "Amount", "Segment")
    suppliers = table(spark, sf_dir, "supplier").toDF("uid", "full name", "Nation", "AMOUNT ")
    plan = CleaningPlan(CleaningOptions(order_by=["id"], near_duplicates=True))
    # Each source has its own key name, so they are cleaned under the standard names.
    named = {"customers": customers, "suppliers": suppliers}
    return rounded(plan.clean_sources({name: naming.standardize_columns(df) for name, df in named.items()}))

"""Profiles, distributions, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import anomalies as anomaly_rules
from tablewright.operators import distribution, outliers, overview, profile, quality
from tablewright.operators.frequencies import verified_modes
from tablewright.operators.quantiles import approximate_quantiles, exact_quantiles
from tablewright.operators.states import DISTINCT_ERROR, RANK_ERROR, merged_states, profile_of, profile_state
from tablewright.operators.typing import detect_types, suggest_types
from tablewright.registry.base import query, rounded, table, union_all

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOC_TEXTS = ["text", "lang", "source"]


def _counts_sql(t: str, names) -> str:
    return union_all(
        f"""SELECT '<c>' AS "column", count(*) AS row_count, count(<c>) AS non_null, count(*) - count(<c>) AS null_count,
        round(100.0 * (count(*) - count(<c>)) / count(*), 6) AS null_pct, count(DISTINCT <c>) AS "distinct",
        round(100.0 * count(DISTINCT <c>) / count(*), 6) AS distinct_pct FROM {t}""",
        names,
    )


@query(_counts_sql("orders_dirty", ORDERS))
def column_counts_orders(spark, sf_dir):
    return rounded(profile.column_counts(table(spark, sf_dir, "orders_dirty")).drop("cid", "data_type", "category"))


@query(_counts_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def column_counts_documents(spark, sf_dir):
    return rounded(profile.column_counts(table(spark, sf_dir, "documents")).drop("cid", "data_type", "category"))


@query(_counts_sql("embeddings", ["vec_id", "embedding", "label"]))
def column_counts_embeddings(spark, sf_dir):
    return rounded(profile.column_counts(table(spark, sf_dir, "embeddings")).drop("cid", "data_type", "category"))


_ORDER_TYPES = dict(zip(ORDERS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]))
_ORDER_CLASSES = {"bigint": "numeric", "double": "numeric", "string": "text", "timestamp_ntz": "datetime"}


def _five_smallest(t: str, c: str) -> str:
    return f"(SELECT string_agg(v::VARCHAR, ' | ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5))"


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS data_type, '{_ORDER_CLASSES[kind]}' AS category, {_five_smallest("orders_dirty", c)} AS samples"""
        for c, kind in _ORDER_TYPES.items()
    )
)
def column_types_and_samples(spark, sf_dir):
    df = table(spark, sf_dir, "orders_dirty")
    kinds = profile.column_counts(df).select("cid", "column", "data_type", "category")
    samples = profile.sample_values(df).select("cid", F.array_join("samples", " | ").alias("samples"))
    return kinds.join(F.broadcast(samples), "cid").drop("cid")


def _numeric_sql(t: str, names) -> str:
    return union_all(
        f"""SELECT '<c>' AS "column", count(*) AS row_count, count(<c>) AS non_null, round(min(<c>)::DOUBLE, 3) AS min,
        round(max(<c>)::DOUBLE, 3) AS max, round(avg(<c>), 3) AS mean, round(median(<c>)::DOUBLE, 3) AS median,
        round(stddev_samp(<c>), 3) AS std, round(skewness(<c>), 6) + 0.0::DOUBLE AS skewness, round(kurtosis(<c>), 6) + 0.0::DOUBLE AS kurtosis,
        round(quantile_cont(<c>, 0.25)::DOUBLE, 3) AS q25, round(quantile_cont(<c>, 0.75)::DOUBLE, 3) AS q75,
        (WITH q AS (SELECT quantile_cont(<c>, 0.25)::DOUBLE AS a, quantile_cont(<c>, 0.75)::DOUBLE AS b FROM {t})
          SELECT count(*) FROM {t}, q WHERE <c> < a - 1.5 * (b - a) OR <c> > b + 1.5 * (b - a)) AS outlier_count,
        count(*) FILTER (WHERE <c> = 0) AS zero_count, count(*) FILTER (WHERE <c> < 0) AS negative_count,
        coalesce(bool_and(<c>::DOUBLE % 1 = 0), false) AS all_whole FROM {t}""",
        names,
    )


def _numeric(spark, sf_dir, name):
    found = profile.numeric_profile(table(spark, sf_dir, name))
    thousandths = {c: 3 for c in ("min", "max", "mean", "median", "std", "q25", "q75")}
    return rounded(found.drop("cid", "infinite_count", "population_skewness", "population_kurtosis"), **thousandths)


@query(_numeric_sql("orders_dirty", ORDER_NUMBERS))
def numeric_profile_orders(spark, sf_dir):
    return _numeric(spark, sf_dir, "orders_dirty")


@query(_numeric_sql("lineitem", LINE_NUMBERS))
def numeric_profile_lineitem(spark, sf_dir):
    return _numeric(spark, sf_dir, "lineitem")


@query(_numeric_sql("events", ["event_id", "user_id", "value"]))
def numeric_profile_events(spark, sf_dir):
    return _numeric(spark, sf_dir, "events")


@query(_numeric_sql("documents", ["doc_id", "n_chars"]))
def numeric_profile_documents(spark, sf_dir):
    return _numeric(spark, sf_dir, "documents")


@query(
    union_all(
        """SELECT '<c>' AS "column", count(*) AS row_count,
        (WITH q AS (SELECT quantile_cont(<c>, 0.25)::DOUBLE AS a, quantile_cont(<c>, 0.75)::DOUBLE AS b FROM orders_dirty)
          SELECT count(*) FROM orders_dirty, q WHERE <c> < a - 1.5 * (b - a) OR <c> > b + 1.5 * (b - a)) AS outlier_count
        FROM orders_dirty""",
        ORDER_NUMBERS,
    )
)
def outlier_counts_orders(spark, sf_dir):
    return outliers.outlier_counts(table(spark, sf_dir, "orders_dirty")).drop("cid")


def _text_sql(t: str, names) -> str:
    return union_all(
        f"""SELECT '<c>' AS "column", count(*) AS row_count, count(<c>) AS non_null,
        (SELECT <c> FROM {t} WHERE <c> IS NOT NULL GROUP BY <c> ORDER BY count(*) DESC, <c> LIMIT 1) AS most_frequent,
        (SELECT count(*) FROM {t} WHERE <c> IS NOT NULL GROUP BY <c> ORDER BY count(*) DESC LIMIT 1) AS most_frequent_count,
        round(avg(length(<c>)), 6) AS average_length, min(length(<c>)) AS min_length, max(length(<c>)) AS max_length,
        count(DISTINCT length(<c>)) AS distinct_lengths, round(var_samp(length(<c>)), 2) AS length_variance,
        count(*) FILTER (WHERE <c> = '') AS empty_count, count(*) FILTER (WHERE NOT regexp_matches(<c>, '\\S')) AS blank_count,
        {_patterns_sql()} FROM {t}""",
        names,
    )


def _patterns_sql() -> str:
    tests = {
        "contains_numbers": r"regexp_matches(<c>, '\d')",
        "contains_special_chars": r"regexp_matches(<c>, '[^\p{L}\p{N}_\s]')",
        "all_uppercase": "<c> = upper(<c>) AND <c> <> lower(<c>)",
        "all_lowercase": "<c> = lower(<c>) AND <c> <> upper(<c>)",
        "starts_with_number": r"regexp_matches(<c>, '^\d')",
        "email_like": r"regexp_matches(<c>, '@.*\.')",
        "url_like": "regexp_matches(<c>, 'http[s]?://')",
        "phone_like": r"regexp_matches(<c>, '\d{3}[-.\s]?\d{3}[-.\s]?\d{4}')",
    }
    return ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in tests.items())


def _text(spark, sf_dir, name):
    return rounded(profile.text_profile(table(spark, sf_dir, name)).drop("cid"), length_variance=2)


@query(_text_sql("orders_dirty", ORDER_TEXTS))
def text_profile_orders(spark, sf_dir):
    return _text(spark, sf_dir, "orders_dirty")


@query(_text_sql("part", ["p_name", "p_brand", "p_type"]))
def text_profile_part(spark, sf_dir):
    return _text(spark, sf_dir, "part")


@query(_text_sql("documents", DOC_TEXTS))
def text_profile_documents(spark, sf_dir):
    return _text(spark, sf_dir, "documents")


@query(union_all(f"""SELECT '<c>' AS "column", {_patterns_sql()} FROM pages""", ["url", "html"]))
def pattern_profile_pages(spark, sf_dir):
    return profile.pattern_profile(table(spark, sf_dir, "pages")).drop("cid")


def _kinds_sql(t: str, names) -> str:
    tests = {
        "email_like": r"regexp_matches(<c>, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')",
        "phone_like": r"regexp_matches(<c>, '(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}')",
        "url_like": r"regexp_matches(<c>, 'http[s]?://\S')",
        "date_like": r"regexp_matches(<c>, '\d{1,4}[-/]\d{1,2}[-/]\d{1,4}')",
        "numeric_string": r"regexp_matches(replace(replace(<c>, '.', ''), '-', ''), '^[0-9]+$')",
        "all_caps": "<c> = upper(<c>) AND <c> <> lower(<c>)",
        "mixed_case": "<c> <> upper(<c>) AND <c> <> lower(<c>)",
    }
    counted = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in tests.items())
    return union_all(f"""SELECT '<c>' AS "column", {counted} FROM {t}""", names)


@query(_kinds_sql("typed_text", ["int_text", "dbl_text", "date_text", "mostly_int", "word"]))
def text_kinds_typed(spark, sf_dir):
    return profile.kind_profile(table(spark, sf_dir, "typed_text")).drop("cid")


@query(_kinds_sql("documents", DOC_TEXTS))
def text_kinds_documents(spark, sf_dir):
    return profile.kind_profile(table(spark, sf_dir, "documents")).drop("cid")


@query(
    """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min_date, max(o_orderdate) AS max_date,
    (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS date_range_days FROM orders_dirty"""
)
def datetime_profile_orders(spark, sf_dir):
    return profile.datetime_profile(table(spark, sf_dir, "orders_dirty")).drop("cid")


def _duplicates_sql(t: str) -> str:
    return f"""SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS distinct_rows,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}"""


@query(_duplicates_sql("part_copies"))
def duplicate_count_part(spark, sf_dir):
    return profile.duplicate_count(table(spark, sf_dir, "part_copies"))


@query(_duplicates_sql("lineitem"))
def duplicate_count_lineitem(spark, sf_dir):
    return profile.duplicate_count(table(spark, sf_dir, "lineitem"))


@query(
    "SELECT count(*) AS total_rows, count(*) FILTER (WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ORDERS)
    + ") AS complete_rows FROM orders_dirty"
)
def complete_rows_orders(spark, sf_dir):
    return profile.complete_rows(table(spark, sf_dir, "orders_dirty"))


def _gaps(names) -> str:
    return " + ".join(f"count(*) - count({c})" for c in names)


@query(
    f"""SELECT count(*) AS total_rows, 6::BIGINT AS total_columns,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS duplicate_rows,
    3::BIGINT AS numeric_columns, 2::BIGINT AS text_columns, 1::BIGINT AS datetime_columns, 0::BIGINT AS boolean_columns,
    0::BIGINT AS other_columns, 4::BIGINT AS distinct_types, {_gaps(ORDERS)} AS total_missing,
    round(100.0 * ({_gaps(ORDERS)}) / (6 * count(*)), 6) AS missing_pct,
    count(*) FILTER (WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ORDERS)}) AS complete_rows,
    round(100.0 * count(*) FILTER (WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ORDERS)}) / count(*), 6) AS complete_rows_pct,
    ({" + ".join(f"(count(DISTINCT {c}) = count(*))::BIGINT" for c in ORDERS)})::BIGINT AS columns_with_all_unique,
    ({" + ".join(f"(count(DISTINCT {c}) < count(*))::BIGINT" for c in ORDERS)})::BIGINT AS columns_with_duplicates,
    round(({" + ".join(f"count(DISTINCT {c})::DOUBLE" for c in ORDERS)}) / (6 * count(*)), 6) AS avg_uniqueness_ratio
    FROM orders_dirty"""
)
def profile_summary_orders(spark, sf_dir):
    return rounded(overview.profile_summary(table(spark, sf_dir, "orders_dirty")))


@query(
    """SELECT 'not_empty' AS rule, count(*) > 0 AS passed, count(*)::VARCHAR || ' rows' AS detail FROM consts
    UNION ALL SELECT 'min_rows', count(*) >= 1, count(*)::VARCHAR || ' rows, minimum 1' FROM consts
    UNION ALL SELECT 'min_columns', true, '5 columns, minimum 1'
    UNION ALL SELECT 'no_empty_columns', count(empty) > 0, CASE WHEN count(empty) > 0 THEN 'empty columns: none'
      ELSE 'empty columns: empty' END FROM consts"""
)
def validate_table_consts(spark, sf_dir):
    return overview.validate_table(table(spark, sf_dir, "consts"))


_SIZES = {"o_orderkey": "8", "o_custkey": "8", "o_totalprice": "8", "o_orderdate": "8"}


def _bytes_sql(c: str) -> str:
    return f"{_SIZES[c]} * count(*)" if c in _SIZES else f"coalesce(sum(strlen({c})), 0)"


@query(
    "WITH b AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, ({_bytes_sql(c)})::BIGINT AS bytes FROM orders" for c in ORDERS)
    + """) SELECT "column", row_count, bytes, round(100.0 * bytes / (SELECT sum(bytes) FROM b), 6) AS percentage,
    CASE WHEN bytes = 0 THEN '0 B' WHEN bytes < 1024 THEN round_even(bytes::DOUBLE, 2)::VARCHAR || ' B'
      WHEN bytes < 1048576 THEN round_even(bytes / 1024.0::DOUBLE, 2)::VARCHAR || ' KB'
      WHEN bytes < 1073741824 THEN round_even(bytes / 1048576.0::DOUBLE, 2)::VARCHAR || ' MB'
      ELSE round_even(bytes / 1073741824.0::DOUBLE, 2)::VARCHAR || ' GB' END AS formatted FROM b"""
)
def memory_usage_orders(spark, sf_dir):
    return rounded(overview.memory_usage(table(spark, sf_dir, "orders")).drop("cid"))


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS data_type, count(*) AS row_count, 6::BIGINT AS column_count, count(*) - count({c}) AS missing_values,
        ({_bytes_sql(c)})::BIGINT AS bytes, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS duplicate_rows
        FROM orders_dirty"""
        for c, kind in _ORDER_TYPES.items()
    )
)
def basic_info_orders(spark, sf_dir):
    return overview.basic_info(table(spark, sf_dir, "orders_dirty")).drop("cid")


@query(
    f"""WITH b AS (SELECT count(*) AS n, ({" + ".join(_bytes_sql(c) for c in ORDERS)})::BIGINT AS bytes FROM orders)
    SELECT 'Dataset Name' AS key, 'orders' AS value UNION ALL SELECT 'Total Rows', n::VARCHAR FROM b
    UNION ALL SELECT 'Total Columns', '6'
    UNION ALL SELECT 'Memory Usage', CASE WHEN bytes < 1048576 THEN round_even(bytes / 1024.0::DOUBLE, 2)::VARCHAR || ' KB'
      WHEN bytes < 1073741824 THEN round_even(bytes / 1048576.0::DOUBLE, 2)::VARCHAR || ' MB'
      ELSE round_even(bytes / 1073741824.0::DOUBLE, 2)::VARCHAR || ' GB' END FROM b"""
)
def summary_sheet_orders(spark, sf_dir):
    return overview.summary_sheet(table(spark, sf_dir, "orders"), "orders")


@query(
    """SELECT count(*) AS row_count, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR,
    o_orderstatus, o_totalprice::VARCHAR, o_orderdate::VARCHAR, o_orderpriority)), 1, 12))::BIGINT)::VARCHAR AS content_sum
    FROM orders"""
)
def content_fingerprint_orders(spark, sf_dir):
    return overview.portable_fingerprint(table(spark, sf_dir, "orders"))


@query()
def fast_fingerprint_lineitem(spark, sf_dir):
    return overview.fingerprint(table(spark, sf_dir, "lineitem"))


_PROBS = [0.05, 0.25, 0.5, 0.75, 0.99]


@query(
    union_all(
        "SELECT '<c>' AS \"column\", p AS prob, round(q, 6) AS value FROM (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p, "
        "unnest(quantile_cont(<c>::DOUBLE, [0.05, 0.25, 0.5, 0.75, 0.99])) AS q FROM lineitem)",
        LINE_NUMBERS,
    )
)
def narrowed_quantiles_lineitem(spark, sf_dir):
    """Exact quantiles by the path that large tables take: brackets that close in until few values are left."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, _PROBS, budget=1_000, accuracy=100)
    rows = [(name, p, q) for name, values in found.items() for p, q in zip(_PROBS, values)]
    return rounded(spark.createDataFrame(rows, "column string, prob double, value double"))


@query(
    union_all(
        "SELECT '<c>' AS \"column\", p AS prob, count(<c>) AS non_null, true AS within FROM lineitem, "
        "(SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p) GROUP BY p",
        LINE_NUMBERS,
    )
)
def sketched_quantiles_lineitem(spark, sf_dir):
    """Approximate quantiles: the rank of each is off by one in a thousand rows at most."""
    df, accuracy = table(spark, sf_dir, "lineitem"), 1_000
    found = approximate_quantiles(df, LINE_NUMBERS, _PROBS, accuracy)
    counted = df.agg(*[
        F.struct(
            F.lit(name).alias("column"), F.lit(p).alias("prob"), F.count(name).alias("non_null"),
            ((F.count_if(F.col(name) < q) <= (p + 1 / accuracy) * F.count(name) + 1)
             & (F.count_if(F.col(name) <= q) >= (p - 1 / accuracy) * F.count(name) - 1)).alias("within"),
        ).alias(f"r{i}_{j}")
        for i, (name, values) in enumerate(found.items()) for j, (p, q) in enumerate(zip(_PROBS, values))
    ])
    return counted.select(F.inline(F.array(*map(F.col, counted.columns))))


@query(
    union_all(
        """SELECT '<c>' AS "column", count(*) AS row_count, count(<c>) AS non_null, min(<c>)::DOUBLE AS min, max(<c>)::DOUBLE AS max,
        round(avg(<c>), 3) AS mean, round(stddev_samp(<c>), 3) AS std, count(*) FILTER (WHERE <c> = 0) AS zero_count,
        count(*) FILTER (WHERE <c> < 0) AS negative_count, true AS distinct_within, true AS median_within FROM lineitem""",
        LINE_NUMBERS,
    )
)
def merged_profile_lineitem(spark, sf_dir):
    """A profile from the states of four parts of the table, with its sketches held against the rows."""
    df = table(spark, sf_dir, "lineitem")
    parts = [profile_state(df.where(F.col("l_orderkey") % 4 == k), LINE_NUMBERS) for k in range(4)]
    found = profile_of(merged_states(*parts), [0.5])
    exact = profile.column_counts(df, LINE_NUMBERS).select("column", F.col("distinct").alias("exact"))
    medians = {r["column"]: r["quantiles"][0] for r in found.select("column", "quantiles").collect()}
    ranks = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            ((F.count_if(F.col(c) < m) <= (0.5 + RANK_ERROR) * F.count(c) + 1)
             & (F.count_if(F.col(c) <= m) >= (0.5 - RANK_ERROR) * F.count(c) - 1)).alias("median_within"),
        ).alias(f"r{i}")
        for i, (c, m) in enumerate(medians.items())
    ])
    ranks = ranks.select(F.inline(F.array(*map(F.col, ranks.columns))))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.lit(DISTINCT_ERROR) * F.col("exact") + 1
    joined = found.join(F.broadcast(exact), "column").join(F.broadcast(ranks), "column")
    kept = ["column", "row_count", "non_null", "min", "max", "mean", "std", "zero_count", "negative_count"]
    return rounded(joined.select(*kept, near.alias("distinct_within"), "median_within"), mean=3, std=3)


@query(
    union_all(
        """SELECT '<c>' AS "column", <c> AS most_frequent, n AS most_frequent_count
        FROM (SELECT <c>, count(*) AS n FROM documents WHERE <c> IS NOT NULL GROUP BY <c> ORDER BY n DESC, <c> LIMIT 1)""",
        DOC_TEXTS,
    )
)
def verified_modes_documents(spark, sf_dir):
    """Most frequent values, named by a sketch and counted after it; rare ones are counted in full."""
    found = verified_modes(table(spark, sf_dir, "documents"), DOC_TEXTS)
    rows = [(name, *found.get(name, (None, 0))) for name in DOC_TEXTS]
    return spark.createDataFrame(rows, "column string, most_frequent string, most_frequent_count bigint")


# The series of the asymptotic p value, from d and n.
_KS_P = """CASE WHEN d * sqrt(n) < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
    lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * k * k * n * d * d))))) END"""


def _shape_sql(t: str, names) -> str:
    one = union_all(
        f"""SELECT '<c>' AS c, count(<c>)::DOUBLE AS n, skewness(<c>) AS sk, kurtosis(<c>) AS ku,
        (WITH v AS (SELECT <c>::DOUBLE AS x, count(*) AS m FROM {t} WHERE <c> IS NOT NULL GROUP BY 1),
          u AS (SELECT least(1, greatest(0, x)) AS f, m, sum(m) OVER (ORDER BY x) AS upto, sum(m) OVER () AS n FROM v)
          SELECT max(greatest(upto / n - f, f - (upto - m) / n)) FROM u) AS d FROM {t}""",
        names,
    )
    return f"""WITH m AS ({one}),
    g AS (SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) AS g1, ((n - 2) * (n - 3) / (n - 1) * ku - 6) / (n + 1) AS g2 FROM m),
    s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
      (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM g),
    a AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM s),
    z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS den FROM a),
    k AS (SELECT *, z1 * z1 + pow((1 - 2 / (9 * a) - sign(den) * pow((1 - 2 / a) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z)
    SELECT c AS "column", n::BIGINT AS non_null, round(k2, 3) AS normality_statistic, round(exp(-k2 / 2), 6) AS normality_p_value,
      exp(-k2 / 2) > 0.05 AS is_normal, round(d, 6) AS uniformity_statistic,
      round({_KS_P}, 6) AS uniformity_p_value, {_KS_P} > 0.05 AS is_uniform,
      CASE WHEN abs(sk) < 0.5 AND abs(ku) < 3 THEN 'approximately_normal' WHEN sk > 1 THEN 'right_skewed'
        WHEN sk < -1 THEN 'left_skewed' WHEN ku > 3 THEN 'heavy_tailed' ELSE 'unknown' END AS distribution_type FROM k"""


def _shape(spark, sf_dir, name):
    found = distribution.distribution_profile(table(spark, sf_dir, name))
    return rounded(found.drop("cid"), normality_statistic=3)


@query(_shape_sql("lineitem", LINE_NUMBERS))
def distribution_lineitem(spark, sf_dir):
    return _shape(spark, sf_dir, "lineitem")


@query(_shape_sql("orders_dirty", ORDER_NUMBERS))
def distribution_orders(spark, sf_dir):
    return _shape(spark, sf_dir, "orders_dirty")


def _rescaled_sql(t: str, names) -> str:
    one = union_all(
        f"""SELECT '<c>' AS c, count(<c>)::DOUBLE AS n,
        (WITH r AS (SELECT min(<c>)::DOUBLE AS lo, max(<c>)::DOUBLE AS hi FROM {t}),
          v AS (SELECT (<c>::DOUBLE - lo) / (hi - lo) AS f, count(*) AS m FROM {t}, r WHERE <c> IS NOT NULL GROUP BY 1),
          u AS (SELECT f, m, sum(m) OVER (ORDER BY f) AS upto, sum(m) OVER () AS n FROM v)
          SELECT max(greatest(upto / n - f, f - (upto - m) / n)) FROM u) AS d FROM {t}""",
        names,
    )
    return f"""SELECT c AS "column", n::BIGINT AS non_null, round(d, 6) AS uniformity_statistic,
      round({_KS_P}, 6) AS uniformity_p_value, {_KS_P} > 0.05 AS is_uniform FROM ({one})"""


@query(_rescaled_sql("lineitem", LINE_NUMBERS))
def uniformity_rescaled_lineitem(spark, sf_dir):
    found = distribution.distribution_profile(table(spark, sf_dir, "lineitem"), rescale=True)
    return rounded(found.select("column", "non_null", "uniformity_statistic", "uniformity_p_value", "is_uniform"))


@query(
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    b AS (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INTEGER AS bin, count(*) AS n FROM events, r GROUP BY 1)
    SELECT i::INTEGER AS bin, round(lo + i * ((hi - lo) / 20), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 20), 6) AS high,
      coalesce(n, 0) AS n FROM range(20) t(i), r LEFT JOIN b ON b.bin = t.i"""
)
def histogram_events(spark, sf_dir):
    return rounded(distribution.histogram(table(spark, sf_dir, "events"), "value", 20))


def _quality_sql(t: str, kinds: dict[str, str]) -> str:
    valid = {
        "n": "count(*) FILTER (WHERE isfinite(<c>::DOUBLE))",
        "t": r"count(*) FILTER (WHERE regexp_matches(<c>, '\S'))",
        "d": "count(<c>)",
    }
    steady = {
        "n": "0.9", "d": "0.9",
        "t": "greatest(0, 1 - coalesce(var_samp(length(<c>)) / nullif(avg(length(<c>)), 0), 0) / 10)",
    }
    return "WITH q AS (" + " UNION ALL ".join(
        f"""SELECT count({c})::DOUBLE / count(*) AS a, count(DISTINCT {c})::DOUBLE / count(*) AS b,
        {valid[k].replace('<c>', c)}::DOUBLE / count(*) AS v, {steady[k].replace('<c>', c)}::DOUBLE AS s FROM {t}"""
        for c, k in kinds.items()
    ) + "), o AS (SELECT avg(a) AS a, avg(b) AS b, avg(v) AS v, avg(s) AS s FROM q) "


_ORDER_KINDS = dict(zip(ORDERS, "nntndt"))
_DOC_KINDS = {"doc_id": "n", "text": "t", "lang": "t", "source": "t", "n_chars": "n"}


@query(
    _quality_sql("orders_dirty", _ORDER_KINDS)
    + """SELECT 'completeness' AS metric, round(a, 6) AS score FROM o UNION ALL SELECT 'uniqueness', round(b, 6) FROM o
    UNION ALL SELECT 'validity', round(v, 6) FROM o"""
)
def quality_metrics_orders(spark, sf_dir):
    return rounded(quality.quality_metrics(table(spark, sf_dir, "orders_dirty")))


_ASSESSMENT = """, w AS (SELECT *, 0.3 * a + 0.2 * b + 0.25 * s + 0.25 * v AS total FROM o)
    SELECT 'completeness' AS metric, round(a, 6) AS score, NULL AS grade FROM w
    UNION ALL SELECT 'uniqueness', round(b, 6), NULL FROM w UNION ALL SELECT 'consistency', round(s, 6), NULL FROM w
    UNION ALL SELECT 'validity', round(v, 6), NULL FROM w
    UNION ALL SELECT 'overall_score', round(total, 6), CASE WHEN total >= 0.9 THEN 'A (Excellent)' WHEN total >= 0.8 THEN 'B (Good)'
      WHEN total >= 0.7 THEN 'C (Fair)' WHEN total >= 0.6 THEN 'D (Poor)' ELSE 'F (Very Poor)' END FROM w"""


@query(_quality_sql("orders_dirty", _ORDER_KINDS).rstrip() + _ASSESSMENT)
def quality_assessment_orders(spark, sf_dir):
    return rounded(quality.quality_assessment(table(spark, sf_dir, "orders_dirty")).drop("description"))


@query(_quality_sql("documents", _DOC_KINDS).rstrip() + _ASSESSMENT)
def quality_assessment_documents(spark, sf_dir):
    return rounded(quality.quality_assessment(table(spark, sf_dir, "documents")).drop("description"))


def _anomaly_sql(t: str, numbers, texts) -> str:
    parts = []
    for c in numbers:
        base = f"""(SELECT '{c}' AS c, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, abs(skewness({c})) AS sk,
          (WITH q AS (SELECT quantile_cont({c}, 0.25)::DOUBLE AS a, quantile_cont({c}, 0.75)::DOUBLE AS b FROM {t})
            SELECT count(*) FROM {t}, q WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS o FROM {t})"""
        parts.append(
            f"""SELECT c AS "column", 'many_outliers' AS rule, round(o / n::DOUBLE, 6) AS metric, 'Column ''' || c || ''' has ' || o
            || ' outliers (' || printf('%.1f', 100.0 * o / n) || '%)' AS message FROM {base} WHERE k > 10 AND o > n * 0.05"""
        )
        parts.append(
            f"""SELECT c, 'single_value', u::DOUBLE, 'Column ''' || c || ''' has only one unique value' FROM {base} WHERE k > 10 AND u = 1"""
        )
        parts.append(
            f"""SELECT c, 'extreme_skew', round(sk, 6), 'Column ''' || c || ''' is highly skewed (skewness: ' || printf('%.2f', sk) || ')'
            FROM {base} WHERE k > 10 AND sk > 3 AND NOT isnan(sk)"""
        )
    for c in texts:
        base = f"""(SELECT '{c}' AS c, count(*)::DOUBLE AS n, count(DISTINCT length({c})) AS u,
          count({c}) - count(*) FILTER (WHERE {c} = upper({c}) AND {c} <> lower({c}))
          - count(*) FILTER (WHERE {c} = lower({c}) AND {c} <> upper({c})) AS mixed FROM {t})"""
        parts.append(
            f"""SELECT c AS "column", 'varied_lengths' AS rule, round(u / n, 6) AS metric, 'Column ''' || c
            || ''' has inconsistent text lengths' AS message FROM {base} WHERE u / n > 0.8"""
        )
        parts.append(
            f"""SELECT c, 'mixed_case', round(mixed / n, 6), 'Column ''' || c || ''' has mixed case formatting' FROM {base}
            WHERE mixed / n > 0.5"""
        )
    return "\nUNION ALL ".join(parts)


def _anomalies(spark, sf_dir, name):
    return rounded(anomaly_rules.anomalies(table(spark, sf_dir, name)).drop("position", "threshold"))


@query(_anomaly_sql("orders_dirty", ORDER_NUMBERS, ORDER_TEXTS))
def anomalies_orders(spark, sf_dir):
    return _anomalies(spark, sf_dir, "orders_dirty")


@query(_anomaly_sql("documents", ["doc_id", "n_chars"], DOC_TEXTS))
def anomalies_documents(spark, sf_dir):
    return _anomalies(spark, sf_dir, "documents")


@query(_anomaly_sql("consts", ["l_orderkey", "l_linenumber", "l_quantity", "konst", "empty"], []))
def anomalies_consts(spark, sf_dir):
    return _anomalies(spark, sf_dir, "consts")


@query(
    """SELECT 'int_text' AS "column", 'integer' AS suggested_type, count(int_text) AS non_null FROM typed_text
    UNION ALL SELECT 'dbl_text', 'float', count(dbl_text) FROM typed_text
    UNION ALL SELECT 'date_text', 'datetime', count(date_text) FROM typed_text
    UNION ALL SELECT 'mostly_int', CASE WHEN count(DISTINCT mostly_int) < 0.5 * count(*) THEN 'category' END, count(mostly_int) FROM typed_text
    UNION ALL SELECT 'word', CASE WHEN count(DISTINCT word) < 0.5 * count(*) THEN 'category' END, count(word) FROM typed_text"""
)
def suggested_types(spark, sf_dir):
    return suggest_types(table(spark, sf_dir, "typed_text")).drop("cid", "distinct")


def _detected_sql(t: str, columns: dict[str, tuple[str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{dtype}' AS data_type, '{kind}' AS category, count(*) - count({c}) AS null_count,
        round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct, count(DISTINCT {c}) AS "distinct",
        {_five_smallest(t, c)} AS samples,
        {suggestion} AS suggested_type FROM {t}"""
        for c, (dtype, kind, suggestion) in columns.items()
    )


def _category(c: str) -> str:
    return f"CASE WHEN count(DISTINCT {c})::DOUBLE / count(*) < 0.5 THEN 'category' END"


@query(
    _detected_sql(
        "orders_dirty",
        {
            "o_orderkey": ("bigint", "numeric", "NULL"),
            "o_custkey": ("bigint", "numeric", "NULL"),
            "o_orderstatus": ("string", "text", _category("o_orderstatus")),
            "o_totalprice": ("double", "numeric", "CASE WHEN bool_and(coalesce(o_totalprice % 1 = 0, false)) THEN 'integer' END"),
            "o_orderdate": ("timestamp_ntz", "datetime", "NULL"),
            "o_orderpriority": ("string", "text", _category("o_orderpriority")),
        },
    )
)
def detected_types_orders(spark, sf_dir):
    found = detect_types(table(spark, sf_dir, "orders_dirty"))
    return rounded(found.withColumn("samples", F.array_join("samples", " | ")).drop("cid"))


def _whole_floats(c: str) -> str:
    return f"CASE WHEN bool_and(coalesce({c} % 1 = 0, false)) THEN 'integer' END"


_LINE_TYPES = {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], ("bigint", "numeric")), "l_linenumber": ("int", "numeric"),
    **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ("double", "numeric")),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], ("string", "text")), "l_shipdate": ("timestamp_ntz", "datetime"),
}
_SUGGESTED = {"double": _whole_floats, "string": _category}


@query(_detected_sql("lineitem", {c: (*kind, _SUGGESTED.get(kind[0], lambda c: "NULL")(c)) for c, kind in _LINE_TYPES.items()}))
def detected_types_lineitem(spark, sf_dir):
    found = detect_types(table(spark, sf_dir, "lineitem"))
    return rounded(found.withColumn("samples", F.array_join("samples", " | ")).drop("cid"))

import pytest
from pyspark.sql import functions as F

from tablewright.functions.text import display_text, is_upper, normalize_text
from tablewright.operators import combine, dedupe, privacy
from tablewright.operators.distribution import histogram
from tablewright.operators.missing import MissingValueFiller
from tablewright.operators.outliers import OutlierCapper
from tablewright.operators.typing import infer_types, retype_text, suggest_types
from tablewright.plans.cleaning import CleaningOptions, CleaningPlan


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_normalize_text(spark):
    df = spark.createDataFrame([("  Héllo,   WORLD!\n",), ("a_b-c",), ("\t\n",), (None,)], "s string")
    assert values(df.select(normalize_text(F.col("s")).alias("s")), "s") == ["héllo world", "a_bc", "", None]
    assert values(df.select(is_upper(F.lit("123")).alias("s")), "s")[0] is False


def test_display_text(spark):
    df = spark.createDataFrame([("a\x07b",), ("x" * 101,)], "s string")
    assert values(df.select(display_text(F.col("s")).alias("s")), "s") == ["ab", "x" * 97 + "..."]


def test_near_duplicates_keep_the_first_and_whole_groups(spark):
    df = spark.createDataFrame(
        [(3, "Foo Bar!", 1), (1, " foo  bar", 1), (2, "FOO BAR", 2), (4, None, 1), (5, None, 1), (6, "", 1)], "id int, s string, n int"
    )
    texts_only = dedupe.drop_near_duplicates(df, ["id"], extra_keys=[])
    assert sorted(values(texts_only, "id")) == [1, 4, 6]  # null equals null only
    with_number = dedupe.drop_near_duplicates(df, ["id"], extra_keys=["n"])
    assert sorted(values(with_number, "id")) == [1, 2, 4, 6]
    assert sorted(values(dedupe.drop_near_duplicates(df, ["id"]), "id")) == [1, 2, 4, 6]  # the key that orders is not compared
    again = dedupe.drop_near_duplicates(texts_only, ["id"], extra_keys=[])
    assert sorted(again.collect()) == sorted(texts_only.collect(), key=lambda r: r["id"]) or again.count() == 3


def test_one_row_copied_into_a_third_of_the_table(spark):
    hot = spark.range(0, 3000).select("id", F.lit("Same text, same text").alias("s"))
    rest = spark.range(3000, 9000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("s"))
    kept = dedupe.drop_near_duplicates(hot.unionAll(rest).repartition(8), ["id"], extra_keys=[])
    assert kept.count() == 6001 and kept.where("id < 3000").first()["id"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


def test_long_texts_are_compared_whole(spark):
    base = "lorem ipsum " * 400
    df = spark.createDataFrame([(1, base + "a"), (2, base.upper() + " A!"), (3, base + "b")], "id int, s string")
    assert sorted(values(dedupe.drop_near_duplicates(df, ["id"], extra_keys=[]), "id")) == [1, 3]


def test_exact_duplicates_with_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1)), (1, map('a', 1)), (1, map('a', 2)) AS t(n, m)")
    assert dedupe.drop_exact_duplicates(df).count() == 2


def test_combine_rules(spark):
    a = spark.createDataFrame([(1, "x", 1.5)], "id int, s string, only_a double")
    b = spark.createDataFrame([("y", 2), ("y", 2)], "s string, id bigint")
    shared = combine.combine_tables([a, b])
    assert shared.columns == ["id", "s"] and sorted(map(tuple, shared.collect())) == [(1, "x"), (2, "y")]
    c = spark.createDataFrame([(True,)], "flag boolean")
    outer = combine.combine_tables([a, c])
    assert outer.columns == ["id", "s", "only_a", "flag"] and outer.count() == 2
    assert combine.combine_tables([a]) is a
    mixed = combine.stack([a.select("id"), spark.createDataFrame([("z",)], "id string")])
    assert dict(mixed.dtypes) == {"id": "string"}
    labelled = combine.union_sources({"one": a, "two": b})
    assert labelled.count() == 3 and labelled.where("_source = 'two'").count() == 2
    with pytest.raises(ValueError):
        combine.stack([])


def test_type_inference(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2024-01-31", "2024-01-31 10:00:00", "2020", "x", "12/31/2024", "1.0", None),
         (" 2 ", "-3e2", "2024-02-29", "2024-02-29T01:02:03.5", "2021", "1", "01/02/2024", "2.0", None),
         (None, "7", None, None, "2022", "2", None, "3", None)],
        "i string, d string, dt string, ts string, year string, mixed string, us string, whole string, nothing string",
    )
    found = {r["column"]: r["inferred_type"] for r in infer_types(df).collect()}
    assert found == {
        "i": "bigint", "d": "double", "dt": "date", "ts": "string", "year": "bigint", "mixed": "string", "us": "date",
        "whole": "double", "nothing": "string",
    }
    typed = retype_text(df)
    assert sorted(v for v in values(typed, "i") if v is not None) == [1, 2]
    assert dict(typed.dtypes)["us"] == "date"
    kinds = {r["column"]: r["suggested_type"] for r in suggest_types(df).collect()}
    assert kinds["i"] == kinds["whole"] == "integer" and kinds["d"] == "float" and kinds["dt"] == "datetime"
    assert kinds["mixed"] is None


def test_invalid_dates_stay_text(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-01-01",)], "s string")
    assert infer_types(df).first()["inferred_type"] == "string"


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org", "+1 (555) 123-4567"), ("a@x.org", "12"), ("no mail", None)], "m string, p string")
    masked = df.select(privacy.mask_cell(F.col("m"), "email").alias("m"), privacy.mask_cell(F.col("p"), "phone").alias("p"),
                       privacy.mask_cell(F.col("m"), "ip_address").alias("i"))
    assert values(masked, "m") == ["a**@x.org", "*@x.org", "MASKED_EMAIL"]
    assert values(masked, "p") == ["XXX-XXX-4567", "MASKED_PHONE", None]
    assert values(masked, "i") == ["MASKED_IP_ADDRESS"] * 3


def test_masker_gate_is_strict_and_looks_at_all_rows(spark):
    rows = [(i, "ann@x.org" if i < 1 else "plain", "10.0.0.1" if i % 2 else "text") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    assert privacy.PiiMasker().fit(df).plan == {"b": ["ip_address"]}  # exactly a tenth is not enough
    late = spark.createDataFrame([(i, "plain" if i < 100 else "ann@x.org") for i in range(200)], "id int, a string")
    assert privacy.PiiMasker().fit(late).plan == {"a": ["email"]}
    assert privacy.PiiMasker(order="listed", sample=100, order_by=["id"]).fit(late).plan == {}
    with pytest.raises(ValueError):
        privacy.PiiMasker(sample=100)


def test_listed_order_tries_each_type_on_the_masked_column(spark):
    df = spark.createDataFrame([("4000123412341234",)] * 3, "card string")
    assert privacy.PiiMasker(order="listed").fit(df).plan == {"card": ["phone"]}
    assert privacy.PiiMasker().fit(df).plan == {"card": ["credit_card"]}


def test_span_mask_leaves_the_rest(spark):
    df = spark.createDataFrame([("write to ann@x.org from 10.0.0.1 now",)], "s string")
    assert df.select(privacy.mask_spans(F.col("s"))).first()[0] == "write to MASKED_EMAIL from MASKED_IP_ADDRESS now"


@pytest.fixture
def messy(spark):
    return spark.sql(
        """SELECT id AS `Order Key`, CASE WHEN id % 5 <> 0 THEN concat('2024-01-', lpad(1 + id % 28, 2, '0')) END AS `Created At`,
        CASE WHEN id = 33 THEN 1e6D WHEN id % 7 <> 0 THEN cast(id AS DOUBLE) END AS `Amount ($)`,
        concat('user', id, '@example.com') AS Mail FROM range(100) UNION ALL
        SELECT id, '2024-01-01', 1.0D, 'dup@example.com' FROM range(1, 2) LATERAL VIEW explode(sequence(1, 3)) t AS n"""
    )


def test_cleaning_plan(spark, messy):
    fitted = CleaningPlan(CleaningOptions(order_by=["Order Key", "Mail"])).fit(messy)
    cleaned = fitted.transform(messy)
    assert cleaned.columns == ["order_key", "date", "price", "email"]
    assert cleaned.count() == 101
    assert dict(cleaned.dtypes)["date"] == "date"
    assert cleaned.where("date IS NULL OR price IS NULL OR price > 1000").count() == 0
    assert cleaned.where("email LIKE 'user%'").count() == 0 and cleaned.where("email LIKE '%*@example.com'").count() == 101


def test_cleaning_steps_can_be_switched_off(spark, messy):
    nothing = CleaningOptions(False, False, False, False, False, False)
    assert sorted(map(str, CleaningPlan(nothing).fit_transform(messy).collect())) == sorted(map(str, messy.collect()))


def test_clean_sources(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "Key int, Name string")
    b = spark.createDataFrame([("X", 1), ("z", 3)], "Full_Name string, uid int")
    cleaned = CleaningPlan(CleaningOptions(mask_pii=False)).clean_sources({"a": a, "b": b})
    assert cleaned.columns == ["id", "name"]
    assert sorted(map(tuple, cleaned.collect())) == [(1, "X"), (1, "x"), (2, "y"), (3, "z")]


def test_fitted_cleaning_runs_on_a_stream(spark, messy, tmp_path):
    from tablewright.streaming.transforms import clean_stream, write_available

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    plain = messy.toDF("key", "created", "amount", "mail")
    plain.write.parquet(source)
    fitted = CleaningPlan(CleaningOptions(order_by=["key", "mail"])).fit(plain)
    stream = clean_stream(spark.readStream.schema(plain.schema).parquet(source), fitted)
    write_available(stream, target, checkpoint=str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(target)
    assert out.count() == plain.count() and out.where("email LIKE 'user%'").count() == 0
    with pytest.raises(ValueError):
        clean_stream(plain, fitted)


def test_fitted_fill_and_cap_hold_for_other_tables(spark):
    fitted = spark.sql("SELECT id AS n, id * 1.0D AS x, concat('s', id % 2) AS s, DATE'2024-01-01' AS d FROM range(1, 40)")
    other = spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS DATE)), (1000000L, -1e9D, 'z', NULL) AS t(n, x, s, d)")
    filler = MissingValueFiller().fit(fitted)
    filled = filler.fill_constants(other)
    assert dict(filled.dtypes)["n"] == "bigint" and [tuple(r) for r in filled.where("s <> 'z'").collect()] == [(20, 20.0, "s1", None)]
    with pytest.raises(ValueError):
        filler.transform(other)
    ordered = MissingValueFiller(["n"]).fit(fitted)
    assert ordered.transform(fitted).count() == 39
    capped = OutlierCapper().fit(fitted).transform(other)
    assert capped.schema["n"].dataType == fitted.schema["n"].dataType
    assert [tuple(r)[:2] for r in capped.where("s = 'z'").collect()] == [(58, -18.0)]


def test_no_digit_is_lost(spark):
    ids = spark.createDataFrame([("12345678901234567890123",), ("12345678901234567890124",)], "s string")
    assert retype_text(ids).distinct().count() == 2 and infer_types(ids).first()["inferred_type"] == "string"
    assert infer_types(spark.createDataFrame([("12345678901234567890123",), ("1.5",)], "s string")).first()["inferred_type"] == "double"
    a = spark.sql("SELECT CAST('0.123456789012345' AS DECIMAL(20,15)) AS v")
    b = spark.sql("SELECT 9223372036854775807L AS v")
    assert sorted(str(r[0]) for r in combine.stack([a, b]).collect()) == ["0.123456789012345", "9223372036854775807.000000000000000"]
    wide = spark.sql("SELECT CAST('0.5' AS DECIMAL(38,30)) AS v")
    assert combine.stack([wide, b]).schema["v"].dataType.simpleString() == "string"


def test_infinite_values_have_their_own_bins(spark):
    df = spark.sql("SELECT CAST(c AS DOUBLE) AS v FROM VALUES '1', '2', '5', 'Infinity', '-Infinity', '-Infinity', 'NaN', NULL AS t(c)")
    assert [tuple(r) for r in histogram(df, "v", bins=2).orderBy("bin").collect()] == [
        (-1, float("-inf"), float("-inf"), 2), (0, 1.0, 3.0, 2), (1, 3.0, 5.0, 1), (2, float("inf"), float("inf"), 1)]

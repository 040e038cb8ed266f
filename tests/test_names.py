import pytest

from tablewright.functions import names


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("First Name", "first_name"), ("created_at", "date"), ("Updated-At", "date"), ("EMAIL", "email"), ("e-mail", "email"),
        ("amount", "price"), ("count", "quantity"), ("key", "id"), ("__x__", "x"), ("a  b--c", "a_b_c"), ("Größe", "größe"),
    ],
)
def test_standard_name(given, wanted):
    assert names.standard_name(given) == wanted


def test_unique_names_skip_real_columns():
    assert names.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"]
    assert names.unique_names(["x", "y"]) == ["x", "y"]


def test_schema_name_rules():
    assert names.schema_name("1st", 0) == "col_1st"
    assert names.schema_name("!!!", 4) == "column_4"
    assert names.schema_name("A.b", 0) == "a_b"


def test_sql_identifier_avoids_reserved_words():
    assert names.sql_identifier("order").startswith("column_")
    assert names.sql_identifier("order") == names.sql_identifier("order")
    assert names.sql_identifier("Order Date") == "order_date"


def test_sanitized_name_keeps_case_and_dash():
    assert names.sanitized_name("Cust-Key (new)") == "Cust-Key_new"


def test_standardize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["created at", "Updated_At", "a.b"])
    assert names.standardize_columns(df).columns == ["date", "date_1", "a_b"]

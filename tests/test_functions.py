import datetime as dt

from pyspark.sql import functions as F

from hourloom.functions import colours, dates, text


def one(spark, value, f, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(f(F.col("v"))).first()[0]


def test_hex_rounds_half_to_even_and_clamps(spark):
    for stored, expected in [
        ("0.9,0.3,0.5,1", "#e64c80"),
        ("0.5,0.5,0.5,1", "#808080"),
        (" 2 , -1, 0 ", "#ff0000"),
        ("0.1,0.2", None),
        ("a,b,c", None),
        (None, None),
    ]:
        assert one(spark, stored, colours.to_hex) == expected


def test_css_cuts_off_and_has_a_default(spark):
    assert one(spark, "0.5,0.5,0.5,1", colours.to_css) == "rgba(127, 127, 127, 1.0)"
    assert one(spark, None, colours.to_css) == "rgba(47, 47, 47, 1)"
    assert one(spark, "0.5,0.5", colours.to_css) is None


def test_picked_colour(spark):
    assert one(spark, "#4080ff", colours.from_hex) == "0.251, 0.502, 1.0, 1.0"
    assert one(spark, "#4080f", colours.from_hex) is None
    back = one(spark, one(spark, "#4080ff", colours.from_hex), colours.to_hex)
    assert back == "#4080ff"


def test_first_name_and_header_differ_without_a_space(spark):
    assert one(spark, "Ann", text.first_name) == ""
    assert one(spark, "Ann", text.header) == "Ann"
    assert one(spark, "Ann Lee", text.first_name) == "Ann"
    assert one(spark, None, text.first_name) is None


def test_short_header(spark):
    assert one(spark, "x" * 40, text.short_header) == "x" * 30


def test_name_comparison_ignores_case_and_accents(spark):
    assert one(spark, "ánna", lambda c: text.same_name(c, F.lit("Anna")))
    assert one(spark, "LOGIN", lambda c: text.same_login(c, F.lit("login")))
    assert not one(spark, "login", lambda c: text.same_login(c, F.lit("log%")))


def test_month_names(spark):
    assert one(spark, 3, dates.month_name, "int") == "Март"
    assert one(spark, 13, dates.month_name, "int") == ""
    assert one(spark, None, dates.month_name, "int") == ""


def test_dates(spark):
    assert one(spark, dt.date(2024, 2, 3), dates.days_in_month, "date") == 29
    assert one(spark, dt.date(2024, 2, 3), dates.is_weekend, "date")
    assert not one(spark, dt.date(2024, 2, 2), dates.is_weekend, "date")
    assert one(spark, 30, lambda c: dates.date_of(F.lit(2024), F.lit(2), c), "int") is None
    assert one(spark, 5, lambda c: dates.date_of(F.lit(24), F.lit(2), c), "int") == dt.date(24, 2, 5)
    assert one(spark, 7, dates.two_digits, "int") == "07"

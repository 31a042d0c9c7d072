"""Reading single cells, names and formats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablestory.functions import cells, names, shown


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("text, value, unit", [
    ("$1,200.50", 1200.5, "$"), ("(300)", -300.0, None), ("12%", 12.0, "%"), ("-3%", -3.0, "%"), ("980€", 980.0, "€"),
    ("1e3", 1000.0, None), (".5", 0.5, None), ("+7.", 7.0, None), ("-$5", -5.0, "$"), ("abc", None, None),
    ("1$2", None, None), ("", None, None), ("1e999", None, None), ("($45)", -45.0, "$"), ("5 %", 5.0, "%"),
])
def test_numbers(spark, text, value, unit):
    assert one(spark, text, cells.as_number) == value
    if value is not None:
        assert one(spark, text, cells.number_unit) == unit


@pytest.mark.parametrize("text, day_first, moment", [
    ("2024-01-05", False, datetime(2024, 1, 5)), ("2024/1/5 08:30", False, datetime(2024, 1, 5, 8, 30)),
    ("2024-01-05T08:30:15Z", False, datetime(2024, 1, 5, 8, 30, 15)), ("01/05/2024", False, datetime(2024, 1, 5)),
    ("05.01.2024", True, datetime(2024, 1, 5)), ("25/01/2024", True, datetime(2024, 1, 25)),
    ("07/19/71", False, datetime(1971, 7, 19)), ("07/19/69", False, datetime(2069, 7, 19)), ("2024-03", False, datetime(2024, 3, 1)),
    ("Jan 5, 2024", False, datetime(2024, 1, 5)), ("5 January 2024", False, datetime(2024, 1, 5)), ("March 2024", False, datetime(2024, 3, 1)),
    ("2024-02-31", False, None), ("13/13/2024", False, None), ("0900-01-01", False, None), ("Foo 2024", False, None),
    ("2024-01-05 24:00", False, None), ("2024-01-05 23:75", False, None), ("hello", False, None), ("01/05/20245", False, None),
])
def test_dates(spark, text, day_first, moment):
    assert one(spark, text, lambda c: cells.as_time(c, day_first)) == moment


@pytest.mark.parametrize("text, moment", [
    ("20181014", datetime(2018, 10, 14)), ("10142018", datetime(2018, 10, 14)), ("1062018", datetime(2018, 1, 6)),
    ("99999999", None), ("20181014.5", None),
])
def test_compact_dates(spark, text, moment):
    assert one(spark, text, lambda c: cells.compact_date(c.try_cast("double"))) == moment


def test_missing_and_flags(spark):
    words = ["", " NA ", "n/a", "NaN", "null", "None", "nil", "?", "-", "--", "#N/A", None]
    assert all(one(spark, w, cells.is_missing) for w in words)
    assert not one(spark, "0", cells.is_missing)
    assert [one(spark, w, cells.as_flag) for w in ("YES", "t", "1", "No", "f", "0", "maybe")] == [True] * 3 + [False] * 3 + [None]


@pytest.mark.parametrize("name, label", [
    ("primary_fur_color", "Primary fur color"), ("yardsGained", "Yards gained"), ("order-qty", "Order quantity"),
    ("body_mass_g", "Body mass (g)"), ("AAPL.Open", "AAPL open"), ("gdpPercap", "GDP percap"),
])
def test_labels(name, label):
    assert names.humanize_name(name) == label


def test_additive_names_and_stems():
    assert names.is_additive_name("total_sales") and names.is_additive_name("yardsGained")
    assert not any(map(names.is_additive_name, ["unit_price", "yards_to_go", "amount_needed", "sales_rate"]))
    assert [names.stem(w) for w in ("locations", "eating", "cities", "boxes", "cats", "returned", "bus")] == [
        "location", "eat", "city", "box", "cat", "return", "bus"]
    assert names.calendar_order(["Sun", "Thur", "Sat", "Fri"]) == ["Thur", "Fri", "Sat", "Sun"]
    assert names.calendar_order(["Mars", "Sun"]) is None


def test_formats_agree(spark):
    values = [1284.0, 12940.0, 4_200_000.0, -3.14159, 0.5, 0.1234, 12.34, 123.4, 99_950.0, 1.5e10, 2e9, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown_there = [r.t for r in df.select(shown.number_text(F.col("v")).alias("t")).collect()]
    assert shown_there == [shown.format_number(v) for v in values]
    assert shown_there[:4] == ["1,284", "12.9K", "4.2M", "−3.14"]
    assert shown.format_number(4_200_000, "$") == "$4.2M" and shown.format_number(0.5, "%") == "0.5%"
    shares = [0.254, 0.059, 0.004, 0.995, 0.0, 1.0, 0.05]
    df = spark.createDataFrame([(v,) for v in shares], "v double")
    there = [r.t for r in df.select(shown.share_text(F.col("v")).alias("t")).collect()]
    assert there == [shown.format_share(v) for v in shares] == ["25%", "5.9%", "<1%", ">99%", "0%", "100%", "5%"]
    assert shown.format_ratio(1.53) == "1.5×" and shown.format_ratio(11.4) == "11×"
    assert shown.format_time_bucket(datetime(2018, 10, 13), "day", False) == "Oct 13"
    assert shown.format_time_bucket(datetime(2018, 10, 1), "quarter", False) == "Q4 2018"
    assert shown.nice_ticks(0, 434) == [0, 200, 400, 600] and shown.nice_ticks(92, 134) == [80, 100, 120, 140]

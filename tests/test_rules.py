"""Text, calendar and row rules on literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorline.contract import feature_projection
from priorline.functions import calendar, rows, text
from priorline.operators.requests import reject_leakage
from priorline.sources.files import normalize_columns, projection


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "rule, pairs",
    [
        (text.normalize_mode, {" Bus ": "bus", "STREETCAR": "streetcar", "subway": "Unknown", None: "Unknown"}),
        (
            text.normalize_route,
            {"29.0": "29", " 29a ": "29A", "007": "7", "000": "0", "29.5": "Unknown", "rad": "RAD",
             "Queen Street": "Unknown", "12345": "12345", "5 0 1": "501", "nan": "Unknown", None: "Unknown"},
        ),
        (
            text.normalize_direction,
            {"N/B": "N", "eastbound": "E", "s": "S", "W/B": "W", "Both Ways": "B", "NEWS": "B", "Q": "Unknown",
             "": "Unknown", "123": "Unknown", "EW": "B"},
        ),
        (
            text.normalize_incident,
            {"Mech": "Mechanical", "Securitty": "Security", "Rail/Switches": "Rail/Switches", "stops": "Operations",
             "Overhead wire": "Overhead", "late  garage": "Late Leaving Garage", "bees": "Other", None: "Unknown",
             "Emergency & EMS": "Emergency Services", "Vision": "Vision"},
        ),
        (
            text.normalize_location,
            {"queen & spadina": "QUEEN AND SPADINA", "Union Stn": "UNION STATION", "King St W": "KING STREET WEST",
             "Queen St. West": "QUEEN ST. WEST", "a@b": "A AND B", "n/a": "Unknown"},
        ),
        (text.clean_text, {" 501.0 ": "501", "a \t b": "a b", "NaN": None, "NaT": None, "": None, "5.00": "5.00"}),
        (text.base_route, {"29A": "29", "29": None, "RAD": None}),
        (text.match_text, {"Queen St. W": "queen street west", "n/a": ""}),
    ],
)
def test_text_rules(spark, rule, pairs):
    assert apply(spark, rule, list(pairs)) == list(pairs.values())


def test_punctuation_flag(spark):
    strip = lambda c: text.normalize_location(c, strip_punctuation=True)
    assert apply(spark, strip, ["Queen St. West"]) == ["QUEEN STREET WEST"]


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="Unsupported mode"):
        apply(spark, lambda c: text.normalize_mode(c, strict=True), ["subway"])


def test_times(spark):
    got = apply(spark, calendar.parse_time_seconds, ["08:30", "8:30 PM", "0.5", "noon", None, "23:59:59", "0.999999"])
    assert got == [30600, 73800, 43200, None, None, 86399, 0]


def test_timestamp_without_time_is_midnight(spark):
    df = spark.createDataFrame([("2024-07-01", None), ("bad", "08:00"), ("1-Jul-98", "08:00")], "d string, t string")
    got = [r[0] for r in df.select(calendar.build_timestamp(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 7, 1), None, dt.datetime(1998, 7, 1, 8)]


def test_holiday_variants(spark):
    days = ["2024-12-25", "2024-07-01", "2024-02-03", "2024-03-29", "2020-05-25", "2020-05-18", "2024-08-05"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    for variant, expected in {
        "calendar": [1, 1, 0, 1, 0, 1, 0],
        "cleaning": [1, 1, 0, 1, 1, 0, 0],
        "request": [1, 1, 0, 1, 0, 1, 1],
    }.items():
        assert [r[0] for r in df.select(calendar.is_holiday(F.col("d"), variant)).collect()] == expected


def test_delay_buckets_and_weights(spark):
    values = [0.0, 5.0, 5.5, 10.0, 15.0, 30.0, 31.0, 120.0, 240.0, 241.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [tuple(r) for r in df.select(rows.delay_bucket(F.col("v")), rows.sample_weight(F.col("v"))).collect()]
    assert [g[0] for g in got] == [
        "0-5", "0-5", "6-10", "6-10", "11-15", "16-30", "31-60", "61-120", "121-240", "241+", None,
    ]
    assert [g[1] for g in got] == [1, 1, 1, 1, 1, 1.5, 2, 3, 4, 1, 1]


def test_headers_first_wins(spark):
    assert projection(["Report Date", "Date", "Line", "Bound", "Delay", "Min Delay", "Extra "]) == {
        "date": "Report Date", "route": "Line", "direction": "Bound", "min_delay": "Delay", "Extra": "Extra ",
    }
    df = spark.createDataFrame([("1", "2")], "`Min Delay` string, `Gap` string")
    assert normalize_columns(df, "bus").columns == ["min_delay", "min_gap", "source_mode"]


def test_leakage_is_refused(spark):
    with pytest.raises(ValueError, match="min_delay"):
        reject_leakage(spark.createDataFrame([(1.0,)], "min_delay double"))
    features, categoricals, numerics = feature_projection(
        ["hour", "route", "min_gap", "ts"], allowed=["hour", "route", "min_gap", "ts"]
    )
    assert (features, categoricals, numerics) == (["hour", "route"], ["route"], ["hour"])

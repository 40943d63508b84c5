from datetime import date

import pytest
from pyspark.sql import functions as F

from voxfare.functions import dates, scores, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given, wanted",
    [("  a   b\n\tc ", "a b c"), ("  ", "Not Rated"), (None, "Not Rated"), ("x", "x"), ("a b", "a b")],
)
def test_clean_text(spark, given, wanted):
    assert one(spark, text.clean_text("x"), x=given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("11th January 2026", "11 January 2026"),
        ("1st May 2020", "1 May 2020"),
        ("03rd May 2020", "3 May 2020"),
        ("August 1st, sort of", "August 1, sort of"),
        ("31 February 2020", "31 February 2020"),
        (None, "Not Rated"),
    ],
)
def test_display_date(spark, given, wanted):
    assert one(spark, dates.display_date("x"), x=given) == wanted


def test_dates_never_raise(spark):
    assert one(spark, dates.iso_date("x"), x="2020-13-01") is None
    assert one(spark, dates.iso_date("x"), x="2020-02-29") == date(2020, 2, 29)
    assert one(spark, dates.parse_month("x"), x=" January 2026 ") == date(2026, 1, 1)
    assert one(spark, dates.parse_month("x"), x="Not Rated") is None


def test_trip_month_prefers_flown(spark):
    c = dates.trip_month("f", dates.iso_date("r"))
    assert one(spark, c, f="March 2019", r="2020-05-17") == date(2019, 3, 1)
    assert one(spark, c, f="Not Rated", r="2020-05-17") == date(2020, 5, 1)
    assert one(spark, dates.format_month(c), f="junk", r=None) == "Not Rated"


@pytest.mark.parametrize(
    "header, name, shown, wanted",
    [
        ("151 reviews Ann (gold) Lee (Thailand) 8th January 2026", "Ann (gold) Lee", "8th January 2026", "Thailand"),
        ("3 reviews (gold) A. B+ (Austria) 1st May 2020", "A. B+", "1st May 2020", "Austria"),
        ("A. B (Austria) some day", "A. B", "1st May 2020", "Austria"),
        ("nobody", "A", "1st May 2020", "Not Rated"),
        ("x (Peru) y", "Not Rated", "1st May 2020", "Peru"),
        (r"a\Eb (Chile) 1st May 2020", r"a\Eb", "1st May 2020", "Chile"),
    ],
)
def test_country(spark, header, name, shown, wanted):
    assert one(spark, text.country_from_header("h", "n", "d"), h=header, n=name, d=shown) == wanted


@pytest.mark.parametrize(
    "body, flag, rest",
    [
        ("✅ Trip Verified | Good | fine", "Yes", "Good | fine"),
        ("Verified Review |  ok", "Yes", "ok"),
        ("Not Verified | bad", "No", "bad"),
        ("Not Verified without bar", "No", "Not Verified without bar"),
        ("plain | text", "Not Rated", "plain | text"),
        ("Trip Verified |", "Yes", "Not Rated"),
        (None, "Not Rated", "Not Rated"),
    ],
)
def test_verified(spark, body, flag, rest):
    assert one(spark, text.verified_flag(text.clean_text("b")), b=body) == flag
    assert one(spark, text.verified_text("b"), b=body) == rest


def test_small_text_rules(spark):
    assert one(spark, text.strip_quotes("x"), x="\"'Nice'\"") == "Nice"
    assert one(spark, text.strip_quotes("x"), x="'\"Nice\"'") == '"Nice"'
    assert one(spark, text.yes_no("x"), x="YES") == "Yes"
    assert one(spark, text.yes_no("x"), x="maybe") == "Not Rated"
    assert one(spark, text.not_applicable("x"), x="n/A") == "Not Rated"
    assert one(spark, text.norm_key("x", "y"), x=" A ", y=None) == "a||"


@pytest.mark.parametrize("given, wanted", [(" NONE ", None), ("n/a", None), ("ok", None), ("\tBad Food\n", "bad food"), (None, None)])
def test_clean_voice(spark, given, wanted):
    assert one(spark, text.clean_voice("x"), x=given) == wanted


def test_words_stand_alone(spark):
    got = one(spark, text.words("x"), x="The cat2 sat_on été naïve Foods, a to FOOD-court.")
    assert got == ["the", "foods", "food", "court"]


@pytest.mark.parametrize("value, wanted", [(3.0, "Low (1–3)"), (3.1, "Mid (4–6)"), (6.0, "Mid (4–6)"), (10.0, "Top (9–10)"), (0.0, None), (None, None)])
def test_bands_are_right_closed(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(scores.band("v").alias("b")).first()["b"] == wanted


def test_maps_flags_and_routes(spark):
    assert one(spark, scores.replace_map("x", scores.AIRCRAFT_NAMES), x="Boeing 777") == "B777"
    assert one(spark, scores.replace_map("x", scores.AIRCRAFT_NAMES), x="Glider") == "Glider"
    assert one(spark, scores.strict_map("x", {"a": 1.5}), x="b") is None
    assert one(spark, scores.prefix_class("x"), x="A380") == "Airbus"
    assert one(spark, scores.prefix_class("x"), x=None) == "Unknown"
    assert one(spark, scores.to_double("x"), x="Not Rated") is None
    assert one(spark, scores.to_double("x"), x="4.5") == 4.5
    assert one(spark, scores.theme_code("x"), x=" Negative ") == -1.0
    assert one(spark, scores.theme_code("x"), x="mixed") is None
    assert one(spark, scores.rebook_code("x"), x="Maybe") == 1.0
    assert one(spark, scores.flag_code("x"), x="True") == 1.0
    assert one(spark, scores.route_origin("x"), x="A to B via C") == "A"
    assert one(spark, scores.route_destination("x"), x="A to B to D via C") == "D via C"
    assert one(spark, scores.route_destination("x"), x="Nowhere") == "Nowhere"


def test_null_flags_count_as_zero(spark):
    df = spark.createDataFrame([(9.0,), (2.0,), (None,)], "r double")
    got = df.select(scores.at_least("r", 8).alias("h"), scores.at_most("r", 3).alias("l"), scores.tier("r", 7, 5).alias("t")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, "green"), (0.0, 1.0, "red"), (0.0, 0.0, None)]
    assert df.select(F.sum(scores.holds(F.col("r") > 5)).alias("s")).first()["s"] == 1.0

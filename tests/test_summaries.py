from datetime import date

import pytest
from pyspark.sql import functions as F

from voxfare.operators import clusters, measures, summaries

THEMES = {"theme_ife": "IFE", "theme_wifi": "Wi-Fi"}


@pytest.fixture(scope="module")
def themed(spark):
    data = [
        ("Economy", "positive", "not_mentioned"), ("Economy", "negative", None), ("Economy", "mixed", "not_mentioned"),
        ("First", "not_mentioned", "neutral"), (None, "positive", "not_mentioned"), ("First", None, "not_mentioned"),
    ]
    return spark.createDataFrame(data, "seat_type string, theme_ife string, theme_wifi string")


def test_theme_summary(themed, rows):
    got = summaries.theme_summary(themed, THEMES, "seat_type")
    cols = ("theme", "seat_type", "n_mentioned", "n_positive", "n_negative", "n_neutral", "pct_positive", "sentiment_ratio")
    assert rows(got, *cols) == [
        ("IFE", "All Cabins", 4, 2, 1, 0, 50.0, 0.25),
        ("IFE", "Economy", 3, 1, 1, 0, 33.3, 0.0),
        ("Wi-Fi", "All Cabins", 1, 0, 0, 1, 0.0, 0.0),
        ("Wi-Fi", "First", 1, 0, 0, 1, 0.0, 0.0),
    ]


def test_theme_summary_null_counts_when_asked(themed):
    got = {(r["theme"], r["seat_type"]): r["n_mentioned"] for r in summaries.theme_summary(themed, THEMES, "seat_type", null_is_mentioned=True).collect()}
    assert got == {
        ("IFE", "All Cabins"): 5, ("IFE", "Economy"): 3, ("IFE", "First"): 1,
        ("Wi-Fi", "All Cabins"): 2, ("Wi-Fi", "Economy"): 1, ("Wi-Fi", "First"): 1,
    }


def test_theme_negativity_has_a_row_for_silence(themed, rows):
    got = rows(summaries.theme_negativity(themed, THEMES, "seat_type"), "seat_type", "theme_col", "negative_pct")
    assert ("First", "theme_ife", 0.0) in got and ("Economy", "theme_ife", pytest.approx(100 / 3)) in [tuple(g) for g in got]


def test_theme_parts_add_up(themed):
    t = summaries.theme_summary(themed.filter("seat_type is not null"), THEMES, "seat_type").groupBy("theme").agg(
        F.sum(F.when(F.col("seat_type") == "All Cabins", F.col("n_mentioned"))).alias("a"),
        F.sum(F.when(F.col("seat_type") != "All Cabins", F.col("n_mentioned"))).alias("b"),
    )
    assert all(r["a"] == r["b"] for r in t.collect())


def test_monthly_unknown_flags_are_false(spark):
    df = spark.createDataFrame(
        [(2020, 5, 0.5, 8.0, "positive", "Yes", None, True), (2020, 5, -0.5, None, "negative", "No", True, False), (None, 5, 1.0, 1.0, "mixed", "Yes", True, True)],
        "year int, month int, s double, r double, o string, rec string, sarc boolean, comp boolean",
    )
    (r,) = summaries.monthly(df, "year", "month", "s", "r", "o", "rec", "sarc", "comp").collect()
    assert r["n_reviews"] == 2 and r["date"] == date(2020, 5, 1) and r["avg_overall_rating"] == 8.0
    assert (r["pct_positive"], r["pct_sarcastic"], r["pct_competitor_mention"], r["pct_recommended"]) == (50.0, 50.0, 50.0, 50.0)


@pytest.fixture(scope="module")
def reviews(spark):
    data = [
        (2019, "Economy", "Solo", 9.0, "Yes"), (2019, "Economy", None, 3.0, "No"), (2019, "First", "Business", None, "Not Rated"),
        (2021, "First", "Business", 8.0, "Yes"), (2021, "Economy", "Solo", 2.0, None), (None, "First", "Solo", 10.0, "Yes"),
    ]
    return spark.createDataFrame(data, "year int, seat string, who string, rating double, rec string")


def test_story(reviews):
    got = {r["year"]: r for r in summaries.rating_story(reviews, "year", "rating", "rec").collect()}
    assert set(got) == {2019, 2021}
    r = got[2019]
    assert (r["mean"], r["median"], r["n"], r["high_pct"], r["low_pct"]) == (6.0, 6.0, 2, 50.0, 50.0)
    assert r["recommend_pct"] == pytest.approx(100 / 3) and r["recommend_tier"] == "red"
    assert r["band_high"] - r["band_low"] == pytest.approx(r["sd"])


def test_shares_sum_to_hundred(reviews):
    assert sum(r["share_pct"] for r in summaries.freq(reviews, ["who"], share=True).collect()) == pytest.approx(100)
    mix = summaries.mix(reviews, ["year", "seat"], ["year"]).groupBy("year").agg(F.sum("share_pct").alias("s"))
    assert all(r["s"] == pytest.approx(100) for r in mix.collect())


def test_segment_vs_rest_takes_unknown_as_rest(reviews):
    got = {r["year"]: r for r in summaries.segment_vs_rest(reviews, F.col("who") == "Solo", "year", "rating").collect()}
    assert got[2019]["segment_mean"] == 9.0 and got[2019]["rest_mean"] == 3.0 and got[2019]["global_mean"] == 6.0


def test_align_and_pivot(reviews):
    means = summaries.profile(reviews, ["seat"], ["rating"])
    got = summaries.align(means, "seat", ["First", "Premium", "Economy"]).orderBy("ord").collect()
    assert [(r["seat"], r["mean"]) for r in got] == [("First", 9.0), ("Premium", None), ("Economy", pytest.approx(14 / 3))]
    wide = summaries.pivot_mean(reviews, "year", "seat", "rating", ["Economy", "First", "Premium"])
    assert wide.columns == ["year", "Economy", "First", "Premium"]
    assert {r["year"] for r in summaries.gap(wide, "First", "Economy").collect()} == {2021}


def test_crosstab_fills_zero(reviews):
    got = {r["seat"]: (r["Solo"], r["Business"], r["total"]) for r in summaries.with_row_total(summaries.crosstab(reviews, "seat", "who", ["Solo", "Business"]), ["Solo", "Business"]).collect()}
    assert got == {"Economy": (2, 0, 2), "First": (1, 2, 3)}


def test_kpi_and_having(reviews):
    r = summaries.kpi_row(reviews, "year", "rating", "rec").first()
    assert (r["reviews"], r["mean_rating"], r["recommend_pct"], r["worst_year"], r["worst_year_mean"]) == (6, 6.4, 50.0, 2021, 5.0)
    kept = summaries.stats_having(reviews, ["seat"], [F.avg("rating").alias("m")], 3, "rating")
    assert [r["seat"] for r in kept.collect()] == ["Economy"]
    assert {r["field"]: r["missing_pct"] for r in summaries.sentinel_share(reviews, ["rec", "who"]).collect()} == {"rec": pytest.approx(100 / 6), "who": 0.0}


def test_measures(reviews):
    idx = measures.minmax_index(reviews, "rating").filter("rating = 8").first()["sentiment_index"]
    assert idx == pytest.approx(75.0)
    flat = measures.minmax_index(reviews.filter("rating = 8"), "rating").first()["sentiment_index"]
    assert flat is None
    yoy = {r["year"]: r["yoy_change"] for r in measures.yoy(reviews, "year", "rating").collect()}
    assert yoy == {2019: None, 2021: None}  # 2020 is missing, so 2021 has no year before
    gap = measures.advocacy_gap(reviews, [], "rating", "rec").first()
    assert gap["recommend_pct"] == 50.0 and gap["advocacy_gap"] == pytest.approx(50 - gap["index_avg"])
    cap = measures.captive(reviews.withColumn("s", F.col("rating") - 9), [], "s", "rec").first()
    assert (cap["captive"], cap["advocates"]) == (1, 3)
    assert [r["seat"] for r in measures.dissatisfied_markets(reviews, "seat", "rating", 3, 5).collect()] == ["Economy"]


def test_mode_and_cluster_tables(spark):
    df = spark.createDataFrame(
        [(0, "L", 5.0, 0.1, "Yes", "b", "r1", 1, "x"), (0, "L", None, -0.1, None, "a", "r2", 2, "y"), (1, "L", 1.0, 0.0, "No", None, "r2", 3, "z")],
        "c int, l string, rating double, s double, rec string, cabin string, route string, id int, t string",
    )
    got = {r["cluster_id"]: r for r in clusters.summary(df, "complaint", "c", "l", "rating", "s", "rec", "cabin", "route", "id", "t").collect()}
    assert got[0]["top_cabin"] == "a" and got[0]["top_route"] == "r1" and got[0]["examples"] == "x | y"  # ties go by key
    assert got[1]["top_cabin"] is None and got[0]["pct_of_total"] == 66.7 and got[0]["pct_recommended"] == 50.0
    assert summaries.cluster_stats(df, ["l"], "rating", "s", "rec").first()["frequency"] == 3

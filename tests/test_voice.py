import math

import json

import pytest
from pyspark.sql import functions as F

from voxfare.operators import voice
from voxfare.sources import schemas

FULL = {
    "sentiment_overall": "mixed", "sentiment_score": 0.25, "emotion_primary": "neutral", "is_sarcastic": False,
    "sarcasm_flag_reason": None, "product_themes": {t: "neutral" for t in schemas.THEMES}, "top_complaint": "slow boarding",
    "top_praise": None, "sentiment_keywords": {"positive_words": ["kind", "clean"], "negative_words": None},
    "competitor_mentioned": True, "competitor_name": "Other Air", "competitor_sentiment": "neutral",
    "would_rebook_signal": "maybe", "service_recovery_mentioned": False, "loyalty_program_mentioned": None,
    "product_implications": ["board faster", "warm the meals"],
}




@pytest.mark.parametrize(
    "given, wanted",
    [("```json\n{}\n```", "{}"), ("```\n{}\n```", "{}"), ("  {} ", "{}"), ("{} ```x```", "{} ```x```"), ("```json{}", "{}"), ("", "")],
)
def test_strip_fence(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(voice.strip_fence("x").alias("o")).first()["o"] == wanted


def test_parse_merge_flatten(spark):
    good_reply = "```json\n" + json.dumps(FULL) + "\n```"
    df = spark.createDataFrame(
        [(1, "Economy", 2020, good_reply), (2, "First", 2021, "Sorry, no"), (3, "First", 2021, '{"sentiment_score": "high"}'),
         (4, "First", 2021, None), (5, "First", 2022, '{"sentiment_overall": "positive", "extra": 1}')],
        "review_id int, seat_type string, year int, reply string",
    )
    good, bad = voice.parse_reply(df, "reply")
    assert {r["review_id"] for r in bad.collect()} == {2, 3, 4}
    assert {(r["review_id"], r["raw"]) for r in bad.collect()} >= {(2, "Sorry, no")}
    flat = voice.flatten(voice.merge_fields(good, ["review_id", "seat_type", "year"]))
    assert len(flat.columns) == 46
    got = {r["review_id"]: r for r in flat.collect()}
    assert set(got) == {1, 5}
    r = got[1]
    assert r["positive_keywords"] == "kind | clean" and r["negative_keywords"] == ""
    assert r["product_implications"] == "board faster | warm the meals"
    assert r["theme_wifi"] == "neutral" and r["sentiment_score"] == 0.25 and r["competitor_mentioned"] is True
    assert got[5]["sentiment_overall"] == "positive" and got[5]["theme_wifi"] is None and got[5]["positive_keywords"] == ""
    assert len(schemas.EXTRACTION.fields) == 16  # parsing leaves the shared schema alone


def test_extracted_field_wins_on_clash(spark):
    df = spark.createDataFrame([(1, "mine", '{"top_praise": "theirs"}')], "review_id int, top_praise string, reply string")
    good, _ = voice.parse_reply(df, "reply")
    assert voice.merge_fields(good, ["review_id", "top_praise"]).first()["top_praise"] == "theirs"


def test_prompt(spark):
    df = spark.createDataFrame([("Peru", None)], "c string, r double")
    out = df.select(voice.prompt("From {c}: {r}/10 {c}", {"c": "c", "r": "r"}).alias("p")).first()["p"]
    assert out == "From Peru: Not stated/10 Peru"


def test_extract_hook(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string").repartition(4)
    out = voice.extract(df, "prompt", "reply", lambda s: s.str.upper())
    assert {(r["i"], r["reply"]) for r in out.collect()} == {(i, f"P{i}") for i in range(20)}


def test_explode_rank_and_combine(spark, rows):
    df = spark.createDataFrame(
        [(1, " Kind |clean| ", "rude"), (2, "KIND", None), (3, "", " "), (4, "clean|kind", "rude|late")], "review_id int, p string, n string"
    )
    pos = voice.explode_terms(df, "p", "positive", ["review_id"])
    neg = voice.explode_terms(df, "n", "negative", ["review_id"])
    assert rows(pos, "review_id", "keyword") == [(1, "clean"), (1, "kind"), (2, "kind"), (4, "clean"), (4, "kind")]
    ranked = {r["keyword"]: (r["frequency"], r["rank_global"]) for r in voice.ranked_terms(pos).collect()}
    assert ranked == {"kind": (3, 1), "clean": (2, 2)}
    both = voice.combined_terms(voice.ranked_terms(pos), voice.ranked_terms(neg))
    assert both.count() == 8
    assert {(r["sentiment_type"], r["keyword"], r["freq_within_type"]) for r in both.collect()} == {
        ("positive", "kind", 3), ("positive", "clean", 2), ("negative", "rude", 2), ("negative", "late", 1)
    }


def test_complaints_share_one_filter(spark, rows):
    df = spark.createDataFrame([(1, "Rude Staff"), (2, "none"), (3, " rude staff "), (4, "null"), (5, None), (6, "Cold food"), (7, "ok")], "id int, c string")
    assert rows(voice.voice_frequency(df, "c", "complaint"), "complaint", "frequency", "rank") == [("cold food", 1, 2), ("rude staff", 2, 1)]
    assert rows(voice.voice_detail(df, "c", ["id"]), "id", "c", "frequency", "rank") == [
        (1, "rude staff", 2, 1), (3, "rude staff", 2, 1), (6, "cold food", 1, 2)
    ]


def test_cluster_terms_ties_by_first_place(spark):
    df = spark.createDataFrame(
        [(1, 0, "cold food cold tray"), (2, 0, "food late tray"), (3, 1, "the flight acme was"), (4, 2, "Wifi slow")], "id int, c int, t string"
    )
    got = {r["c"]: r["cluster_label"] for r in voice.cluster_terms(df, "t", "c", "id", brand_words=["Acme"]).collect()}
    assert got == {0: "Cold Food Tray", 1: "General Complaint", 2: "Wifi Slow"}


def test_examples_and_weights(spark):
    df = spark.createDataFrame([(i, 0, f"t{i}") for i in range(9, 0, -1)], "id int, c int, t string")
    assert voice.cluster_examples(df, "c", "id", "t").first()["examples"] == "t1 | t2 | t3"
    lists = spark.createDataFrame([(["good food", "food"],), (["late"],), (None,)], "w array<string>")
    assert [(r["word"], r["n"], r["weight"]) for r in voice.word_weights(lists, "w", 2).collect()] == [("food", 2, 1.0), ("good", 1, 0.5)]


def test_lexicon_by_sentence(spark):
    df = spark.createDataFrame([(1, "The seat was great. Food bad, bad! Wifi."), (2, "Nothing here")], "id int, t string")
    got = {r["id"]: r for r in voice.lexicon_extract(df, "t", ["great"], ["bad"], {"seat": ["seat"], "food": ["food"], "wifi": ["wifi"], "crew": ["crew"]}).collect()}
    r = got[1]
    assert (r["theme_seat"], r["theme_food"], r["theme_wifi"], r["theme_crew"]) == ("positive", "negative", "neutral", "not_mentioned")
    assert r["sentiment_overall"] == "negative" and r["sentiment_score"] == pytest.approx(-1 / 3)
    assert r["negative_words"] == ["bad"]
    assert got[2]["sentiment_overall"] == "neutral" and got[2]["sentiment_score"] == 0.0


def test_stratified(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") < 3, "few").otherwise("many").alias("b"))
    out = voice.stratified(df, ["a", "b"], "id", 120)
    got = {(r["a"], r["b"]): r["n"] for r in out.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    assert got == {(a, b): (1 if b == "few" else 10) for a in "012" for b in ("few", "many")}
    assert voice.stratified(df, ["a"], "id", 5).count() == 3  # never less than one per stratum


def test_not_stated_and_years(spark):
    df = spark.createDataFrame([(None, 2015), ("x", None), ("y", 2016)], "a string, year int")
    assert [r["a"] for r in voice.not_stated(df, ["a"]).collect()] == ["Not stated", "x", "y"]
    assert voice.valid_years(df, "year").count() == 1


def test_lists_of_two_kinds_explode_in_one_pass(spark, rows):
    df = spark.createDataFrame([(1, " Good | |FAST", "late"), (2, None, "late|Late "), (3, "", None)], "id int, p string, n string")
    both = voice.explode_typed(df, {"p": "positive", "n": "negative"}, ["id"])
    one = voice.explode_terms(df, "p", "positive", ["id"]).unionByName(voice.explode_terms(df, "n", "negative", ["id"]))
    assert rows(both, "id", "keyword", "sentiment_type") == rows(one, "id", "keyword", "sentiment_type")
    plan = voice.combined_terms(both)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(concat" not in plan  # the lists are cut once, before


def test_term_weights_by_hand(spark):
    docs = [(1, "Crew crew, late seats"), (2, "the crew"), (3, None), (4, "")]
    got = {(r["id"], r["word"]): (r["tf"], r["df"], r["idf"], r["weight"]) for r in voice.term_weights(spark.createDataFrame(docs, "id int, t string"), "t", "id", stop=["the"]).collect()}
    idf = {n: math.log(4 / (n + 1)) for n in (1, 2)}  # three texts
    assert got == {(1, "crew"): (2, 2, idf[2], 2 * idf[2]), (1, "late"): (1, 1, idf[1], idf[1]), (1, "seats"): (1, 1, idf[1], idf[1]), (2, "crew"): (1, 2, idf[2], idf[2])}


def test_extraction_takes_few_prompts_at_a_time(spark):
    sizes = lambda prompts: prompts.map(lambda p: None if p is None else f"{len(prompts)} {p}")
    df = spark.range(1, 1202, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("p"))
    got = {r["id"]: r for r in voice.extract(df, "p", "reply", sizes).collect()}
    assert len(got) == 1201 and all(r["reply"] is None and r["p"] is None for i, r in got.items() if i % 7 == 0)
    assert all(r["reply"].split()[1] == r["p"] == f"t{i}" for i, r in got.items() if i % 7)
    assert {int(r["reply"].split()[0]) for r in got.values() if r["reply"]} == {voice.PROMPTS, 1201 % voice.PROMPTS}

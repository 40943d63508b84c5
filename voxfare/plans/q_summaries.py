"""Trend, segment, mix and market tables over the rating views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfare.functions import dates, scores, text
from voxfare.operators import measures, ranking, summaries
from voxfare.plans.registry import bigint, query, rounded
from voxfare.plans.views import PRIORITIES, SEGMENTS

SCORES = ("rating_10", "seat_comfort", "value_for_money")


def _across(values, expr: str) -> str:
    return ", ".join(f"{expr.format(v)} AS \"{v}\"" for v in values)


@query(
    "yearly_rating_story",
    """SELECT year, round(avg(rating_10), 6) AS mean, median(rating_10) AS median, count(rating_10) AS n,
      round(stddev_samp(rating_10), 6) AS sd,
      round_even(sum(CASE WHEN rating_10 >= 8 THEN 1.0 ELSE 0 END) * 100 / count(rating_10), 1) AS high_pct,
      round_even(sum(CASE WHEN rating_10 <= 3 THEN 1.0 ELSE 0 END) * 100 / count(rating_10), 1) AS low_pct,
      round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS recommend_pct,
      round(avg(rating_10) - stddev_samp(rating_10) * 0.5, 6) AS band_low,
      round(avg(rating_10) + stddev_samp(rating_10) * 0.5, 6) AS band_high,
      CASE WHEN avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100 >= 70 THEN 'green'
        WHEN avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100 >= 60 THEN 'amber' ELSE 'red' END AS recommend_tier
      FROM rated GROUP BY year""",
    ("rated",),
)
def yearly_rating_story(t):
    story = summaries.rating_story(t.rated, "year", "rating_10", "recommended")
    return rounded(story, "mean", "sd", "recommend_pct", "band_low", "band_high")


@query("year_frequency", "SELECT year, count(*) AS n FROM rated GROUP BY year", ("rated",))
def year_frequency(t):
    return summaries.freq(t.rated, ["year"])


@query(
    "traveller_share",
    """SELECT type_of_traveller, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
      FROM reviews GROUP BY type_of_traveller""",
    ("reviews",),
)
def traveller_share(t):
    return rounded(summaries.freq(t.reviews, ["type_of_traveller"], share=True), "share_pct")


@query(
    "recommend_rate_by_cabin",
    """SELECT seat_type, round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS rate_pct,
      count(*) AS n FROM rated GROUP BY seat_type""",
    ("rated",),
)
def recommend_rate_by_cabin(t):
    return rounded(summaries.rate(t.rated, ["seat_type"], F.col("recommended") == "Yes"), "rate_pct")


@query(
    "recommend_rate_among_rated",
    """SELECT rating_10, round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS rate_pct,
      count(*) AS n FROM rated WHERE recommended <> 'Not Rated' GROUP BY rating_10""",
    ("rated",),
)
def recommend_rate_among_rated(t):
    yes = F.col("recommended") == "Yes"
    return rounded(summaries.rate(t.rated, ["rating_10"], yes, among=F.col("recommended") != "Not Rated"), "rate_pct")


@query(
    "mean_of_yearly_means",
    """SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(rating_10) AS m FROM rated GROUP BY year)""",
    ("rated",),
)
def mean_of_yearly_means(t):
    return rounded(summaries.mean_of_means(t.rated, "year", "rating_10"), "mean_of_means")


@query(
    "year_cabin_pivot",
    f"""SELECT year, {_across(PRIORITIES, "round(avg(rating_10) FILTER (seat_type = '{0}'), 6)")}
      FROM rated GROUP BY year""",
    ("rated",),
)
def year_cabin_pivot(t):
    return rounded(summaries.pivot_mean(t.rated, "year", "seat_type", "rating_10", PRIORITIES), *PRIORITIES)


@query(
    "seasonality_quarter_pivot",
    """SELECT year, round(avg(rating_10) FILTER (quarter = 1), 6) AS q1, round(avg(rating_10) FILTER (quarter = 2), 6) AS q2,
      round(avg(rating_10) FILTER (quarter = 3), 6) AS q3, round(avg(rating_10) FILTER (quarter = 4), 6) AS q4
      FROM rated GROUP BY year""",
    ("rated",),
)
def seasonality_quarter_pivot(t):
    labelled = t.rated.withColumn("q", F.concat(F.lit("q"), F.col("quarter")))
    cols = ["q1", "q2", "q3", "q4"]
    return rounded(summaries.pivot_mean(labelled, "year", "q", "rating_10", cols), *cols)


@query(
    "month_profile",
    """SELECT month, round(avg(rating_10), 6) AS mean, count(rating_10) AS n FROM rated GROUP BY month""",
    ("rated",),
)
def month_profile(t):
    return rounded(summaries.profile(t.rated, ["month"], ["rating_10"], ("mean", "n")), "mean")


@query(
    "cabin_scorecard",
    """SELECT seat_type, metric, round(avg(v), 6) AS mean FROM (
      SELECT seat_type, 'rating_10' AS metric, rating_10 AS v FROM scored
      UNION ALL SELECT seat_type, 'seat_comfort', seat_comfort FROM scored
      UNION ALL SELECT seat_type, 'value_for_money', value_for_money FROM scored) GROUP BY ALL""",
    ("scored",),
)
def cabin_scorecard(t):
    return rounded(summaries.profile_long(t.scored, ["seat_type"], SCORES), "mean")


@query(
    "traveller_scores",
    """SELECT type_of_traveller, round(avg(rating_10), 6) AS rating_10, round(avg(seat_comfort), 6) AS seat_comfort,
      round(avg(value_for_money), 6) AS value_for_money FROM scored_reviews GROUP BY type_of_traveller""",
    ("scored_reviews",),
)
def traveller_scores(t):
    return rounded(summaries.profile(t.scored_reviews, ["type_of_traveller"], SCORES), *SCORES)


@query(
    "band_scores",
    """SELECT CASE WHEN rating_10 > 0 AND rating_10 <= 3 THEN 'Low (1–3)' WHEN rating_10 <= 6 THEN 'Mid (4–6)'
        WHEN rating_10 <= 8 THEN 'High (7–8)' WHEN rating_10 <= 10 THEN 'Top (9–10)' END AS rating_band,
      CASE WHEN rating_10 > 0 AND rating_10 <= 3 THEN 1 WHEN rating_10 <= 6 THEN 2
        WHEN rating_10 <= 8 THEN 3 WHEN rating_10 <= 10 THEN 4 END AS band_order,
      round(avg(seat_comfort), 6) AS seat_comfort, round(avg(value_for_money), 6) AS value_for_money
      FROM scored GROUP BY 1, 2""",
    ("scored",),
)
def band_scores(t):
    banded = t.scored.withColumn("rating_band", scores.band("rating_10")).withColumn(
        "band_order", scores.band_order("rating_10")
    )
    cols = ("seat_comfort", "value_for_money")
    return rounded(summaries.profile(banded, ["rating_band", "band_order"], cols), *cols)


@query(
    "cabin_gap_by_year",
    """SELECT year, round(avg(rating_10) FILTER (seat_type = '1-URGENT'), 6) AS "1-URGENT",
      round(avg(rating_10) FILTER (seat_type = '5-LOW'), 6) AS "5-LOW",
      round(avg(rating_10) FILTER (seat_type = '1-URGENT') - avg(rating_10) FILTER (seat_type = '5-LOW'), 6) AS gap
      FROM rated GROUP BY year HAVING gap IS NOT NULL""",
    ("rated",),
)
def cabin_gap_by_year(t):
    ends = ["1-URGENT", "5-LOW"]
    wide = summaries.pivot_mean(t.rated, "year", "seat_type", "rating_10", ends)
    return rounded(summaries.gap(wide, *ends), *ends, "gap")


@query(
    "segment_vs_rest",
    """SELECT year, round(avg(rating_10) FILTER (type_of_traveller = 'MACHINERY'), 6) AS segment_mean,
      round(avg(rating_10) FILTER (type_of_traveller IS DISTINCT FROM 'MACHINERY'), 6) AS rest_mean,
      round(avg(rating_10), 6) AS global_mean FROM reviews GROUP BY year""",
    ("reviews",),
)
def segment_vs_rest(t):
    out = summaries.segment_vs_rest(t.reviews, F.col("type_of_traveller") == "MACHINERY", "year", "rating_10")
    return rounded(out, "segment_mean", "rest_mean", "global_mean")


@query(
    "crosstab_counts",
    f"""SELECT type_of_traveller, {_across(PRIORITIES, "count(*) FILTER (seat_type = '{0}')")},
      count(*) FILTER (seat_type IN ({', '.join(repr(p) for p in PRIORITIES)})) AS total
      FROM reviews GROUP BY type_of_traveller""",
    ("reviews",),
)
def crosstab_counts(t):
    return summaries.with_row_total(
        summaries.crosstab(t.reviews, "type_of_traveller", "seat_type", PRIORITIES), PRIORITIES
    )


@query(
    "mix_share_by_year",
    """SELECT year, type_of_traveller, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY year), 6) AS share_pct
      FROM reviews GROUP BY year, type_of_traveller""",
    ("reviews",),
)
def mix_share_by_year(t):
    return rounded(summaries.mix(t.reviews, ["year", "type_of_traveller"], ["year"]), "share_pct")


@query(
    "group_mix",
    """SELECT cabin_class, test_group, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY test_group), 6) AS share_pct
      FROM trial GROUP BY cabin_class, test_group""",
    ("trial",),
)
def group_mix(t):
    return rounded(summaries.mix(t.trial, ["cabin_class", "test_group"], ["test_group"]), "share_pct")


@query(
    "score_distribution",
    """SELECT seat_type, value_for_money, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY seat_type), 6) AS share_pct
      FROM scored WHERE value_for_money IS NOT NULL GROUP BY seat_type, value_for_money""",
    ("scored",),
)
def score_distribution(t):
    return rounded(summaries.mix(t.scored, ["seat_type", "value_for_money"], ["seat_type"]), "share_pct")


@query(
    "market_stats_having",
    """SELECT reviewer_country, count(rating_10) AS n, round(avg(rating_10), 6) AS mean,
      round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS recommend_pct,
      CASE WHEN avg(rating_10) >= 7 THEN 'green' WHEN avg(rating_10) >= 5.5 THEN 'amber' ELSE 'red' END AS tier
      FROM reviews GROUP BY reviewer_country HAVING count(rating_10) >= 15""",
    ("reviews",),
)
def market_stats_having(t):
    aggs = [F.avg("rating_10").alias("mean"), (F.avg(scores.holds(F.col("recommended") == "Yes")) * 100).alias("recommend_pct")]
    out = summaries.stats_having(t.reviews, ["reviewer_country"], aggs, 15, "rating_10")
    return rounded(out.withColumn("tier", scores.tier("mean", 7, 5.5)), "mean", "recommend_pct")


@query(
    "category_alignment",
    """SELECT d.ord, d.type_of_traveller, round(m.mean, 6) AS mean FROM
      (VALUES (1, 'MACHINERY'), (2, 'NO SUCH SEGMENT'), (3, 'BUILDING')) d(ord, type_of_traveller)
      LEFT JOIN (SELECT type_of_traveller, avg(rating_10) AS mean FROM reviews GROUP BY 1) m USING (type_of_traveller)""",
    ("reviews",),
)
def category_alignment(t):
    means = summaries.profile(t.reviews, ["type_of_traveller"], ["rating_10"])
    return rounded(summaries.align(means, "type_of_traveller", ["MACHINERY", "NO SUCH SEGMENT", "BUILDING"]), "mean")


@query(
    "sentinel_sparsity",
    """SELECT 'wifi_text' AS field, round(avg(CASE WHEN wifi_text = 'Not Rated' THEN 1.0 ELSE 0 END) * 100, 6) AS missing_pct FROM scored
      UNION ALL SELECT 'recommended', round(avg(CASE WHEN recommended = 'Not Rated' THEN 1.0 ELSE 0 END) * 100, 6) FROM scored""",
    ("scored",),
)
def sentinel_sparsity(t):
    return rounded(summaries.sentinel_share(t.scored, ["wifi_text", "recommended"]), "missing_pct")


@query(
    "typed_coercion",
    """SELECT year, count(TRY_CAST(wifi_text AS DOUBLE)) AS rated, count(*) FILTER (wifi_text = 'Not Rated') AS not_rated,
      round(avg(TRY_CAST(wifi_text AS DOUBLE)), 6) AS mean FROM scored GROUP BY year""",
    ("scored",),
)
def typed_coercion(t):
    typed = t.scored.withColumn("wifi", scores.to_double("wifi_text"))
    out = typed.groupBy("year").agg(
        F.count("wifi").alias("rated"),
        F.count_if(scores.is_not_rated("wifi_text")).alias("not_rated"),
        F.avg("wifi").alias("mean"),
    )
    return rounded(out, "mean")


@query(
    "group_profile_full",
    """SELECT recommended, count(rating_10) AS n, round(avg(rating_10), 6) AS mean, round(stddev_samp(rating_10), 6) AS sd
      FROM rated WHERE recommended IN ('Yes', 'No') GROUP BY recommended""",
    ("rated",),
)
def group_profile_full(t):
    """The verified-versus-unverified comparison on a two-valued label."""
    kept = t.rated.filter(F.col("recommended").isin("Yes", "No"))
    return rounded(summaries.profile(kept, ["recommended"], ["rating_10"], ("mean", "n", "sd")), "mean", "sd")


@query(
    "kpi_row",
    """WITH y AS (SELECT year, avg(rating_10) AS m FROM rated GROUP BY year)
      SELECT count(*) AS reviews, round(avg(rating_10), 6) AS mean_rating,
      round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS recommend_pct,
      (SELECT year FROM y ORDER BY m, year LIMIT 1) AS worst_year, (SELECT round(min(m), 6) FROM y) AS worst_year_mean
      FROM rated""",
    ("rated",),
)
def kpi_row(t):
    return rounded(summaries.kpi_row(t.rated, "year", "rating_10", "recommended"), "mean_rating", "recommend_pct", "worst_year_mean")


@query(
    "category_trends_by_year",
    """SELECT year, round(avg(rating_10), 6) AS rating_10, round(avg(seat_comfort), 6) AS seat_comfort,
      round(avg(value_for_money), 6) AS value_for_money FROM scored GROUP BY year""",
    ("scored",),
)
def category_trends_by_year(t):
    return rounded(summaries.profile(t.scored, ["year"], SCORES), *SCORES)


@query(
    "month_group_pivot",
    """SELECT month, round(avg(meal_satisfaction) FILTER (test_group = 'Control'), 6) AS "Control",
      round(avg(meal_satisfaction) FILTER (test_group = 'Treatment'), 6) AS "Treatment" FROM trial GROUP BY month""",
    ("trial",),
)
def month_group_pivot(t):
    arms = ["Control", "Treatment"]
    return rounded(summaries.pivot_mean(t.trial, "month", "test_group", "meal_satisfaction", arms), *arms)


@query(
    "calendar_parts",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(quarter(l_shipdate) AS BIGINT) AS quarter,
      CAST(month(l_shipdate) AS BIGINT) AS month, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def calendar_parts(t):
    parts = dates.calendar("l_shipdate")
    return bigint(t.lineitem.select(*[c.alias(n) for n, c in parts.items()]), *parts).groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- ranks, routes, set operations

@query(
    "topk_frequency",
    """SELECT reviewer_country, count(*) AS n FROM reviews GROUP BY reviewer_country ORDER BY n DESC, reviewer_country LIMIT 10""",
    ("reviews",),
)
def topk_frequency(t):
    return summaries.freq(t.reviews, ["reviewer_country"], k=10)


@query(
    "route_top_bottom",
    """WITH s AS (SELECT route, count(metric) AS n, avg(metric) AS m FROM routes GROUP BY route HAVING count(metric) >= 5),
      best AS (SELECT * FROM s ORDER BY m DESC, route LIMIT 10), worst AS (SELECT * FROM s ORDER BY m, route LIMIT 10)
      SELECT route, n, round(m, 6) AS mean FROM (SELECT * FROM best UNION SELECT * FROM worst)""",
    ("routes",),
)
def route_top_bottom(t):
    table = summaries.stats_having(t.routes, ["route"], [F.avg("metric").alias("mean")], 5, "metric")
    return rounded(ranking.top_bottom(table, "mean", ["route"], 10), "mean")


@query(
    "route_ends",
    """SELECT trim(string_split(route, ' to ')[1]) AS origin, trim(string_split(route, ' to ')[-1]) AS destination,
      count(*) AS n FROM routes GROUP BY 1, 2""",
    ("routes",),
)
def route_ends(t):
    ends = t.routes.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return (
        ends.select(scores.route_origin("route").alias("origin"), scores.route_destination("route").alias("destination"), "n")
        .groupBy("origin", "destination")
        .agg(F.sum("n").alias("n"))
    )


@query(
    "top_aircraft_pivot",
    f"""WITH top6 AS (SELECT aircraft FROM routes GROUP BY aircraft ORDER BY count(*) DESC, aircraft LIMIT 6)
      SELECT aircraft, {_across(PRIORITIES, "round(avg(metric) FILTER (seat_type = '{0}'), 6)")}
      FROM routes WHERE aircraft IN (SELECT aircraft FROM top6) GROUP BY aircraft""",
    ("routes",),
)
def top_aircraft_pivot(t):
    kept = ranking.among_top(t.routes, "aircraft", 6)
    return rounded(summaries.pivot_mean(kept, "aircraft", "seat_type", "metric", PRIORITIES), *PRIORITIES)


@query(
    "name_map_and_maker",
    """SELECT CASE p_brand WHEN 'Brand#1' THEN 'B1' WHEN 'Brand#2' THEN 'B2' ELSE p_brand END AS short_name,
      CASE WHEN p_type LIKE 'S%' THEN 'Small or standard' WHEN p_type LIKE 'E%' THEN 'Economy' ELSE 'Unknown' END AS maker,
      CASE p_type WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' END AS strict_code, count(*) AS n FROM part GROUP BY 1, 2, 3""",
)
def name_map_and_maker(t):
    named = t.part.select(
        scores.replace_map("p_brand", {"Brand#1": "B1", "Brand#2": "B2"}).alias("short_name"),
        scores.prefix_class("p_type", {"S": "Small or standard", "E": "Economy"}).alias("maker"),
        scores.strict_map("p_type", {"SMALL": "s", "LARGE": "l"}).alias("strict_code"),
    )
    return named.groupBy("short_name", "maker", "strict_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "brand_dense_rank",
    """SELECT p_brand, frequency, CAST(dense_rank() OVER (ORDER BY frequency DESC) AS INTEGER) AS rank
      FROM (SELECT p_brand, count(*) AS frequency FROM part GROUP BY p_brand)""",
)
def brand_dense_rank(t):
    counts = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("frequency"))
    return ranking.dense_ranks(counts, "frequency", "rank")


@query(
    "distinct_keys",
    """SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem""",
)
def distinct_keys(t):
    return t.lineitem.agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query(
    "resume_anti_join",
    """SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang""",
)
def resume_anti_join(t):
    todo = ranking.unprocessed(t.documents.select("doc_id", "lang"), t.labels, "doc_id")
    return todo.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_sources",
    """SELECT kind, count(*) AS n, count(nation) AS with_nation FROM (
      SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'part', NULL FROM part) GROUP BY kind""",
)
def union_sources(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    b = t.part.select(F.lit("part").alias("kind"))
    rows = ranking.union_all(a, b)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("nation").alias("with_nation"))


# ---------------------------------------------------------------- headline measures

@query(
    "sentiment_index",
    """WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
      SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 100, 6) AS sentiment_index FROM orders, l""",
)
def sentiment_index(t):
    out = measures.minmax_index(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rounded(out.drop("o_totalprice"), "sentiment_index")


@query(
    "advocacy_gap",
    """WITH l AS (SELECT min(rating_10) AS lo, max(rating_10) AS hi FROM rated)
      SELECT seat_type, round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 6) AS recommend_pct,
      round(avg((rating_10 - lo) / (hi - lo) * 100), 6) AS index_avg,
      round(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100 - avg((rating_10 - lo) / (hi - lo) * 100), 6) AS advocacy_gap
      FROM rated, l GROUP BY seat_type""",
    ("rated",),
)
def advocacy_gap(t):
    out = measures.advocacy_gap(t.rated, ["seat_type"], "rating_10", "recommended")
    return rounded(out, "recommend_pct", "index_avg", "advocacy_gap")


@query(
    "yoy_change",
    """WITH y AS (SELECT year, avg(rating_10) AS m FROM rated GROUP BY year)
      SELECT a.year, round(a.m, 6) AS mean, round(b.m, 6) AS prior_mean, round(a.m - b.m, 6) AS yoy_change
      FROM y a LEFT JOIN y b ON b.year = a.year - 1""",
    ("rated",),
)
def yoy_change(t):
    return rounded(measures.yoy(t.rated, "year", "rating_10"), "mean", "prior_mean", "yoy_change")


@query(
    "captive_advocates",
    """SELECT seat_type, count(*) FILTER (recommended = 'Yes' AND sentiment_score < 0) AS captive,
      count(*) FILTER (recommended = 'Yes') AS advocates,
      round(count(*) FILTER (recommended = 'Yes' AND sentiment_score < 0) * 100.0 / nullif(count(*) FILTER (recommended = 'Yes'), 0), 6) AS captive_pct
      FROM voice GROUP BY seat_type""",
    ("voice",),
)
def captive_advocates(t):
    return rounded(measures.captive(t.voice, ["seat_type"], "sentiment_score", "recommended"), "captive_pct")


@query(
    "dissatisfied_markets",
    """SELECT reviewer_country, count(rating_10) AS n, round(avg(rating_10), 6) AS mean FROM reviews
      GROUP BY reviewer_country HAVING count(rating_10) >= 30 AND avg(rating_10) < 5.5""",
    ("reviews",),
)
def dissatisfied_markets(t):
    return rounded(measures.dissatisfied_markets(t.reviews, "reviewer_country", "rating_10", 30, 5.5), "mean")


@query(
    "sentiment_by_cabin",
    """SELECT seat_type, sentiment_overall, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY seat_type), 6) AS share_pct
      FROM voice GROUP BY seat_type, sentiment_overall""",
    ("voice",),
)
def sentiment_by_cabin(t):
    return rounded(summaries.mix(t.voice, ["seat_type", "sentiment_overall"], ["seat_type"]), "share_pct")


@query(
    "segment_dimension_mix",
    f"""SELECT year, {_across(SEGMENTS, "count(*) FILTER (type_of_traveller = '{0}')")} FROM reviews GROUP BY year""",
    ("reviews",),
)
def segment_dimension_mix(t):
    return summaries.crosstab(t.reviews, "year", "type_of_traveller", SEGMENTS)


@query(
    "yearly_sentiment",
    """SELECT year, round(avg(sentiment_score), 6) AS sentiment_score, round(avg(overall_rating_10), 6) AS overall_rating_10 FROM voice GROUP BY year""",
    ("voice",),
)
def yearly_sentiment(t):
    cols = ("sentiment_score", "overall_rating_10")
    return rounded(summaries.profile(t.voice, ["year"], cols), *cols)


@query(
    "length_by_band",
    """SELECT CASE WHEN overall_rating_10 <= 3 THEN 'Low (1–3)' WHEN overall_rating_10 <= 6 THEN 'Mid (4–6)'
        WHEN overall_rating_10 <= 8 THEN 'High (7–8)' ELSE 'Top (9–10)' END AS rating_band,
      round(avg(length(text)), 6) AS mean, count(*) AS n FROM voice_base GROUP BY 1""",
    ("voice_base",),
)
def length_by_band(t):
    sized = t.voice_base.select(
        scores.band("overall_rating_10").alias("rating_band"), text.text_length("text").alias("review_len")
    )
    return rounded(summaries.profile(sized, ["rating_band"], ["review_len"], ("mean", "n")), "mean")


@query(
    "sarcasm_frequency",
    """SELECT CASE WHEN is_sarcastic THEN 'sarcastic' ELSE 'plain' END AS tone, count(*) AS n,
      round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM voice_base GROUP BY 1""",
    ("voice_base",),
)
def sarcasm_frequency(t):
    toned = t.voice_base.select(F.when(F.col("is_sarcastic"), "sarcastic").otherwise("plain").alias("tone"))
    return rounded(summaries.freq(toned, ["tone"], share=True), "share_pct")

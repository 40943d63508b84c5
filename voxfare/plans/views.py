"""The feedback tables the queries run on, derived from the given tables; each also as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfare.functions import text
from voxfare.sources.files import spread
from voxfare.operators.voice import lexicon_extract, once

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Words of the sample documents that stand in for a sentiment lexicon and for theme words.
POSITIVE = ("and", "que", "und", "best", "with", "pour")
NEGATIVE = ("was", "des", "von", "worthless", "disgusting", "stupid", "from")
THEME_WORDS = {
    "seat_comfort": ("this",),
    "cabin_crew": ("are",),
    "food_beverage": ("for",),
    "ife": ("that",),
    "wifi": ("les",),
    "lounge": ("der",),
    "boarding": ("die",),
    "cleanliness": ("elle",),
    "value": ("sch",),
    "punctuality": ("ein",),
}


class Tables:
    """The given tables by attribute, and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            setattr(self, name, df)  # one schema look-up per table
            return df
        raise AttributeError(name)

    @cached_property
    def rated(self) -> DataFrame:
        """Orders as ratings, without the customer's side."""
        o = self.orders
        when = F.col("o_orderdate")
        return o.select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_custkey"),
            when.cast("date").alias("review_date"),
            F.year(when).cast("bigint").alias("year"),
            F.month(when).cast("bigint").alias("month"),
            F.quarter(when).cast("bigint").alias("quarter"),
            F.least(F.lit(10.0), 1 + F.floor(F.col("o_totalprice") / 50000)).cast("double").alias("rating_10"),
            F.when(F.col("o_orderstatus") == "F", "Yes")
            .when(F.col("o_orderstatus") == "O", "No")
            .otherwise("Not Rated")
            .alias("recommended"),
            F.col("o_orderpriority").alias("seat_type"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        c = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey",
            "c_name",
            F.col("c_mktsegment").alias("type_of_traveller"),
            F.col("n_name").alias("reviewer_country"),
        )
        return self.rated.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")

    @cached_property
    def line_scores(self) -> DataFrame:
        """Line averages per order as scores, one of them as text with the sentinel."""
        return (
            self.lineitem.groupBy("l_orderkey")
            .agg(
                (1 + F.floor(F.avg("l_quantity") / 10.01)).cast("double").alias("seat_comfort"),
                (1 + F.floor(F.round(F.avg("l_discount"), 9) / 0.0201)).cast("double").alias("value_for_money"),
                F.min("l_discount").alias("__least"),
            )
            .select(
                "l_orderkey", "seat_comfort", "value_for_money",
                F.when(F.col("__least") == 0, "Not Rated")
                .otherwise(F.col("value_for_money").cast("bigint").cast("string"))
                .alias("wifi_text"),
            )
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.rated.join(self.line_scores, F.col("review_id") == F.col("l_orderkey"), "left").drop("l_orderkey")

    @cached_property
    def scored_reviews(self) -> DataFrame:
        return self.reviews.join(self.line_scores, F.col("review_id") == F.col("l_orderkey"), "left").drop("l_orderkey")

    @cached_property
    def routes(self) -> DataFrame:
        """One row per line: customer's nation to supplier's nation, brand, and quantity as the metric."""
        origin = self.nation.select(F.col("n_nationkey").alias("on"), F.col("n_name").alias("origin"))
        target = self.nation.select(F.col("n_nationkey").alias("tn"), F.col("n_name").alias("target"))
        buyers = self.customer.join(origin, F.col("c_nationkey") == F.col("on")).select("c_custkey", "origin")
        sellers = self.supplier.join(target, F.col("s_nationkey") == F.col("tn")).select("s_suppkey", "target")
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        return (
            lines.join(self.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
            .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat("origin", F.lit(" to "), "target").alias("route"),
                F.col("p_brand").alias("aircraft"),
                F.col("o_orderpriority").alias("seat_type"),
                F.col("l_quantity").alias("metric"),
            )
        )

    @cached_property
    def trial(self) -> DataFrame:
        """Lines as an experiment: line status is the arm."""
        return self.lineitem.select(
            "l_orderkey",
            F.when(F.col("l_linestatus") == "F", "Control").otherwise("Treatment").alias("test_group"),
            F.col("l_quantity").alias("meal_satisfaction"),
            F.col("l_extendedprice").alias("spend"),
            (F.col("l_returnflag") == "R").cast("int").alias("meal_complaint"),
            F.col("l_discount").alias("meal_finish_rate"),
            F.col("l_tax").alias("overall_sat_impact"),
            F.col("l_returnflag").alias("cabin_class"),
            F.month("l_shipdate").cast("bigint").alias("month"),
        )

    @cached_property
    def trial_tiers(self) -> DataFrame:
        who = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", F.col("c_mktsegment").alias("loyalty_tier"), F.col("o_orderpriority").alias("route")
        )
        return self.trial.join(who, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")

    @cached_property
    def trial_by_order(self) -> DataFrame:
        """The trial per order, which gives its rows a unique key: arm of the last line, mean quantity."""
        return (
            self.trial.groupBy("l_orderkey")
            .agg(F.max("test_group").alias("test_group"), F.avg("meal_satisfaction").alias("meal_satisfaction"))
            .withColumnRenamed("l_orderkey", "row_key")
        )

    @cached_property
    def voice_base(self) -> DataFrame:
        """Documents with their labels as reviews with text."""
        d = spread(self.documents).join(self.labels, "doc_id", "left")
        return d.select(
            F.col("doc_id").alias("review_id"),
            "text",
            F.col("lang").alias("seat_type"),
            F.col("source").alias("route"),
            (2016 + F.col("doc_id") % 10).cast("bigint").alias("year"),
            (1 + F.floor(F.col("doc_id") / 10) % 12).cast("bigint").alias("month"),
            (1 + F.col("n_chars") % 10).cast("double").alias("overall_rating_10"),
            F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").otherwise("Not Rated").alias("recommended"),
            (F.col("toxic") == 1).alias("is_sarcastic"),
            F.col("quality"),
        )

    @cached_property
    def voice(self) -> DataFrame:
        """Reviews with sentiment by word counts over the whole text."""
        known = (*POSITIVE, *NEGATIVE)
        base = once(self.voice_base, "__w", F.filter(text.words("text"), lambda w: w.isin(*known)))
        pos = F.filter("__w", lambda w: w.isin(*POSITIVE))
        neg = F.filter("__w", lambda w: w.isin(*NEGATIVE))
        hits = base.withColumn("pos_hits", pos).withColumn("neg_hits", neg).drop("__w")
        p, n = F.size("pos_hits"), F.size("neg_hits")
        return hits.select(
            "*",
            F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0).alias("sentiment_score"),
            F.when((p > 0) & (p == n), "mixed").when(p > n, "positive").when(n > p, "negative").otherwise("neutral").alias("sentiment_overall"),
            F.when(n == 0, "None")
            .when(F.col("quality").isNull() & (n == 1), " null ")
            .otherwise(F.concat(F.lit(" "), F.upper(F.try_element_at("neg_hits", F.lit(1))), F.lit(" in "), F.col("route")))
            .alias("top_complaint"),
            F.when(p == 0, "n/a").otherwise(F.concat(F.try_element_at("pos_hits", F.lit(1)), F.lit(" at "), F.col("seat_type"))).alias("top_praise"),
        )

    @cached_property
    def themed(self) -> DataFrame:
        """Reviews with the ten themes by sentence."""
        return lexicon_extract(self.voice_base, "text", POSITIVE, NEGATIVE, THEME_WORDS)


TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _theme_sql(name: str, words: tuple[str, ...]) -> str:
    about = f"list_filter(sents, lambda s: list_has_any(s, [{', '.join(repr(w) for w in words)}]))"
    return f"flatten({about}) AS a_{name}"


def _theme_case(name: str) -> str:
    p = f"len(list_filter(a_{name}, lambda w: w IN {_in(POSITIVE)}))"
    n = f"len(list_filter(a_{name}, lambda w: w IN {_in(NEGATIVE)}))"
    return (
        f"CASE WHEN len(a_{name}) = 0 THEN 'not_mentioned' WHEN {p} > {n} THEN 'positive' "
        f"WHEN {n} > {p} THEN 'negative' ELSE 'neutral' END AS theme_{name}"
    )


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "rated": (
        (),
        """SELECT o_orderkey AS review_id, o_custkey, CAST(o_orderdate AS DATE) AS review_date,
          CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
          CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
          CAST(least(10, 1 + floor(o_totalprice / 50000)) AS DOUBLE) AS rating_10,
          CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Not Rated' END AS recommended,
          o_orderpriority AS seat_type FROM orders""",
    ),
    "reviews": (
        ("rated",),
        """SELECT r.*, c_name, c_mktsegment AS type_of_traveller, n_name AS reviewer_country
          FROM rated r JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "line_scores": (
        (),
        """SELECT l_orderkey, CAST(1 + floor(avg(l_quantity) / 10.01) AS DOUBLE) AS seat_comfort,
          CAST(1 + floor(round(avg(l_discount), 9) / 0.0201) AS DOUBLE) AS value_for_money,
          CASE WHEN min(l_discount) = 0 THEN 'Not Rated'
            ELSE CAST(CAST(1 + floor(round(avg(l_discount), 9) / 0.0201) AS BIGINT) AS VARCHAR) END AS wifi_text
          FROM lineitem GROUP BY l_orderkey""",
    ),
    "scored": (("rated", "line_scores"), "SELECT * FROM rated LEFT JOIN line_scores ON review_id = l_orderkey"),
    "scored_reviews": (("reviews", "line_scores"), "SELECT * FROM reviews LEFT JOIN line_scores ON review_id = l_orderkey"),
    "routes": (
        (),
        """SELECT cn.n_name || ' to ' || sn.n_name AS route, p_brand AS aircraft, o_orderpriority AS seat_type,
          l_quantity AS metric
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey""",
    ),
    "trial": (
        (),
        """SELECT l_orderkey, CASE l_linestatus WHEN 'F' THEN 'Control' ELSE 'Treatment' END AS test_group,
          l_quantity AS meal_satisfaction, l_extendedprice AS spend, CAST(l_returnflag = 'R' AS INTEGER) AS meal_complaint,
          l_discount AS meal_finish_rate, l_tax AS overall_sat_impact, l_returnflag AS cabin_class,
          CAST(month(l_shipdate) AS BIGINT) AS month FROM lineitem""",
    ),
    "trial_tiers": (
        ("trial",),
        """SELECT t.*, c_mktsegment AS loyalty_tier, o_orderpriority AS route
          FROM trial t JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    ),
    "voice_base": (
        (),
        """SELECT d.doc_id AS review_id, text, lang AS seat_type, source AS route,
          CAST(2016 + d.doc_id % 10 AS BIGINT) AS year, CAST(1 + (d.doc_id // 10) % 12 AS BIGINT) AS month,
          CAST(1 + n_chars % 10 AS DOUBLE) AS overall_rating_10,
          CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Not Rated' END AS recommended,
          toxic = 1 AS is_sarcastic, quality
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "voice": (
        ("voice_base",),
        f"""SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS sentiment_score,
          CASE WHEN p > 0 AND p = n THEN 'mixed' WHEN p > n THEN 'positive' WHEN n > p THEN 'negative'
            ELSE 'neutral' END AS sentiment_overall,
          CASE WHEN n = 0 THEN 'None' WHEN quality IS NULL AND n = 1 THEN ' null '
            ELSE ' ' || upper(neg_hits[1]) || ' in ' || route END AS top_complaint,
          CASE WHEN p = 0 THEN 'n/a' ELSE pos_hits[1] || ' at ' || seat_type END AS top_praise
          FROM (SELECT *, len(pos_hits) AS p, len(neg_hits) AS n FROM (
            SELECT * EXCLUDE (w), list_filter(w, lambda x: x IN {_in(POSITIVE)}) AS pos_hits,
              list_filter(w, lambda x: x IN {_in(NEGATIVE)}) AS neg_hits
            FROM (SELECT *, {TOKENS.format('text')} AS w FROM voice_base)))""",
    ),
    "themed": (
        ("voice_base",),
        f"""SELECT * EXCLUDE ({', '.join(f'a_{t}' for t in THEME_WORDS)}),
          {', '.join(_theme_case(t) for t in THEME_WORDS)}
          FROM (SELECT * EXCLUDE (sents), {', '.join(_theme_sql(t, w) for t, w in THEME_WORDS.items())}
          FROM (SELECT *, list_transform(string_split_regex(lower(text), '[.!?\\n]+'),
            lambda s: {TOKENS.format('s')}) AS sents FROM voice_base))""",
    ),
}


def with_views(names: tuple[str, ...], body: str) -> str:
    """SQL with the named views, and those they need, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in SQL_VIEWS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order)
    lead = body.lstrip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{lead[5:]}"
    return f"WITH {ctes}\n{body}"

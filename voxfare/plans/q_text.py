"""Text cleaning, cards, keywords, complaints, themes, months, prompts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfare.functions import dates, text
from voxfare.operators import ranking, summaries, voice
from voxfare.plans.registry import bigint, day, query, rounded
from voxfare.plans.views import NEGATIVE, POSITIVE, THEME_WORDS, TOKENS, _in
from voxfare.sources import files, html_cards, schemas

MONTH_NAMES = (
    "['January','February','March','April','May','June','July','August','September','October','November','December']"
)
# An order date as it stands on a page: 3 May 1997 with an ordinal suffix.
SUFFIX = """CASE WHEN {d} % 100 IN (11, 12, 13) THEN 'th' WHEN {d} % 10 = 1 THEN 'st' WHEN {d} % 10 = 2 THEN 'nd'
  WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END"""


def _ordinal(d):
    return (
        F.when((d % 100).isin(11, 12, 13), "th")
        .when(d % 10 == 1, "st")
        .when(d % 10 == 2, "nd")
        .when(d % 10 == 3, "rd")
        .otherwise("th")
    )


def _shown(c):
    d = F.dayofmonth(c)
    return F.concat(d.cast("string"), _ordinal(d), F.lit(" "), F.date_format(c, "MMMM yyyy"))


SHOWN_SQL = f"CAST(day({{0}}) AS VARCHAR) || {SUFFIX.format(d='day({0})')} || ' ' || {MONTH_NAMES}[month({{0}})] || ' ' || CAST(year({{0}}) AS VARCHAR)"
PLAIN_SQL = f"CAST(day({{0}}) AS VARCHAR) || ' ' || {MONTH_NAMES}[month({{0}})] || ' ' || CAST(year({{0}}) AS VARCHAR)"


# ---------------------------------------------------------------- cleaning

@query(
    "clean_texts",
    """SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')), ''), 'Not Rated')) AS digest,
      length(text) AS n_chars FROM documents""",
)
def clean_texts(t):
    return t.documents.select(
        "doc_id", F.md5(text.clean_text("text")).alias("digest"), text.text_length("text").cast("bigint").alias("n_chars")
    )


@query(
    "date_texts",
    f"""SELECT o_orderkey, {PLAIN_SQL.format('o_orderdate')} AS shown,
      strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start
      FROM orders""",
)
def date_texts(t):
    """Order dates printed as on a page, then read back."""
    shown = _shown("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        dates.display_date(shown).alias("shown"),
        day(dates.iso_date(day("o_orderdate"))).alias("iso"),
        day(dates.parse_month(F.date_format("o_orderdate", "MMMM yyyy"))).alias("month_start"),
    )


@query(
    "trip_month_fallback",
    f"""SELECT trip_month, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N'
        THEN {MONTH_NAMES}[month(l_shipdate)] || ' ' || CAST(year(l_shipdate) AS VARCHAR)
        ELSE {MONTH_NAMES}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) END AS trip_month,
        CASE WHEN l_returnflag = 'N' THEN l_shipdate ELSE o_orderdate END AS d
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      WHERE date_trunc('month', d) BETWEEN DATE '1996-05-01' AND DATE '2000-05-01' GROUP BY trip_month""",
)
def trip_month_fallback(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flown = F.when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "MMMM yyyy")).otherwise("Not Rated")
    months = ranking.once(rows, "m", dates.trip_month(flown, F.col("o_orderdate").cast("date"))).select("m")
    kept = months.filter(dates.in_months("m", "1996-05-01", "2000-05-01"))
    return kept.groupBy("m").agg(F.count(F.lit(1)).alias("n")).select(dates.format_month("m").alias("trip_month"), "n")


@query(
    "verified_split",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Yes' WHEN 'MACHINERY' THEN 'No' WHEN 'FURNITURE' THEN 'Yes' ELSE 'Not Rated' END AS flag,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN c_name || ' | second part'
        ELSE c_mktsegment || ' | ' || c_name || ' | second part' END AS body FROM customer""",
)
def verified_split(t):
    mark = (
        F.when(F.col("c_mktsegment") == "BUILDING", "Trip  Verified")
        .when(F.col("c_mktsegment") == "FURNITURE", "Verified Review")
        .when(F.col("c_mktsegment") == "MACHINERY", "Not Verified")
        .otherwise(F.col("c_mktsegment"))
    )
    rows = t.customer.withColumn("b", F.concat(mark, F.lit(" | "), "c_name", F.lit(" |  second part ")))
    return rows.select(
        "c_custkey", text.verified_flag(text.clean_text("b")).alias("flag"), text.verified_text("b").alias("body")
    )


@query(
    "country_from_header",
    f"""SELECT o_orderkey, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def country_from_header(t):
    """Headers such as ``7 reviews (x) name (country) date``: the first parentheses mislead."""
    rows = t.reviews
    header = F.concat(F.lit("7 reviews (gold) "), "c_name", F.lit(" ("), "reviewer_country", F.lit(") "), _shown("review_date"))
    return rows.select(
        F.col("review_id").alias("o_orderkey"),
        text.country_from_header(header, "c_name", _shown("review_date")).alias("country"),
    )


@query(
    "dedupe_keep_first",
    """SELECT min(doc_id) AS doc_id, lower(trim(regexp_replace(text, '\\s+$|^\\s+', '', 'g'))) = lower(trim(regexp_replace(any_value(text), '\\s+$|^\\s+', '', 'g'))) AS same
      FROM documents GROUP BY lower(trim(regexp_replace(text, '\\s+$|^\\s+', '', 'g')))""",
)
def dedupe_keep_first(t):
    """First copy of each text, ignoring case and edge space."""
    rows = t.documents.select("doc_id", F.md5(text.norm_key("text")).alias("k"))
    first = ranking.dedupe_first(rows, F.col("k"), "doc_id")
    return first.select("doc_id", F.lit(True).alias("same"))


@query(
    "na_tokens",
    """SELECT event_type, count(*) AS n, count(*) FILTER (props NOT IN ('{"k": 1}', '{"k": 2}')) AS known FROM events GROUP BY event_type""",
)
def na_tokens(t):
    """The missing-value rule on a text column, with two of its values as tokens."""
    rows = files.null_tokens(t.events.select("event_type", "props"), ('{"k": 1}', '{"k": 2}'))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("known"))


@query(
    "label_pivot",
    """SELECT o_orderkey, o_orderpriority AS seat_type, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'Not Rated' END AS recommended,
      coalesce(CAST(CAST(nullif(floor(o_totalprice / 100000), 0) AS BIGINT) AS VARCHAR), 'Not Rated') AS seat_comfort FROM orders""",
)
def label_pivot(t):
    """A label table per review turned into columns: synonyms, stars, yes / no, unknown labels."""
    none = F.lit(None)

    def row(label, stars=none, value=none):
        return F.struct(
            F.lit(label).alias("label"), F.lit(None).cast("string").alias("cls"),
            stars.cast("int").alias("stars"), value.cast("string").alias("value"),
        )

    answer = F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "no").otherwise("maybe")
    attrs = F.array(
        row(" Seat Type ", value=F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))),
        row("Recommended", value=answer),
        row("Seat Comfort", stars=F.floor(F.col("o_totalprice") / 100000)),
        row("No such label", value=F.lit("x")),
    )
    rows = voice.once(t.orders, "e", html_cards.entries(attrs, "airline"))
    fields = ("seat_type", "recommended", "seat_comfort")
    return rows.select("o_orderkey", *[html_cards.pick("e", k).alias(k) for k in fields])


# ---------------------------------------------------------------- pages and cards

@query(
    "page_fields",
    """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
      len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links,
      length(html) AS n_chars FROM pages""",
)
def page_fields(t):
    return t.pages.select(
        "page_id",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"),
        F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("links"),
        text.text_length("html").cast("bigint").alias("n_chars"),
    )


def _card_html(rating, title, name, country, when, body, cabin, status, stars):
    """A review article around columns, with an unclosed paragraph, entities and a nested list."""
    star = F.concat(F.repeat(F.lit('<span class="star fill">1</span>'), stars), F.repeat(F.lit('<span class="star">0</span>'), 5 - stars))
    answer = F.when(status == "F", "yes").when(status == "O", "NO").otherwise("n/a")
    return F.concat(
        F.lit('<article itemprop="review"><meta itemprop="datePublished" content="'), F.date_format(when, "yyyy-MM-dd"),
        F.lit('"><div itemprop="reviewRating"><span itemprop="ratingValue">'), rating,
        F.lit('</span>/<span itemprop="bestRating">10</span></div><h2 class="text_header">&quot;'), title,
        F.lit('&quot;</h2><h3 class="text_sub_header userStatusWrapper"><span itemprop="author"><span itemprop="name">'), name,
        F.lit("</span></span> ("), country, F.lit(') <time itemprop="datePublished" datetime="'), F.date_format(when, "yyyy-MM-dd"),
        F.lit('">'), _shown(when), F.lit('</time></h3><div class="text_content" itemprop="reviewBody"><p><strong>Trip&nbsp;Verified</strong> | '), body,
        F.lit(' &amp; more</div><table class="review-ratings"><tr><td class="review-rating-header cabin_flown">Seat Type</td><td class="review-value">'), cabin,
        F.lit('</td></tr><tr><td class="review-rating-header">Seat Comfort</td><td class="review-rating-stars stars">'), star,
        F.lit('</td></tr><tr><td class="review-rating-header">Recommended</td><td class="review-value rating-no">'), answer,
        F.lit("</td></tr></table></article>"),
    )


# Page furniture around the cards, with a card in a comment and an end tag in a script.
PAGE_HEAD = (
    '<!DOCTYPE html><html><head><title>Reviews</title><script>var t = "</article><article itemprop=review>";</script></head>'
    '<body><nav><ul><li><a href="/a">All</a><li><a href="/b">More</a></ul></nav>'
    '<!-- <article itemprop="review"><h2 class="text_header">old</h2></article> --><article><h2 class="text_header">No review</h2></article>'
)
PAGE_TAIL = '<article class="ad">Ad</article><footer>&copy; pages</footer></body></html>'


# A narrow order becomes a page and two wide cards, which the task sorts in memory before their repeats go.
PAGES_PER_TASK = 20_000


def card_pages(t):
    """A stored page per order: page furniture around the order's card and a repeat of it."""
    card = _card_html(
        F.col("rating_10").cast("int").cast("string"), F.concat(F.lit("Order "), F.col("review_id").cast("string")), F.col("c_name"),
        F.col("reviewer_country"), F.col("review_date"), F.concat("type_of_traveller", F.lit("  trip")), F.col("seat_type"),
        F.when(F.col("recommended") == "Yes", "F").when(F.col("recommended") == "No", "O").otherwise("P"),
        F.floor(F.col("rating_10") / 2).cast("int"),
    )
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.orders.count() // PAGES_PER_TASK))
    spread = t.reviews.repartition(tasks, "review_id") if t.orders.rdd.getNumPartitions() * 2 <= tasks else t.reviews
    return spread.select(
        F.col("review_id").alias("page_id"),
        F.concat(F.lit("https://reviews.example.com/page/"), F.col("review_id").cast("string")).alias("url"),
        F.concat(F.lit(PAGE_HEAD), card, card, F.lit(PAGE_TAIL)).alias("html"),
    )


@query(
    "html_cards",
    f"""SELECT review_id, '{{airline}}' AS airline, {PLAIN_SQL.format('review_date')} AS review_date, strftime(review_date, '%Y-%m-%d') AS review_date_iso,
      {MONTH_NAMES}[month(review_date)] || ' ' || CAST(year(review_date) AS VARCHAR) AS trip_month, c_name AS reviewer_name,
      reviewer_country, 'Order ' || review_id AS review_title, CAST(CAST(rating_10 AS BIGINT) AS VARCHAR) AS overall_rating_10,
      'Yes' AS trip_verified, type_of_traveller || ' trip & more' AS review_text, seat_type,
      coalesce(CAST(CAST(nullif(floor(rating_10 / 2), 0) AS BIGINT) AS VARCHAR), 'Not Rated') AS seat_comfort,
      recommended, 'Not Rated' AS ground_service FROM reviews""".replace("{airline}", "Example Air"),
    ("reviews",),
)
def html_cards_query(t):
    """Cards composed from all orders, parsed, cleaned, filtered by month and freed of their repeats."""
    raw = html_cards.raw_cards(card_pages(t))
    ordered = raw.withColumn("scrape_order", F.col("page_id") * 100 + F.col("card_no"))
    table = html_cards.review_table(ordered, "airline", "Example Air", "scrape_order")
    unquoted = table.withColumn("review_title", text.strip_quotes("review_title"))
    # the other columns would go through the shuffle: a row struct is not pruned
    shown = [
        "airline", "review_date", "review_date_iso", "trip_month", "reviewer_name", "reviewer_country", "review_title", "overall_rating_10",
        "trip_verified", "review_text", "seat_type", "seat_comfort", "ground_service", "recommended",
    ]
    final = html_cards.finish_reviews(unquoted.select(*shown, "page_number", "scrape_order"), "1990-01-01", "2010-12-01")
    return final.select(F.col("page_number").alias("review_id"), *shown[:12], "recommended", "ground_service")


def _stored_pages(t, rows, visit: str):
    """The pages table with a review card put into each page; every seventh card has an unclosed cell, every ninth a nested article."""
    n = F.col("page_id")
    when = F.date_add(F.lit("2015-01-31").cast("date"), (n % 2000).cast("int"))
    label = lambda name, cls="": F.lit(f'<tr><td class="review-rating-header{cls}">{name}</td>')
    value = lambda x: F.concat(F.lit('<td class="review-value">'), x.cast("string"), F.when(n % 7 == 0, "").otherwise("</td>"), F.lit("</tr>"))
    stars = lambda x: F.concat(F.lit('<td class="review-rating-stars">'), F.repeat(F.lit('<span class="star fill">*</span>'), (x % 6).cast("int")), F.lit('<span class="star">*</span></td></tr>'))
    table = [F.concat(label(name, cls), stars(x) if kind == "stars" else value(x)) for name, cls, kind, x in rows(n)]
    card = F.concat(
        F.lit('<article itemprop="review" class="comp"><div itemprop="reviewRating"><span itemprop="ratingValue">'), (n % 10 + 1).cast("string"),
        F.lit('</span>/<span itemprop="bestRating">10</span></div><div class="body"><h2 class="text_header">&quot;Page <i>'), n.cast("string"),
        F.lit('</i>&quot;</h2><h3 class="text_sub_header userStatusWrapper"><span itemprop="author"><span itemprop="name">Reader '), (n % 50).cast("string"),
        F.lit('</span></span> (Chile) <time itemprop="datePublished" datetime="'), F.date_format(when, "yyyy-MM-dd"), F.lit('">'), _shown(when),
        F.lit("</time></h3>"), F.when(n % 9 == 0, '<article class="ad"><h2 class="text_header">Ad</h2></article>').otherwise(""),
        F.lit('<div class="text_content" itemprop="reviewBody">Not Verified | '), F.col("url"), F.lit('<br>seen</div><table class="review-ratings">'),
        label(visit), value(F.date_format(F.add_months(when, -1), "MMMM yyyy")), *table,
        label("Recommended"), value(F.when(n % 3 == 0, "yes").when(n % 3 == 1, "NO").otherwise("N/A")), F.lit("</table></div></article>"),
    )
    return t.pages.select("page_id", "url", F.concat(F.substring_index("html", "<article>", 1), card, F.lit("<article>"), F.substring_index("html", "<article>", -1)).alias("html"))


def _cards_of_kind(t, kind: str, rows, visit: str, fields):
    raw = html_cards.raw_cards(_stored_pages(t, rows, visit))
    ordered = raw.withColumn("scrape_order", F.col("page_id") * 100 + F.col("card_no"))
    table = html_cards.review_table(ordered, kind, "Example Air", "scrape_order")
    final = html_cards.finish_reviews(table, "2014-12-01", "2030-12-01")
    return final.select("page_number", "review_date_iso", "trip_month", "reviewer_name", "reviewer_country", "review_title", "overall_rating_10", "trip_verified", "review_text", *fields, "recommended")


def _kind_sql(fields: str) -> str:
    """Common columns of both kinds, from the page's number and address."""
    day = "(DATE '2015-01-31' + CAST(page_id % 2000 AS INTEGER))"
    before = f"({day} - INTERVAL 1 MONTH)"
    return f"""SELECT page_id AS page_number, strftime({day}, '%Y-%m-%d') AS review_date_iso, {MONTH_NAMES}[month({before})] || ' ' || CAST(year({before}) AS VARCHAR) AS trip_month,
      'Reader ' || page_id % 50 AS reviewer_name, 'Chile' AS reviewer_country, 'Page ' || page_id || ' ' AS review_title, CAST(page_id % 10 + 1 AS VARCHAR) AS overall_rating_10,
      'No' AS trip_verified, url || ' seen' AS review_text, {fields}, CASE page_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Not Rated' END AS recommended FROM pages"""


def _star_sql(shift: int, name: str) -> str:
    return f"coalesce(CAST(nullif((page_id + {shift}) % 6, 0) AS VARCHAR), 'Not Rated') AS {name}"


@query(
    "html_cards_seat",
    _kind_sql(f"""'Cabin ' || page_id % 4 AS seat_type, CASE WHEN page_id % 5 = 0 THEN 'Not Rated' ELSE '3-4-' || page_id % 5 END AS seat_layout,
      {_star_sql(1, 'seat_legroom')}, {_star_sql(2, 'power_supply')}, {_star_sql(3, 'seat_power_supply_firstbusiness')}, {_star_sql(4, 'seatbed_width')}, 'Not Rated' AS seat_privacy"""),
)
def html_cards_seat(t):
    def rows(n):
        return [
            ("Seat Type", "", "value", F.concat(F.lit(" Cabin "), (n % 4).cast("string"))), ("Seat Layout", "", "value", F.when(n % 5 == 0, "N/A").otherwise(F.concat(F.lit("3-4-"), (n % 5).cast("string")))),
            ("Seat Legroom", "", "stars", n + 1), ("Power Supply", "", "stars", n + 2), ("Power Supply", " seat_power_supply_firstbusiness", "stars", n + 3),
            ("Seat/Bed Width", "", "stars", n + 4), ("Unknown", "", "stars", n),
        ]

    fields = ("seat_type", "seat_layout", "seat_legroom", "power_supply", "seat_power_supply_firstbusiness", "seatbed_width", "seat_privacy")
    return _cards_of_kind(t, "seat", rows, "Date Flown", fields)


@query(
    "html_cards_lounge",
    _kind_sql(f"""'Lounge ' || page_id % 11 AS lounge_name, 'Hall & Gate ' || page_id % 3 AS airport, {_star_sql(1, 'comfort')}, {_star_sql(2, 'bar_beverages')},
      {_star_sql(3, 'catering')}, {_star_sql(4, 'wifi_connectivity')}, {_star_sql(5, 'staff_service')}, 'Not Rated' AS washrooms"""),
)
def html_cards_lounge(t):
    def rows(n):
        return [
            ("Lounge Name", "", "value", F.concat(F.lit("Lounge <b>"), (n % 11).cast("string"), F.lit("</b>"))), ("Airport", "", "value", F.concat(F.lit("Hall &amp; Gate "), (n % 3).cast("string"))),
            ("Comfort", "", "stars", n + 1), ("Bar &amp; Beverages", "", "stars", n + 2), ("Food Choices / Quality", "", "stars", n + 3),
            ("Internet / WiFi", "", "stars", n + 4), ("Quality of Staff Service", "", "stars", n + 5),
        ]

    fields = ("lounge_name", "airport", "comfort", "bar_beverages", "catering", "wifi_connectivity", "staff_service", "washrooms")
    return _cards_of_kind(t, "lounge", rows, "Date Visit", fields)


# ---------------------------------------------------------------- keywords and complaints

def _keywords(t, kinds: dict[str, str]):
    """Delimited lists as an export holds them, then exploded again, all kinds in one pass."""
    lists = {f"__{c}": F.array_join(F.transform(c, lambda w: F.concat(F.lit(" "), F.upper(w), F.lit(" "))), "|") for c in kinds}
    meta = ("review_id", "year", "month", "seat_type", "route", "sentiment_overall", "sentiment_score")
    return voice.explode_typed(t.voice.withColumns(lists), {f"__{c}": kind for c, kind in kinds.items()}, meta)


KEYWORD_SQL = """{0} AS (SELECT review_id, year, month, seat_type, route, sentiment_overall, sentiment_score,
  unnest({1}) AS keyword, '{2}' AS sentiment_type FROM voice)"""


@query(
    "keyword_explode_rank",
    f"""WITH {KEYWORD_SQL.format('k', 'pos_hits', 'positive')},
      f AS (SELECT keyword, frequency, CAST(dense_rank() OVER (ORDER BY frequency DESC) AS INTEGER) AS rank_global
        FROM (SELECT keyword, count(*) AS frequency FROM k GROUP BY keyword))
      SELECT review_id, year, month, seat_type, route, sentiment_overall, round(sentiment_score, 6) AS sentiment_score, k.keyword, sentiment_type, frequency, rank_global
      FROM k JOIN f ON k.keyword = f.keyword""",
    ("voice",),
)
def keyword_explode_rank(t):
    return rounded(voice.ranked_terms(_keywords(t, {"pos_hits": "positive"})), "sentiment_score")


@query(
    "keyword_combined",
    f"""WITH {KEYWORD_SQL.format('a', 'pos_hits', 'positive')}, {KEYWORD_SQL.format('b', 'neg_hits', 'negative')},
      u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
      SELECT review_id, keyword, sentiment_type, count(*) OVER (PARTITION BY sentiment_type, keyword) AS freq_within_type FROM u""",
    ("voice",),
)
def keyword_combined(t):
    rows = voice.combined_terms(_keywords(t, {"pos_hits": "positive", "neg_hits": "negative"}))
    return rows.select("review_id", "keyword", "sentiment_type", "freq_within_type")


CLEAN_VOICE = """CASE WHEN lower(trim({0})) NOT IN ('null','none','n/a','na','not mentioned','not stated','','nan')
  AND length(lower(trim({0}))) >= 3 THEN lower(trim({0})) END"""


@query(
    "top_complaints",
    f"""WITH c AS (SELECT {CLEAN_VOICE.format('top_complaint')} AS complaint FROM voice)
      SELECT complaint, frequency, CAST(dense_rank() OVER (ORDER BY frequency DESC) AS INTEGER) AS rank
      FROM (SELECT complaint, count(*) AS frequency FROM c WHERE complaint IS NOT NULL GROUP BY complaint)""",
    ("voice",),
)
def top_complaints(t):
    return voice.voice_frequency(t.voice, "top_complaint", "complaint")


@query(
    "praise_detail",
    f"""WITH c AS (SELECT review_id, seat_type, {CLEAN_VOICE.format('top_praise')} AS top_praise FROM voice),
      f AS (SELECT *, CAST(dense_rank() OVER (ORDER BY frequency DESC) AS INTEGER) AS rank FROM
        (SELECT top_praise, count(*) AS frequency FROM c WHERE top_praise IS NOT NULL GROUP BY top_praise))
      SELECT review_id, seat_type, c.top_praise, frequency, rank FROM c LEFT JOIN f ON c.top_praise = f.top_praise WHERE c.top_praise IS NOT NULL""",
    ("voice",),
)
def praise_detail(t):
    return voice.voice_detail(t.voice, "top_praise", ["review_id", "seat_type"])


STOP_SQL = _in(text.STOP_WORDS)


@query(
    "word_weights",
    f"""WITH w AS (SELECT unnest({TOKENS.format('text')}) AS word FROM documents),
      c AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN {STOP_SQL} GROUP BY word)
      SELECT word, n, round(n / (SELECT max(n) FROM c), 6) AS weight FROM c ORDER BY n DESC, word LIMIT 80""",
)
def word_weights(t):
    lists = files.spread(t.documents).select(F.split("text", "\n").alias("parts"))
    return rounded(voice.word_weights(lists, "parts"), "weight")


@query(
    "cluster_terms",
    f"""WITH w AS (SELECT source AS cluster, doc_id, unnest(list_zip(range(len(ws)), ws)) AS z
        FROM (SELECT source, doc_id, {TOKENS.format('text')} AS ws FROM documents)),
      c AS (SELECT cluster, z[2] AS word, count(*) AS n, min(doc_id * 1000000 + z[1]) AS first FROM w
        WHERE z[2] NOT IN {STOP_SQL} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS rn FROM c)
      SELECT d.cluster, coalesce(string_agg(upper(word[1]) || word[2:], ' ' ORDER BY rn), 'General Complaint') AS cluster_label
      FROM (SELECT DISTINCT source AS cluster FROM documents) d LEFT JOIN r ON d.cluster = r.cluster AND rn <= 3 GROUP BY d.cluster""",
)
def cluster_terms(t):
    docs = files.spread(t.documents).select("doc_id", F.col("source").alias("cluster"), "text")
    return voice.cluster_terms(docs, "text", "cluster", "doc_id")


@query(
    "term_weights",
    f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS word FROM documents),
      c AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word NOT IN {STOP_SQL} GROUP BY 1, 2),
      k AS (SELECT word, count(*) AS df FROM c GROUP BY 1)
      SELECT doc_id, word, tf, df, round(ln(((SELECT count(text) FROM documents) + 1.0) / (df + 1)), 6) AS idf,
        round(tf * ln(((SELECT count(text) FROM documents) + 1.0) / (df + 1)), 6) AS weight FROM c JOIN k USING (word)""",
)
def term_weights(t):
    return rounded(voice.term_weights(files.spread(t.documents.select("doc_id", "text")), "text", "doc_id"), "idf", "weight")


# ---------------------------------------------------------------- themes and months

THEME_COLS = [f"theme_{t}" for t in THEME_WORDS]


def _theme_long_sql(where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT seat_type, '{c}' AS theme_col, '{summaries.THEME_LABELS[c]}' AS theme, {c} AS p FROM themed {where}" for c in THEME_COLS
    )


@query(
    "theme_summary_sets",
    f"""WITH l AS MATERIALIZED ({_theme_long_sql()}),
      g AS (SELECT theme, theme_col, CASE WHEN grouping(seat_type) = 1 THEN 'All Cabins' ELSE seat_type END AS seat_type,
        count(*) AS n_mentioned, count(*) FILTER (p = 'positive') AS n_positive, count(*) FILTER (p = 'negative') AS n_negative,
        count(*) FILTER (p = 'neutral') AS n_neutral FROM l WHERE p <> 'not_mentioned'
        GROUP BY GROUPING SETS ((theme, theme_col, seat_type), (theme, theme_col)))
      SELECT *, round_even(n_positive * 100.0 / n_mentioned, 1) AS pct_positive, round_even(n_negative * 100.0 / n_mentioned, 1) AS pct_negative,
        round_even(n_neutral * 100.0 / n_mentioned, 1) AS pct_neutral, round_even((n_positive - n_negative) / n_mentioned, 3) AS sentiment_ratio FROM g""",
    ("themed",),
)
def theme_summary_sets(t):
    return summaries.theme_summary(t.themed, summaries.THEME_LABELS, "seat_type")


@query(
    "theme_negativity",
    f"""WITH l AS MATERIALIZED ({_theme_long_sql()})
      SELECT seat_type, theme_col, round(count(*) FILTER (p = 'negative') * 100.0 / greatest(count(*) FILTER (p <> 'not_mentioned'), 1), 6) AS negative_pct
      FROM l GROUP BY seat_type, theme_col""",
    ("themed",),
)
def theme_negativity(t):
    return rounded(summaries.theme_negativity(t.themed, summaries.THEME_LABELS, "seat_type"), "negative_pct")


@query(
    "theme_by_year",
    f"""WITH l AS MATERIALIZED ({_theme_long_sql().replace('SELECT seat_type,', 'SELECT year,')})
      SELECT year, theme_col, round(count(*) FILTER (p = 'negative') * 100.0 / greatest(count(*) FILTER (p <> 'not_mentioned'), 1), 6) AS negative_pct
      FROM l GROUP BY year, theme_col""",
    ("themed",),
)
def theme_by_year(t):
    return rounded(summaries.theme_negativity(t.themed, summaries.THEME_LABELS, "year"), "negative_pct")


@query(
    "theme_ranking",
    f"""WITH l AS MATERIALIZED ({_theme_long_sql()})
      SELECT theme, round_even(count(*) FILTER (p = 'negative') * 100.0 / count(*), 1) AS pct_negative,
      round_even(count(*) FILTER (p = 'positive') * 100.0 / count(*), 1) AS pct_positive, count(*) AS n_mentioned
      FROM l WHERE p <> 'not_mentioned' GROUP BY theme""",
    ("themed",),
)
def theme_ranking(t):
    return summaries.theme_ranking(summaries.theme_summary(t.themed, summaries.THEME_LABELS, "seat_type"), "seat_type")


@query(
    "monthly_summary",
    """SELECT year, month, count(*) AS n_reviews, round_even(avg(sentiment_score), 4) AS avg_sentiment_score,
      round_even(avg(overall_rating_10), 3) AS avg_overall_rating,
      round_even(avg(CASE WHEN sentiment_overall = 'positive' THEN 1.0 ELSE 0 END) * 100, 1) AS pct_positive,
      round_even(avg(CASE WHEN sentiment_overall = 'negative' THEN 1.0 ELSE 0 END) * 100, 1) AS pct_negative,
      round_even(avg(CASE WHEN sentiment_overall = 'neutral' THEN 1.0 ELSE 0 END) * 100, 1) AS pct_neutral,
      round_even(avg(CASE WHEN sentiment_overall = 'mixed' THEN 1.0 ELSE 0 END) * 100, 1) AS pct_mixed,
      round_even(avg(CASE WHEN recommended = 'Yes' THEN 1.0 ELSE 0 END) * 100, 1) AS pct_recommended,
      round_even(avg(CASE WHEN is_sarcastic THEN 1.0 ELSE 0 END) * 100, 1) AS pct_sarcastic,
      round_even(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0 END) * 100, 1) AS pct_competitor_mention,
      strftime(make_date(year, month, 1), '%Y-%m-%d') AS date FROM voice GROUP BY year, month""",
    ("voice",),
)
def monthly_summary(t):
    v = t.voice.withColumn("competitor", F.col("quality") == 0)
    out = summaries.monthly(v, "year", "month", "sentiment_score", "overall_rating_10", "sentiment_overall", "recommended", "is_sarcastic", "competitor")
    return out.withColumn("date", day("date"))


# ---------------------------------------------------------------- prompts, replies, sampling

TEMPLATE = "Date: {date}\nCabin: {cabin}\nRating: {rating} / 10\nRecommended: {recommended}\n\n{body}"


@query(
    "prompt_build",
    """SELECT review_id, md5('Date: ' || CAST(year AS VARCHAR) || chr(10) || 'Cabin: ' || seat_type || chr(10) || 'Rating: '
      || coalesce(CAST(CAST(overall_rating_10 AS BIGINT) AS VARCHAR), 'Not stated') || ' / 10' || chr(10) || 'Recommended: '
      || coalesce(nullif(recommended, 'Not Rated'), 'Not stated') || chr(10) || chr(10) || text) AS prompt_md5 FROM voice_base""",
    ("voice_base",),
)
def prompt_build(t):
    v = t.voice_base
    filled = voice.prompt(
        TEMPLATE,
        {
            "date": "year", "cabin": "seat_type", "rating": F.col("overall_rating_10").cast("bigint"),
            "recommended": F.nullif(F.col("recommended"), F.lit("Not Rated")), "body": "text",
        },
    )
    return v.select("review_id", F.md5(filled).alias("prompt_md5"))


def _replies(v):
    """Model replies composed from the reviews: fenced for one cabin, cut off where flagged toxic."""
    themes = F.struct(*[F.lit("not_mentioned").alias(x) for x in schemas.THEMES if x != "value"], F.col("sentiment_overall").alias("value"))
    body = F.to_json(
        F.struct(
            "sentiment_overall", "sentiment_score",
            F.col("is_sarcastic").alias("competitor_mentioned"), themes.alias("product_themes"),
            F.struct(F.col("pos_hits").alias("positive_words"), F.col("neg_hits").alias("negative_words")).alias("sentiment_keywords"),
            F.array("seat_type", "route").alias("product_implications"),
        )
    )
    fenced = F.when(F.col("seat_type") == "en", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    broken = F.when(F.col("is_sarcastic"), F.substring(fenced, F.lit(1), F.length(body) - 9)).otherwise(fenced)
    return voice.once(v, "reply", broken)


@query(
    "json_extract_flatten",
    """SELECT review_id, seat_type, sentiment_overall, round(sentiment_score, 6) AS sentiment_score, sentiment_overall AS theme_value,
      'not_mentioned' AS theme_wifi, array_to_string(pos_hits, ' | ') AS positive_keywords, array_to_string(neg_hits, ' | ') AS negative_keywords,
      seat_type || ' | ' || route AS product_implications, 46 AS n_columns FROM voice WHERE is_sarcastic IS NOT TRUE""",
    ("voice",),
)
def json_extract_flatten(t):
    good, _ = voice.parse_reply(_replies(t.voice), "reply")
    flat = voice.flatten(voice.merge_fields(good, ["review_id", "year", "month", "seat_type", "route", "recommended"]))
    out = flat.select(
        "review_id", "seat_type", "sentiment_overall", "sentiment_score", "theme_value", "theme_wifi",
        "positive_keywords", "negative_keywords", "product_implications", F.lit(len(flat.columns)).alias("n_columns"),
    )
    return rounded(out, "sentiment_score")


@query(
    "extract_errors",
    """SELECT review_id, 'unreadable reply' AS error FROM voice_base WHERE is_sarcastic""",
    ("voice_base",),
)
def extract_errors(t):
    _, bad = voice.parse_reply(_replies(t.voice), "reply")
    return bad.select("review_id", "error")


@query(
    "fence_strip",
    """SELECT doc_id, md5(trim(text, chr(10) || ' ')) AS digest FROM documents""",
)
def fence_strip(t):
    """Texts in a code fence and out of it again."""
    fenced = F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(voice.strip_fence(fenced)).alias("digest"))


@query(
    "lexicon_extract",
    f"""SELECT review_id, sentiment_overall, round(sentiment_score, 6) AS sentiment_score, theme_ife, theme_seat_comfort
      FROM (SELECT t.review_id, v.sentiment_overall, v.sentiment_score, theme_ife, theme_seat_comfort FROM themed t JOIN voice v ON t.review_id = v.review_id)""",
    ("themed", "voice"),
)
def lexicon_extract(t):
    themes = {k: THEME_WORDS[k] for k in ("ife", "seat_comfort")}
    out = voice.lexicon_extract(t.voice_base.select("review_id", "text"), "text", POSITIVE, NEGATIVE, themes)
    return rounded(out.drop("text", "positive_words", "negative_words"), "sentiment_score")


@query(
    "extraction_hook",
    f"""SELECT review_id, len({TOKENS.format('text')}) AS n_words FROM voice_base""",
    ("voice_base",),
)
def extraction_hook(t):
    """The batch hook with a user function that counts words and answers in JSON."""
    import re

    word = re.compile(r"\b[a-z]{3,}\b")

    def count(prompts):
        return prompts.str.lower().map(lambda p: '{"n": %d}' % len(word.findall(p)))

    replied = voice.extract(t.voice_base.select("review_id", "text"), "text", "reply", count)
    return replied.select("review_id", F.get_json_object("reply", "$.n").cast("bigint").alias("n_words"))


@query(
    "stratified_sample",
    """SELECT review_id, seat_type, rating_band FROM (SELECT review_id, seat_type, rating_band,
        row_number() OVER (PARTITION BY seat_type, rating_band ORDER BY md5('42:' || review_id)) AS rn
        FROM (SELECT *, CASE WHEN rating_10 <= 3 THEN 'low' WHEN rating_10 <= 6 THEN 'mid' WHEN rating_10 <= 8 THEN 'high' ELSE 'top' END AS rating_band FROM rated))
      WHERE rn <= 600 // 12""",
    ("rated",),
)
def stratified_sample(t):
    from voxfare.functions import scores

    banded = t.rated.withColumn("rating_band", scores.band("rating_10", labels=scores.SAMPLE_BAND_LABELS))
    return voice.stratified(banded.select("review_id", "seat_type", "rating_band"), ["seat_type", "rating_band"], "review_id", 600)


@query(
    "json_props",
    """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY event_type""",
)
def json_props(t):
    parsed = t.events.select("event_type", F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))


@query(
    "valid_years",
    """SELECT year, count(*) AS n FROM voice_base WHERE year >= 2018 GROUP BY year""",
    ("voice_base",),
)
def valid_years(t):
    return voice.valid_years(t.voice_base, "year", 2018).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "not_stated_context",
    """SELECT coalesce(CAST(quality AS VARCHAR), 'Not stated') AS quality, count(*) AS n FROM voice_base GROUP BY 1""",
    ("voice_base",),
)
def not_stated_context(t):
    filled = voice.not_stated(bigint(t.voice_base, "quality"), ["quality"])
    return filled.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))

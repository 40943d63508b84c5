import random
import re

import pytest
from pyspark.sql import functions as F

from voxfare.plans import q_text
from voxfare.plans.views import Tables
from voxfare.sources import html_cards, schemas

CARD = """<article itemprop="review">
 <meta itemprop="datePublished" content="{iso}">
 <div itemprop="reviewRating"><span itemprop="ratingValue"> 7 </span>/<span>10</span></div>
 <h2 class="text_header">"Great <b>value</b>"</h2>
 <h3 class="text_sub_header userStatusWrapper">4 reviews <span itemprop="author"><span itemprop="name">Ann&nbsp;Lee</span></span>
   (Peru) <time itemprop="datePublished" datetime="{iso}">3rd May 2020</time></h3>
 <div class="text_content" itemprop="reviewBody"><p>Not Verified | Long &amp; <i>quiet</i><br>flight
 </div>
 <table class="review-ratings">{rows}</table>
</article>"""


def row(label, value=None, stars=None, cls=""):
    if stars is None:
        cell = f'<td class="review-value">{value}</td>'
    else:
        cell = '<td class="review-rating-stars">' + '<span class="star fill">*</span>' * stars + '<span class="star">*</span></td>'
    return f'<tr><td class="review-rating-header {cls}">{label}</td>{cell}</tr>'


def table(spark, kind, html):
    pages = spark.createDataFrame([(1, "u1", html)], "page_id int, url string, html string")
    raw = html_cards.raw_cards(pages).withColumn("ord", F.col("card_no"))
    return html_cards.review_table(raw, kind, "Example Air", "ord").collect()


def test_airline_card(spark):
    rows = row("Seat Type", " Economy  Class ") + row("Food and Beverages", stars=3) + row("Wifi &amp; Connectivity", stars=0)
    rows += row("Date Flown", "March 2020") + row("Recommended", "YES") + row("Mystery", "x") + row("Route", "A to B")
    (r,) = table(spark, "airline", CARD.format(iso="2020-05-03", rows=rows))
    got = r.asDict()
    assert list(got) == schemas.columns("airline")
    assert got["review_date"] == "3 May 2020" and got["review_date_iso"] == "2020-05-03"
    assert got["trip_month"] == "March 2020"
    assert got["reviewer_name"] == "Ann Lee" and got["reviewer_country"] == "Peru"
    assert got["overall_rating_10"] == "7"
    assert got["review_title"] == '"Great value "'  # text pieces are joined by one blank
    assert got["trip_verified"] == "No" and got["review_text"] == "Long & quiet flight"
    assert got["seat_type"] == "Economy Class" and got["route"] == "A to B"
    assert got["food_beverages"] == "3" and got["wifi_connectivity"] == "Not Rated"
    assert got["recommended"] == "Yes" and got["ground_service"] == "Not Rated"


def test_seat_card_class_wins_and_na(spark):
    rows = row("Power Supply", stars=4, cls="seat_power_supply_firstbusiness") + row("Power Supply", stars=2)
    rows += row("Seat Layout", "N/A") + row("Recommended", "no")
    (r,) = table(spark, "seat", CARD.format(iso="", rows=rows))
    assert r["seat_power_supply_firstbusiness"] == "4" and r["power_supply"] == "2"
    assert r["seat_layout"] == "Not Rated" and r["recommended"] == "No"
    assert r["review_title"] == "Great value "
    assert r["review_date_iso"] == "Not Rated" and r["trip_month"] == "Not Rated"


def test_lounge_labels_and_visit_month(spark):
    rows = row("Internet / WiFi", stars=1) + row("Quality of Staff Service", stars=5) + row("Food Choices / Quality", stars=2)
    rows += row("Bar and Beverages", stars=3) + row("Washrooms/Showers", stars=4) + row("Date Visit", "June 2019")
    (r,) = table(spark, "lounge", CARD.format(iso="2020-05-03", rows=rows))
    assert (r["wifi_connectivity"], r["staff_service"], r["catering"], r["bar_beverages"], r["washrooms"]) == ("1", "5", "2", "3", "4")
    assert r["trip_month"] == "June 2019"


def test_pages_of_several_cards_and_noise():
    one = '<article itemprop="review"><h2 class="text_header">A</h2></article>'
    nested = '<article itemprop="review"><h2 class="text_header">B</h2><article class="ad"><h2 class="text_header">no</h2></article><span itemprop="name">N</span></article>'
    page = f"<html><script>'{one}'</script><!-- {one} -->{one}<article>{one.replace('itemprop', 'data-x')}</article>{nested}" + one.replace("A", "C").replace("</article>", "")
    got = html_cards.read_cards(page)
    assert [c["title"] for c in got] == ["A", "B", "C"]
    assert got[1]["name"] == "N"
    assert html_cards.read_cards(None) == [] and html_cards.read_cards("no cards") == []


def both_ways(spark, pages):
    """Cards as raw_cards gives them and as the tag reader gives them; and which markup is regular."""
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    found = sorted(((r["page_id"], r["card_no"], {c: r[c] for c in html_cards.CARD_TEXTS} | {"attrs": [a.asDict() for a in r["attrs"]]})
                    for r in html_cards.raw_cards(df, keep=("page_id",)).collect()), key=lambda x: x[:2])
    wanted = [(i, no, card) for i, page in enumerate(pages) for no, card in enumerate(html_cards.read_cards(page), start=1)]
    return found, wanted


def test_native_cards_equal_the_tag_reader(spark):
    """Regular cards, and the same with every kind of damage, are read alike by patterns and tag by tag."""
    rows = row("Seat Type", " Economy  <b>Class</b> ") + row("Food &amp; Beverages", stars=3) + row("Wifi", stars=0, cls="wifi big") + row("Route", "A to B")
    good = CARD.format(iso="2020-05-03", rows=rows)
    pages = [good, good * 3, "x" + good + "<p>" + good.replace("Ann", "Bob") + "</p>", CARD.format(iso="", rows=""), CARD.format(iso="  ", rows=row("", ""))]
    rng = random.Random(5)
    tags = ["</p>", "<p>", "<b>", "</b>", "</div>", "<div>", "</span>", "</td>", "<td>", "</table>", "<h2 class='text_header'>", "</h2>", "<br>", "</article>", "<article>", "&eacute;", "&lt", "&#233;", "<", ">", '"', "<!-- </h2> -->", "<span class=\"star fill\">", "<script>'</td>'</script>", "\u00a0", "<i>", "</h3>", "<article itemprop=review>", "</ARTICLE>", "<div class=\"body\">", "<tr>", '<meta itemprop="datePublished" content="1999">', '<time itemprop="datePublished" datetime="1999">x</time>']
    for _ in range(400):
        page = good
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.choice([m.start() for m in re.finditer("[<>]| ", page)]) + rng.choice([0, 0, 1])
            page = page[:at] + rng.choice(tags) + page[at:]
        pages.append(page)
    for m in list(re.finditer(r"<[^>]*>", good)):
        pages.append(good[: m.start()] + good[m.end() :])  # each tag left out once
    found, wanted = both_ways(spark, [*pages, None, "", "no cards"])
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a == b, pages[a[0]]


def test_regular_cards_stay_out_of_python(spark):
    good = CARD.format(iso="2020-05-03", rows=row("Route", "A to B") + row("Wifi", stars=2))
    df = spark.createDataFrame([(good,), (good.replace("</h2>", ""),), (good.replace("&amp;", "&eacute;"),)], "p string")
    regular = [r[0] for r in df.select(F.col("p").rlike(html_cards.REGULAR) & ~F.col("p").rlike(html_cards._OTHER_ENTITY)).collect()]
    assert regular == [True, False, False]


def test_long_bodies(spark):
    """More tags than the pattern takes, and very long plain texts."""
    body = "word <i>x</i> " * 3_000
    pages = [CARD.format(iso="2020-05-03", rows="").replace("<br>", body), CARD.format(iso="2020-05-03", rows="").replace("<br>", "long text " * 50_000)]
    found, wanted = both_ways(spark, pages)
    assert found == wanted and len(found) == 2


def test_stray_signs_stay_text():
    (c,) = html_cards.read_cards('<article itemprop=review><div class="text_content" itemprop="reviewBody">a < b &gt; c</div></article>')
    assert c["body"] == "a < b > c"


def test_last_of_equal_labels_wins(spark):
    rows = row("Route", "A to B") + row("Route", "C to D")
    (r,) = table(spark, "airline", CARD.format(iso="2020-05-03", rows=rows))
    assert r["route"] == "C to D"


def test_finish_filters_months_and_dedupes(spark):
    card = CARD.format(iso="2020-05-03", rows=row("Route", "A to B"))
    pages = spark.createDataFrame(
        [(1, "u", card), (2, "u", card.replace("Great", "GREAT")), (3, "u", card.replace("3rd May 2020", "4th May 2020"))],
        "page_id int, url string, html string",
    )
    raw = html_cards.raw_cards(pages).withColumn("ord", F.col("page_id"))
    table = html_cards.review_table(raw, "airline", "X", "ord")
    done = html_cards.finish_reviews(table, "2020-05-01", "2020-05-01", ordered=True)
    assert [r["page_number"] for r in done.collect()] == [1, 3]
    assert html_cards.finish_reviews(table, "2020-06-01", "2021-01-01").count() == 0


@pytest.mark.parametrize("kind, n", [("airline", 26), ("seat", 33), ("lounge", 26)])
def test_column_lists(kind, n):
    cols = schemas.columns(kind)
    assert len(cols) == len(set(cols)) == n


def composed(spark, tmp_path, n):
    """Tables of n orders of two customers."""
    orders = spark.range(n).selectExpr(
        "id AS o_orderkey", "id % 2 AS o_custkey", "'F' AS o_orderstatus", "60000.0D AS o_totalprice",
        "timestamp'2001-02-03 00:00:00' AS o_orderdate", "'2-HIGH' AS o_orderpriority",
    )
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (0L, 'A', 'FURNITURE', 1L), (1L, 'B', 'MACHINERY', 1L) AS c (c_custkey, c_name, c_mktsegment, c_nationkey)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1L AS n_nationkey, 'PERU' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    return Tables(spark, str(tmp_path))


def test_composed_pages_have_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    t = composed(spark, tmp_path, 1_000)
    cores = spark.sparkContext.defaultParallelism
    assert q_text.card_pages(t).rdd.getNumPartitions() == cores
    monkeypatch.setattr(q_text, "PAGES_PER_TASK", 1_000 // (5 * cores))
    pages = q_text.card_pages(t)
    assert pages.rdd.getNumPartitions() >= 5 * cores and pages.count() == 1_000


def test_columns_that_are_not_shown_stay_out_of_the_dedupe(spark, tmp_path):
    out = q_text.html_cards_query(composed(spark, tmp_path, 20))
    assert sorted(r["review_id"] for r in out.collect()) == list(range(20))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dedupe = next(line for line in plan.splitlines() if "min(" in line)
    assert "review_text" in dedupe and "source_url" not in dedupe and "aircraft" not in dedupe

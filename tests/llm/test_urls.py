import random
import re
from collections import Counter

from voxfare.llm import url_rules
from voxfare.llm.queries import QUERIES, URL_RULES

PAGES = "page_id long, url string, html string, host string, rule string, key string, salt int"


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), len(rule_host), rule, verdict))
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, pairs, rules):
    pages = spark.createDataFrame([(i, u, "h", "a", "b", "c", 3) for i, u in pairs], PAGES)
    out = url_rules.judge(pages, url_rules.rule_table(spark, rules))
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())


ODD = [
    None, "", "com", "://", "http://", "http:///a", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en", "http://example.com/en/",
    "x://a://example.com/en/", "http://notexample.com/en/", "http://example.com./en/", "http://a.b.example.com/en/y", "http://de.net/es/",
    "http://net/fr/", "http://net?x/fr/", "http://com#/", "http://.com/", "http://..net/es/", "http://É.com/\n/x", "http://com-x.com/en/", "http://" + "a." * 300 + "com/" + "p" * 20_000,
]


def test_odd_urls_and_repeated_rows(spark):
    pairs = [*enumerate(ODD), *enumerate(ODD), (None, "http://example.com/en/")]
    assert judged(spark, pairs, URL_RULES) == Counter((i, *plain(u, URL_RULES)) for i, u in pairs)


def test_nested_rules_over_many_hosts(spark):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice(["a", "b", "ab", "a-b", "c"]) for _ in range(rng.randint(1, 4)))
    rules = sorted({(rng.choice(["allow", "block"]), f"{name()}/{rng.choice(['', 'x/', 'x/y/', 'x'])}") for _ in range(60)})
    single = list({r: (v, r) for v, r in reversed(rules)}.values())  # of two verdicts allow holds
    pairs = [(i, f"http://{name()}/{rng.choice(['', 'x', 'x/', 'x/y/z', 'q'])}") for i in range(600)]
    assert judged(spark, pairs, rules) == Counter((i, *plain(u, single)) for i, u in pairs)


def test_no_rules_and_no_pages(spark):
    assert judged(spark, [(1, "http://a.com/")], [("allow", "no slash")]) == Counter([(1, "a.com", "/", None, "allow")])
    assert judged(spark, [], URL_RULES) == Counter()


def test_plan_is_native(spark, capsys):
    QUERIES["op2_url_sweep"](spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in capsys.readouterr().out


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    found = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in QUERIES["op2_url_sweep"](spark, sf).collect())
    assert found == Counter((i, *plain(u, URL_RULES)) for i, u in pages)

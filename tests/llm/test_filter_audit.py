"""The filter audit against filters applied one after another, and its query against SQL."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import filter_audit as fa
from voxfare.llm.queries import ORACLES, QUERIES


def by_hand(weights, k, width=3):
    """Rows of audit_orders, by applying the filters of each order to the masks themselves."""
    out, total = [], Counter()
    for order in permutations(range(k)):
        left = dict(weights)
        for step, f in enumerate(order, 1):
            away = {m: w for m, w in left.items() if m >> f & 1}
            left = {m: w for m, w in left.items() if not m >> f & 1}
            sums = [sum(w[i] for w in away.values()) for i in range(width)]
            fails = sum(w[0] for m, w in weights.items() if m >> f & 1)
            total[f] += sums[0]
            out.append(("".join("ABCDEFGH"[x] for x in order), step, f, sum(w[0] for w in left.values()), sums[0], fails - sums[0], weights.get(1 << f, (0,))[0], *sums[1:]))
    return sorted((*r[:2], *r[3:], total[r[2]]) for r in out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.dictionaries(st.integers(0, 31), st.tuples(*[st.integers(0, 9)] * 3)))
def test_all_orders_by_hand(k, weights):
    weights = {m: w for m, w in weights.items() if m < 1 << k}
    assert sorted(fa.audit_orders("ABCDE"[:k], weights, 3)) == by_hand(weights, k)


@pytest.mark.parametrize("n", range(7))
def test_swaps_meet_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in fa.adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_a_swap_keeps_every_mask():
    rng = random.Random(1)
    weights = {m: (rng.randrange(4),) for m in range(32)}
    diagram = fa.Diagram(5, weights, 1)
    for at in (0, 3, 1, 2, 2, 0, 1, 3, 3):
        diagram.swap(at)
        assert {m: diagram.at(m) for m in range(32)} == weights


def test_equal_subgraphs_are_shared():
    diagram = fa.Diagram(4, {m: (1,) for m in range(16)}, 1)
    assert len(diagram.weight) == 1 + 5  # nothing, one leaf and one node per level


def expected(pairs, labels):
    """Rows of audit_documents for (id, text, part) triples, straight from the rules."""
    parts = {}
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in (0, 1))
    for d, t, part in pairs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in pairs)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        row = parts.setdefault(part or "", {}).setdefault(sum(f << i for i, f in enumerate(fails)), [0, 0, 0])
        row[0] += 1
        row[1] += d in good and d is not None
        row[2] += d in toxic and d is not None
    return sorted((p, *r) for p, w in parts.items() for r in by_hand({m: tuple(x) for m, x in w.items()}, 5))


def label_rows(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")


def audited(spark, pairs, labels):
    schema = "doc_id long, text string, lang string, part string, mask int, n string, digest int, id string, good int"
    docs = spark.createDataFrame([(d, t, p, "x", 1, "y", 2, "z", 3) for d, t, p in pairs], schema)
    return sorted(tuple(r) for r in fa.audit_documents(docs, label_rows(spark, [(*x, "x") for x in labels])).collect())


def test_awkward_rows(spark):
    parts = ["en", None, "", "de"]
    pairs = [(d, t, parts[i % 4]) for i, (d, t) in enumerate(AWKWARD)]
    pairs += [(20, "THE # SHOUT", "en"), (21, prose(21, 150), "en"), (21, prose(21, 150), "de"), (22, prose(21, 150), "de"), (None, prose(21, 150), "de")]
    labels = [(21, 1, 0), (21, None, 1), (22, None, None), (20, 0, 1), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, pairs, labels) == expected(pairs, labels)


def test_many_copies_of_one_text(spark):
    pairs = [(d, prose(1, 120) if d % 3 else prose(d, 120), "en" if d % 2 else "fr") for d in range(90)]
    labels = [(d, d % 2, d % 5 == 0) for d in range(0, 90, 3)]
    assert audited(spark, pairs, [(d, q, int(t)) for d, q, t in labels]) == expected(pairs, [(d, q, int(t)) for d, q, t in labels])


def test_empty_tables(spark):
    assert fa.audit_documents(docs_of(spark, []), label_rows(spark, [])).collect() == []
    assert len(fa.audit_documents(docs_of(spark, [(1, "a")]), label_rows(spark, [])).collect()) == 600


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        fa.audit(spark.createDataFrame([("a", 0, 1)], "part string, mask int, n long"), "ABCDEFGHI", [])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.execute(ORACLES["op11_filter_diagrams"])
    names = [c[0] for c in wanted.description]
    assert sorted(tuple(r) for r in QUERIES["op11_filter_diagrams"](spark, sf).select(*names).collect()) == sorted(wanted.fetchall())

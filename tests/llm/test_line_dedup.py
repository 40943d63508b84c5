"""Lines dropped through perfect hashes against a dictionary of lines, and the query against SQL."""

import re

import duckdb
import numpy as np
import pytest

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import line_dedup as ld
from voxfare.llm.queries import ORACLES, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = "\t\n\x0b\x0c\r "


def by_hand(pairs):
    """(id, kept text, lines, dropped lines) of every row, with a dictionary of keys."""
    held = {}
    rank = lambda d: (d is not None, d or 0)  # noqa: E731  a null id comes first
    for d, t in pairs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANK).translate(LOW)
            if len(key) >= 10:
                held.setdefault(key, set()).add(rank(d))
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((h := held.get(x.strip(BLANK).translate(LOW))) and len(h) > 1 and min(h) != rank(d))]
        out.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(spark, pairs):
    rows = ld.dedupe_lines(docs_of(spark, pairs)).collect()
    assert all(r.fp == "x" and r.key == "z" for r in rows)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows), key=repr)


LINES = ["Same line here", "  same LINE here\t", "ten chars!", "nine char", "ÄÖÜ ÄÖÜ äöü", "äöü ÄÖÜ äöü", "日本語日本語日本語日", "日本語日本語日本語", "", "\r", "x y z w q a b ", "İstanbul line"]


def test_awkward_rows(spark):
    pairs = [*AWKWARD, *[(20 + i, "\n".join(LINES[i:] + LINES[:i])) for i in range(12)], (40, "same line here\nsame line here\nown line of 40"), (20, "Same line here\nother row of 20")]
    pairs += [(None, "same line here\nown line of nobody"), (None, "own line of nobody"), (50, "own line of nobody\n\n")]
    assert found(spark, pairs) == by_hand(pairs)


def test_hot_lines_and_long_texts(spark):
    pairs = [(d, "\n".join([prose(1, 8), prose(d % 7, 6), prose(d, 9), prose(1, 8).upper()])) for d in range(300)]
    pairs.append((1_000, "\n".join(prose(d, 9) for d in range(2_000))))
    assert found(spark, pairs) == by_hand(pairs)


def test_without_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT_KEYS", 1)  # only a digest of every probe would be hot: the shards do all
    pairs = [(d, "\n".join(prose(d * 5 % 97 + i, 6) for i in range(6))) for d in range(200)]
    assert found(spark, pairs) == by_hand(pairs)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT_KEYS", 1)
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    pairs = [(d, "\n".join(prose(d * 5 % 97 + i, 6) for i in range(6))) for d in range(100)]
    assert found(spark, pairs) == by_hand(pairs)


def test_empty_table(spark):
    assert ld.dedupe_lines(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    made = ld.Shard.build(h1, h2, np.arange(n, dtype=np.uint32), np.arange(n, dtype=np.int64) * 3)
    for shard in (made, ld.Shard.load(made.dump())):
        at = shard.find(h1, h2)
        assert sorted(at.tolist()) == list(range(n))
        assert (shard.counts[at] == np.arange(n)).all() and (shard.holders[at] == 3 * np.arange(n)).all()
        assert (shard.find(h1 + np.uint64(1), h2 + np.uint64(1)) == -1).all()
    assert made.bits.sum() == n and len(made.bits) <= 8 * n + 8


def test_equal_halves_are_told_apart():
    h1, h2 = np.array([5, 5, 6], dtype=np.uint64), np.array([7, 8, 7], dtype=np.uint64)
    shard = ld.Shard.build(h1, h2, np.ones(3, dtype=np.uint32), np.array([1, 2, 3]))
    assert shard.holders[shard.find(h1, h2)].tolist() == [1, 2, 3]


def test_plan_joins_no_lines(spark):
    docs = docs_of(spark, [(d, prose(1, 9)) for d in range(5)])
    plan = ld.dedupe_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 1  # documents and their dropped digests


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = con.execute(ORACLES["op12_line_hashes"])
    names = [c[0] for c in wanted.description]
    assert sorted(tuple(r) for r in QUERIES["op12_line_hashes"](spark, sf).select(*names).collect()) == sorted(wanted.fetchall())

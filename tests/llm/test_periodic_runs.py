"""Runs from suffix trees against a walk over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import periodic_runs as pr
from voxfare.llm.queries import QUERIES


def walk(words, least=6, turns=4):
    """(start, length, period) of all runs: for each distance, the maximal stretches that repeat at it."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(least, turns * q):
                best.setdefault((start, at + q - start), q)  # the smallest period comes first
            at += 1
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def by_hand(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = walk(words)
    away = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in away).encode()).hexdigest(),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_random_words(ids):
    assert pr.runs_of(np.array(ids, dtype=np.int64)) == walk(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(3, 9), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 6))
def test_planted_runs(before, root, turns, after, cut):
    ids = before + (root * turns)[: max(1, len(root) * turns - cut)] + after
    assert pr.runs_of(np.array(ids, dtype=np.int64)) == walk(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_common_extensions(ids):
    found = pr.Extensions([i + 1 for i in ids], 4)
    pairs = [(a, b) for a in range(len(ids)) for b in range(len(ids)) if a != b]
    for a, b in pairs:
        k = 0
        while max(a, b) + k < len(ids) and ids[a + k] == ids[b + k]:
            k += 1
        assert found.common(np.array([a]), np.array([b]))[0] == k


def test_suffixes_are_sorted():
    ids = [random.Random(4).randrange(3) + 1 for _ in range(200)]
    order, _ = pr.SuffixTree(ids, 4).tour()
    text = [*ids, 0]
    assert order.tolist() == sorted(range(201), key=lambda i: text[i:])


def test_long_runs_in_linear_space():
    ids = np.concatenate([np.arange(1_000), np.tile(np.arange(700), 40), np.full(5_000, 2_000)])
    assert pr.runs_of(ids) == [(1_000, 28_000, 700), (29_000, 5_000, 1)]


def texts():
    twice = " ".join(prose(3, 5).split() * 6)
    return [*AWKWARD, (11, twice), (12, "a a a a a"), (13, "a a a a a a"), (14, "a\ta\n a\x0ba\x0ca\r\na"), (15, "a a " * 7), (None, twice), (11, twice), *[(d, prose(d, d % 90)) for d in range(100, 220)]]


def test_awkward_rows(spark):
    found = pr.run_digests(docs_of(spark, texts())).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr(by_hand(d, t)) for d, t in texts())


def test_runs_and_collapsed_text(spark):
    rows = pr.periodic_runs(docs_of(spark, [(1, "so very very very very very very good"), (2, "a b " * 5), (3, None)])).collect()
    assert {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows} == {
        1: (8, [(1, 6, 1)], "so very good"), 2: (10, [(0, 10, 2)], "a b"), 3: (0, [], ""),
    }


def test_empty_table(spark):
    assert pr.run_digests(docs_of(spark, [])).collect() == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in QUERIES["op13_suffix_runs"](spark, sf).collect()}
    short = [r for r in rows if len(r.text or "") < 20_000]  # the walk takes the square of the length
    assert len(found) == len(rows) and len(short) > 150
    assert all(found[r.doc_id] == by_hand(r.doc_id, r.text) for r in short)

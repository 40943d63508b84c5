import zlib
from collections import Counter

import pytest

from helpers import AWKWARD, docs_of
from voxfare.llm import ring
from voxfare.llm.queries import QUERIES


def check_shards(pairs, found, shards=24):
    sizes = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in pairs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == sizes
    assert {r.law for r in found} <= {"rows"} and all(r.grown_shard is None for r in found)
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    counts = [len(v) for v in slots.values()]
    assert sum(counts) == len(pairs) and max(counts) - min(counts) <= 1


def test_awkward_rows(spark):
    pairs = AWKWARD * 5
    check_shards(pairs, ring.shard_documents(docs_of(spark, pairs)).collect())


def test_one_key_for_all_rows(spark):
    pairs = [(7, "same")] * 100
    check_shards(pairs, ring.shard_documents(docs_of(spark, pairs)).collect())


def test_empty_table(spark):
    assert ring.shard_documents(docs_of(spark, [])).collect() == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(pairs, QUERIES["op9_ring_shards"](spark, sf).collect())


def test_slack_bounds_loads_and_moves_few_rows(spark):
    ids = spark.range(4_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in ring.ring_shards(ids, "doc_id", 8, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in ring.ring_shards(ids, "doc_id", 9, slack=0.25).collect()}
    assert max(Counter(before.values()).values()) <= 1.25 * 4_000 / 8
    assert sum(before[d] != after[d] for d in before) < 0.4 * 4_000


def test_overflow_goes_clockwise():
    made = ring.Ring((10, 20, 30), (0, 1, 2))
    plan = ring.overflow_plan(made, {0: 5}, [2, 2, 2])
    assert plan == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 0)]
    with pytest.raises(ValueError):
        ring.overflow_plan(made, {0: 7}, [2, 2, 2])

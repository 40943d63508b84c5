"""Chunk boundaries, document fingerprints and repeated passages."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import common, fingerprints, substrings
from voxfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_ends(data, least, normal, most):
    """Byte by byte: the hash of the last 16 bytes decides, stricter before the normal size than after it."""
    table, bits = common.gear_table().tolist(), max(1, int(normal - least).bit_length() - 1)
    ends, start = [], 0
    for at in range(1, len(data) + 1):
        h = sum(table[b] << age for age, b in enumerate(reversed(data[max(0, at - 16) : at]))) & 0xFFFF
        size = at - start
        strict, easy = h < 1 << (16 - bits - 1), h < 1 << (16 - bits + 1)
        if size >= least and (strict or easy and size >= normal) or size == most or at == len(data):
            ends.append(at)
            start = at
    return ends


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=1500) | st.builds(lambda b, n: b * n, st.binary(max_size=3), st.integers(0, 400)))
def test_chunk_ends_byte_by_byte(data):
    assert common.chunk_ends(np.frombuffer(data, dtype=np.uint8), 12, 32, 128) == plain_ends(data, 12, 32, 128)


def test_an_insertion_changes_few_chunks():
    text = prose(1, 600)
    own, new = fingerprints.chunk_set(text), fingerprints.chunk_set(text[:1000] + "inserted " + text[1000:])
    assert fingerprints.likeness(own, new) > 0.9


def check_fingerprints(pairs, found):
    ordered = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    keys = [d for d, _ in ordered]
    assert len(found) == len(pairs) and Counter(r.doc_id for r in found) == Counter(keys)
    if len(set(keys)) == len(keys):
        by_id = {r.doc_id: r for r in found}
        for i, (d, t) in enumerate(ordered):
            t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + following[:half]
            own, new = fingerprints.chunk_set(t), fingerprints.chunk_set(edited)
            r = by_id[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(own).hex(), fingerprints.fingerprint(new).hex())
            assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, fingerprints.chunk_set(following)))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_fingerprints_of_awkward_rows(spark):
    check_fingerprints(AWKWARD, fingerprints.fingerprint_documents(docs_of(spark, AWKWARD)).collect())
    single = list({d: (d, t) for d, t in AWKWARD}.values())
    check_fingerprints(single, fingerprints.fingerprint_documents(docs_of(spark, single)).collect())


def test_fingerprints_of_one_and_no_row(spark):
    check_fingerprints([(1, "alone " * 20)], fingerprints.fingerprint_documents(docs_of(spark, [(1, "alone " * 20)])).collect())
    assert fingerprints.fingerprint_documents(docs_of(spark, [])).collect() == []


def test_fingerprint_query_on_the_whole_table(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_fingerprints(pairs, QUERIES["op3_chunk_fingerprints"](spark, SF).collect())


def text_hash(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def plain_spans(pairs, least_run=128):
    """Repeats by a dictionary of chunks over documents in order of (id, hash of the text)."""
    texts = sorted({(d, t) for d, t in pairs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    first, spans, kept = {}, {}, {}
    for doc, text in texts:
        data = text.encode()
        ends = plain_ends(data, 12, 32, 128)
        runs = []
        for a, b in zip([0, *ends], ends):
            holder = first.setdefault(data[a:b], (doc, text, a))
            if holder != (doc, text, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, holder[0]])
        rest, before, out = b"", 0, []
        for a, b, holder in runs:
            if b - a >= least_run:
                while data[a:b] and data[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                start = len(data[:a].decode())
                out.append((doc, start, start + len(data[a:b].decode()), holder))
                rest, before = rest + data[before:a], b
        spans[doc, text], kept[doc, text] = out, (rest + data[before:]).decode()
    return Counter(x for r in pairs if r[1] is not None for x in spans[r]), [kept.get(r) for r in pairs]


PASSAGE = prose(99, 60)
REPEATS = [
    *AWKWARD, (21, prose(21, 50) + " " + PASSAGE + " " + prose(22, 50)), (22, "é" + PASSAGE), (23, PASSAGE + "日本"), (20, prose(23, 30) + PASSAGE),
    (24, "日本語" * 200), (25, "a" + "日本語" * 200), (26, PASSAGE + " " + PASSAGE),
]


def test_repeated_passages_of_awkward_rows(spark):
    docs = docs_of(spark, REPEATS).coalesce(1)
    spans, texts = plain_spans(REPEATS)
    assert Counter(map(tuple, substrings.repeated_spans(docs).collect())) == spans
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(zip([d for d, _ in REPEATS], texts))


def test_a_shared_passage_goes_from_later_documents(spark):
    kept = {r.doc_id: r for r in substrings.without_repeats(docs_of(spark, REPEATS)).collect()}
    middle = PASSAGE[40:-40]
    assert middle in kept[20].text and all(middle not in kept[d].text for d in (21, 22, 23, 26))
    assert kept[21].text.startswith(prose(21, 50)[:250]) and kept[21].n_chars == len(kept[21].text)


@pytest.mark.parametrize("ranges", ["1", "2", "40"])
def test_digests_that_span_ranges(spark, ranges):
    """Passages of a third of all rows run over many ranges; their holder stays the first place of all."""
    pairs = [(d, (PASSAGE + " " if d % 3 == 0 else "") + prose(d, 40) + " " + prose(d % 5, 30)) for d in range(1, 200)]
    pairs += [(7, pairs[6][1]), (7, PASSAGE + " " + PASSAGE), (None, PASSAGE), (None, "x" + PASSAGE), (300, prose(7, 90) + " " + PASSAGE + " " + PASSAGE + " end")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        docs = docs_of(spark, pairs)
        spans, texts = plain_spans(pairs)
        assert Counter(map(tuple, substrings.repeated_spans(docs).collect())) == spans
        assert Counter((r.doc_id, r.text) for r in substrings.without_repeats(docs).collect()) == Counter(zip([d for d, _ in pairs], texts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(any(s[0] == d for s in spans) for d in range(3, 200, 3))


def test_a_passage_repeated_inside_one_document(spark):
    text = prose(1, 30) + " " + PASSAGE + " " + prose(2, 30) + " " + PASSAGE + " " + prose(3, 30)
    (r,) = substrings.without_repeats(docs_of(spark, [(1, text)])).collect()
    assert r.text.count(PASSAGE) == 1 and r.text.count(PASSAGE[60:-80]) == 1
    assert r.text.startswith(prose(1, 30) + " " + PASSAGE) and r.text.endswith(prose(3, 30)[80:])


def test_repeats_of_an_empty_table(spark):
    assert substrings.repeated_spans(docs_of(spark, [])).collect() == []
    assert substrings.without_repeats(docs_of(spark, [])).collect() == []


def test_passage_query_on_the_whole_table(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op10_repeated_chunks"](spark, SF).collect())) == plain_spans(pairs)[0]

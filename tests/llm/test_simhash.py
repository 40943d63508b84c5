from collections import Counter

import re
import xxhash
import pytest

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import simhash
from voxfare.llm.queries import QUERIES


def plain_print(text):
    """The definition, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{print: set of prints} over links of three bits or fewer, by comparing all pairs."""
    kinds, group = sorted(set(prints)), {}
    for p in kinds:
        group[p] = {p}
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if bin(a ^ b).count("1") <= 3 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for p in merged:
                    group[p] = merged
    return group


def expected(pairs):
    prints = [plain_print(t) for _, t in pairs]
    group = plain_components(prints)
    low = {}
    for (doc, _), p in zip(pairs, prints):
        if doc is not None:
            root = min(group[p])
            low[root] = min(low.get(root, doc), doc)
    return Counter((d, f"{p:016x}", low.get(min(group[p]))) for (d, _), p in zip(pairs, prints))


def near_text(seed, words, change):
    text = prose(seed, words).split()
    text[change % words] = "other"
    return " ".join(text)


def test_awkward_rows_match_all_pairs(spark):
    pairs = [*AWKWARD, *[(20 + i, near_text(3, 400, 7 * i)) for i in range(20)]]
    found = Counter(map(tuple, simhash.near_duplicates(docs_of(spark, pairs)).collect()))
    assert found == expected(pairs)


def test_empty_table(spark):
    out = simhash.near_duplicates(docs_of(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.collect() == []
    assert simhash.keep_one(docs_of(spark, [])).collect() == []


def test_fingerprint_at_exactly_half_is_zero():
    text = "a b c d"  # two shingles: bits that only one has are no majority
    a, b = (xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d"))
    assert simhash.fingerprint(text) == a & b == plain_print(text)


def test_long_lists_link_like_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 24, 400))
    near = values[:100] ^ (1 << rng.integers(0, 24, 100)) ^ (1 << rng.integers(0, 24, 100))
    rests = np.unique(np.r_[values, near]).astype(np.int32)
    a, b = simhash.long_links(rests)
    group = {i: {i} for i in range(len(rests))}
    for x, y in zip(a.tolist(), b.tolist()):
        merged = group[x] | group[y]
        for p in merged:
            group[p] = merged
    plain = plain_components(rests.tolist())
    assert [{int(rests[j]) for j in group[i]} for i in range(len(rests))] == [plain[v] for v in rests.tolist()]


def test_keep_one_keeps_the_smallest_of_each_group_and_null_keys(spark):
    pairs = [(3, prose(1, 60)), (2, prose(1, 60)), (9, prose(2, 60)), (None, prose(1, 60)), (9, prose(2, 60))]
    docs = docs_of(spark, pairs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9, None]


def test_keep_one_loses_no_text_where_ids_repeat(spark):
    pairs = [(9, prose(1, 60)), (9, prose(2, 60)), (9, prose(1, 60)), (4, prose(3, 60)), (12, prose(2, 60)), (5, None), (5, "")]
    kept = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(docs_of(spark, pairs)).collect())
    assert kept == sorted([(9, prose(1, 60)), (9, prose(2, 60)), (4, prose(3, 60)), (5, "")])


def test_query_matches_all_pairs_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op8_simhash_index"](spark, sf).collect())) == expected(pairs)


@pytest.mark.parametrize("text", ["", " ", "A B", "Ä É x", "one two three", "a  b\tc\x0bd"])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("bits", [0, 2, 4, 8])
def test_other_radii_are_refused(spark, bits):
    with pytest.raises(ValueError, match="five bytes"):
        simhash.near_duplicates(docs_of(spark, [(1, prose(1, 20)), (2, prose(1, 20))]), max_bits=bits)

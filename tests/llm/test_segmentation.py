from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import AWKWARD, docs_of
from voxfare.llm import segmentation
from voxfare.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return segmentation.Pieces(PATH).open(3)


def all_paths(lattice, text):
    """Scores of all segmentations of a text, by walking every way through the lattice."""
    whole = " " + text
    into = lattice.arcs(whole)

    def back(node):
        if node == 0:
            yield 0
        for start, gain, _ in into[node]:
            for rest in back(start):
                yield rest + gain

    return sorted(back(len(whole)), reverse=True)


def check_text(lattice, text):
    found = lattice.segment(text)
    assert [s for s, _, _, _ in found] == all_paths(lattice, text)[:3]
    assert len({ids for _, _, ids, _ in found}) == len(found)
    assert all(same and lattice.decode(ids) == text and len(ids) == 4 * n for _, n, ids, same in found)


@pytest.mark.parametrize("text", ["a", "ab", "the cat", "  x ", "hello", "naïve", "日本", "a  b", "\ta", "is it so"])
def test_best_paths_are_those_of_an_exhaustive_walk(lattice, text):
    check_text(lattice, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aeinrst  ä日\t\U0001f600"), min_size=1, max_size=9))
def test_random_strings_by_an_exhaustive_walk(lattice, text):
    check_text(lattice, text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aeinrst ü"), min_size=1, max_size=12))
def test_forward_pass_knows_the_two_best_paths(lattice, word):
    for part in segmentation.WORDS.findall(" " + word):
        score, n, ids, gap = lattice[part]
        ways = lattice.ways_of(part)
        assert (score, n, ids) == ways[0] and part not in lattice.lost
        assert gap == (ways[0][0] - ways[1][0] if len(ways) > 1 else float("inf"))


@pytest.mark.parametrize("text", ["the cat sat", "Hello, wonderful world!", "naïve café", "日本語 text", "a b c"])
def test_decoding_equals_the_library(lattice, text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for _, _, ids, _ in lattice.segment(text):
        assert library.decode(memoryview(ids).cast("I").tolist()) == text == lattice.decode(ids)


def test_awkward_rows_are_restored(spark):
    found = segmentation.segment_documents(docs_of(spark, AWKWARD), segmentation.Pieces(PATH)).collect()
    assert all(r.restored for r in found)
    best = Counter(r.doc_id for r in found if r["rank"] == 1)
    assert best == Counter(d for d, _ in AWKWARD)
    assert all(r.n_pieces == 0 for r in found if r.doc_id in (1, 2))


def test_empty_table(spark):
    assert segmentation.segment_documents(docs_of(spark, []), segmentation.Pieces(PATH)).collect() == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op7_nbest_pieces"](spark, sf).collect()
    assert {r.doc_id for r in found} == docs.keys() and all(r.restored for r in found)
    by_doc = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r["rank"])):
        by_doc.setdefault(r.doc_id, []).append(r.score)
    assert all(s == sorted(s, reverse=True) and len(s) <= 3 for s in by_doc.values())

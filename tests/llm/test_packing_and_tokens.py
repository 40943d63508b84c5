import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import AWKWARD, docs_of
from voxfare.llm import packing, token_files
from voxfare.llm.encoding import Encoder
from voxfare.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"


def library_ids(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z.,'\t\n\r 9é  日\U0001f600<|>endoftext-\x85"), max_size=30) | st.text(max_size=30).filter(lambda t: t.isprintable()))
def test_encoder_equals_the_library(text):
    assert Encoder(PATH).open().encode(text) == np.array(library_ids(text, 0)[:-1], dtype="<u4").tobytes()


def check_packing(pairs, found, window=2048):
    """Each id in one piece, each sequence gapless, and the pieces those of the library's ids."""
    whole = Counter()
    for d, t in pairs:
        ids = library_ids(t, 1)
        for start in range(0, len(ids), window):
            own = ids[start : start + window]
            whole[(d, start, len(own), crc(own), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == whole
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(filled) == list(range(len(filled)))
    return len(filled), sum(k[2] * n for k, n in whole.items())


def test_awkward_rows_are_packed_once(spark):
    check_packing(AWKWARD, packing.pack_documents(docs_of(spark, AWKWARD), Encoder(PATH)).collect())


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(docs_of(spark, []), Encoder(PATH)).collect() == []


def test_packing_query_on_the_whole_table_wastes_little(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sequences, ids = check_packing(pairs, QUERIES["op4_nnls_packing"](spark, SF).collect())
    assert sequences * 2048 <= ids * 1.02 + 2048


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_every_piece_once(histogram):
    used = Counter()
    for part, times in packing.pack_plan(histogram, 64):
        assert sum(part) <= 64 and times > 0
        for v in part:
            used[v] += times
    assert used == Counter(histogram)


def test_least_squares_finds_a_mix_that_exists():
    columns = [(6, 4), (5, 5), (4, 3, 3)]
    target = np.zeros(11)
    for c, n in zip(columns, (30, 20, 10)):
        for v in c:
            target[v] += n
    assert np.allclose(packing.nonnegative_least_squares(columns, target, 3000), [30, 20, 10], atol=0.5)


def check_tokens(pairs, found):
    sizes = Counter((d, len(library_ids(t, 0)), crc(library_ids(t, 0))) for d, t in pairs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sizes
    at, last = 0, None
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def test_awkward_rows_round_trip(spark):
    check_tokens(AWKWARD, token_files.tokens_round_trip(docs_of(spark, AWKWARD), Encoder(PATH)).collect())


def test_token_files_of_an_empty_table(spark):
    assert token_files.tokens_round_trip(docs_of(spark, []), Encoder(PATH)).collect() == []


def test_token_query_on_the_whole_table(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_tokens(pairs, QUERIES["op5_orc_tokens"](spark, SF).collect())


def test_stored_ids_are_read_back_by_id(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_tokens(docs_of(spark, AWKWARD), path, Encoder(PATH))
    only = token_files.read_tokens(spark, path).filter("doc_id = 7").collect()
    assert [r.ids for r in only] == [library_ids(dict(AWKWARD)[7], 0)]

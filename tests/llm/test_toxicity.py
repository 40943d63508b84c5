import zlib

import numpy as np
import pytest

from helpers import AWKWARD, docs_of, prose
from voxfare.llm import toxicity
from voxfare.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, text string"


def labels_of(spark, marks):
    return spark.createDataFrame([(d, 1, t, "not the text") for d, t in marks], LABELS)


@pytest.fixture(scope="module")
def planted(spark):
    pairs = [(i, prose(i, 60) + (" vile scum rot" if i % 6 == 0 else "")) for i in range(300)]
    return pairs, [(i, int(i % 6 == 0)) for i in range(300) if i % 5 < 2]


def test_planted_words_are_found_on_held_out_rows(spark, planted):
    pairs, marks = planted
    found = toxicity.score_documents(docs_of(spark, pairs), labels_of(spark, marks)).collect()
    assert {r.doc_id: r.held_out for r in found} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in pairs}
    assert all(r.predicted == int(r.doc_id % 6 == 0) == int(r.score >= 0.7) for r in found)


def test_awkward_rows_are_scored_once(spark, planted):
    pairs, marks = planted
    rows = [*pairs, *[(d and d + 1000, t) for d, t in AWKWARD]]
    found = toxicity.score_documents(docs_of(spark, rows), labels_of(spark, [*marks, (None, 1), (1001, None), (0, 0)])).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, (d for d, _ in rows)))
    assert all(0 <= r.score <= 1 for r in found) and all(r.held_out for r in found if r.doc_id is None)
    clean = toxicity.keep_clean(docs_of(spark, rows), labels_of(spark, marks))
    assert clean.columns == docs_of(spark, []).columns and clean.count() == len(rows) - 50


@pytest.mark.parametrize("toxic", [1, 0])
def test_a_text_with_a_third_of_the_labels_counts_once(spark, planted, toxic):
    pairs, marks = planted
    copies = [(d, prose(6_000, 60) + (" vile scum rot" if toxic else "")) for d in range(6_000, 6_090) if zlib.crc32(str(d).encode()) % 3 != 1]
    alone, hot = (
        {r.doc_id: r.score for r in toxicity.score_documents(docs_of(spark, [*pairs, *part]), labels_of(spark, [*marks, *[(d, toxic) for d, _ in part]])).collect()}
        for part in (copies[:1], copies)
    )
    assert all(abs(hot[d] - alone[d]) < 1e-9 and (hot[d] >= toxicity.THRESHOLD) == (d % 6 == 0) for d, _ in pairs)


def test_held_out_labels_change_nothing(spark, planted):
    pairs, marks = planted
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in marks]
    one, other = (sorted(map(tuple, toxicity.score_documents(docs_of(spark, pairs), labels_of(spark, m)).collect())) for m in (marks, turned))
    assert one == other


@pytest.mark.parametrize("marks, docs", [([], AWKWARD), ([(1, 1)], []), ([(d, 1) for d in range(1, 11)], AWKWARD), ([(d, 0) for d in range(1, 11)], AWKWARD)])
def test_nothing_to_learn_from(spark, marks, docs):
    found = toxicity.score_documents(docs_of(spark, docs), labels_of(spark, marks)).collect()
    assert len(found) == len(docs) and len({r.score for r in found}) <= 1


def test_risk_does_not_learn_unlabelled_rows_as_negatives():
    rng = np.random.default_rng(1)
    toxic = rng.random(600) < 0.3
    marked = np.flatnonzero(toxic)[:60]
    positive = np.zeros(600, dtype=bool)
    positive[marked] = True  # a third of the toxic rows; the rest is unlabelled
    rows = np.r_[np.arange(600), np.flatnonzero(toxic)]
    words = np.r_[np.full(600, 0), np.full(toxic.sum(), 1)]
    weights, bias = toxicity.fit_nnpu(rows, words, positive, 2, 0.3)
    assert weights.sum() + bias > 0 > weights[0] + bias  # unmarked toxic rows are told from the others


def test_query_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in QUERIES["op6_nnpu_toxicity"](spark, sf).collect() if r.held_out and marks.get(r.doc_id) is not None]
    y, p = np.array([marks[r.doc_id] for r in found]), np.array([r.predicted for r in found])
    precision, recall = (y & p).sum() / max(1, p.sum()), (y & p).sum() / y.sum()
    print("precision", precision, "recall", recall, "rows", len(y), y.sum())
    assert precision > 0.85 and recall > 0.85

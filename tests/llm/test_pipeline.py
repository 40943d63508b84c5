from collections import Counter

import pytest

import corpus_pipeline
from helpers import prose
from voxfare.llm.common import stored, table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = prose(7_777, 80)


def folder(spark, tmp_path, pairs, marks):
    path = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in pairs], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def staged(spark, path):
    docs, out = table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, path), "test-stage")
    return out


def test_each_stage_does_its_part(spark, tmp_path):
    pairs = [(i, prose(i, 60) + (" vile scum rot" if i % 6 == 0 else "")) for i in range(400)]
    pairs += [(500, prose(1, 60)), (501, prose(7, 60)), (502, prose(900, 50) + " " + PASSAGE), (503, prose(901, 50) + " " + PASSAGE), (504, None), (505, "")]
    path = folder(spark, tmp_path, pairs, [(i, 1, int(i % 6 == 0)) for i in range(400) if i % 5 < 3])
    out = staged(spark, path)
    clean, single, unrepeated, packed = out.values()
    assert clean.columns == single.columns == unrepeated.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    toxic = {i for i in range(0, 400, 6)}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in pairs} - toxic
    kept = {r.doc_id for r in single.collect()}
    assert kept == {d for d, _ in pairs} - toxic - {500, 501, 505}  # null and empty texts are copies of each other
    texts = {r.doc_id: r for r in unrepeated.collect()}
    assert texts.keys() == kept and PASSAGE in texts[502].text and PASSAGE[50:-100] not in texts[503].text
    assert texts[503].n_chars == len(texts[503].text) and texts[2].text == dict(pairs)[2]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == kept
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "start", "length", "ids_crc32").collect())) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


@pytest.mark.parametrize("pairs", [[], [(1, None), (1, None), (None, None), (2, "x" * 100_000)]])
def test_empty_and_odd_tables(spark, tmp_path, pairs):
    out = staged(spark, folder(spark, tmp_path, pairs, []))
    assert {r.doc_id for r in list(out.values())[-1].collect()} == {d for d, _ in pairs}

import numpy as np
import pytest

from voxfare.llm import nearest
from voxfare.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, print string, rank int, v double"


def plain(rows, is_query, k=10):
    """All distances, in double precision."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero([is_query(v) for v in ids.tolist()]):
        score = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def grouped(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    sound = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    sound += [(100 + i, sound[3][1]) for i in range(30)]  # copies of one vector: ties go to smaller ids
    bad = [(200, None), (300, []), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0] * 4), (800, [1.0, 2.0])]
    rows = [(i, v, 1, "a", 1, 0.5) for i, v in [*sound, *bad, *sound[:5]]]
    found = grouped(nearest.nearest(spark.createDataFrame(rows, VECTORS), "vec_id % 10 = 0").collect())
    rounded = [(i, np.float32(v).astype(float).tolist()) for i, v in sound]
    want = plain(rounded, lambda v: v % 10 == 0)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_fewer_candidates_than_asked_and_empty_table(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, "a", 1, 0.1), (1, [2.0, 2.0], 1, "a", 1, 0.1)], VECTORS)
    assert grouped(nearest.nearest(few, "vec_id = 0").collect()) == {0: [(1, 1.0)]}
    assert nearest.nearest(few.limit(0), "vec_id = 0").collect() == []
    alone = few.filter("vec_id = 0")
    assert nearest.nearest(alone, "vec_id = 0").collect() == []


@pytest.mark.parametrize("bits, dims", [(2, 2), (3, 3), (2, 4)])
def test_hilbert_keys_visit_neighbouring_cells(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = nearest.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_windows_alone_reach_the_recall_asked_for(spark):
    """Clusters in 64 dimensions, with windows that reach a twelfth of the rows to either side."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 64))
    rows = [(i, np.float32(centres[i % 10] + 0.5 * rng.normal(size=64)).tolist(), 1, "a", 1, 0.1) for i in range(5_000)]
    found = grouped(nearest.nearest(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0", least_window=64).collect())
    want = plain(rows, lambda v: v % 100 == 0)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    print("recall", hits / (10 * len(want)))
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("deviation", [1e-4, 1e-12])
def test_a_tight_group_of_a_third_of_the_rows(spark, deviation):
    """The group lies within one cell of a coarse grid; windows reach a quarter of it to either side."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 64))
    x[::3] = x[0] + deviation * rng.normal(size=(1_000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = grouped(nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 30 = 0", least_window=64).collect())
    want = plain(rows, lambda v: v % 30 == 0)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    print("recall", hits / (10 * len(want)))
    assert hits >= 0.95 * 10 * len(want)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found, want = grouped(QUERIES["op1_hilbert_search"](spark, sf).collect()), plain(rows, lambda v: v % 100 == 0)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))

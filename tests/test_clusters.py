"""Many clusterings in one pass, against Spark's evaluator and plain distances."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voxfare.operators import clusters


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(6)
    rows = [(i, [6.0 * (i % 3 == d) + rng.gauss(0, 1) for d in range(3)]) for i in range(150)] + [(200, [0.0] * 3), (201, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id int, x array<double>").repartition(4)
    return df.select("id", array_to_vector("x").alias("v")).persist()


def nearest(points, centres):
    return {r["id"]: int(((centres - r["v"].toArray()) ** 2).sum(axis=1).argmin()) for r in points.collect()}


def test_sums_of_many_sets(points):
    rows = {r["id"]: r["v"].toArray() for r in points.collect()}
    sets = {"a": np.stack([rows[i] for i in range(3)]), "b": np.stack([rows[i] for i in range(5)]), "far": np.array([[0.0] * 3, [1e6] * 3])}
    for name, c in clusters.cluster_sums(points, "v", sets).items():
        near = nearest(points, sets[name])
        for k in range(len(sets[name])):
            own = [rows[i] for i, n in near.items() if n == k]
            assert c.n[k] == len(own)
            assert c.sums[k] == pytest.approx(sum(own) if own else np.zeros(3)) and c.squares[k] == pytest.approx(sum(float(x @ x) for x in own))
        assert c.cost == pytest.approx(sum(((rows[i] - sets[name][k]) ** 2).sum() for i, k in near.items()))


def test_silhouettes_equal_the_evaluator(spark, points):
    best = clusters.best_of_starts(points, "v", [2, 3, 4], starts=4)
    found = {r["k"]: r["silhouette"] for r in clusters.silhouettes(points, "v", best).collect()}
    evaluator = ClusteringEvaluator(featuresCol="v", predictionCol="c")
    for k, c in best.items():
        labels = spark.createDataFrame(list(nearest(points, c.centres).items()), "id int, c int")
        assert found[k] == pytest.approx(evaluator.evaluate(points.join(labels, "id")))
    assert max(found, key=found.get) == 3
    assert best[2].cost > best[3].cost > best[4].cost


def test_single_rows_and_empty_clusters_score_zero(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "a double").select(array_to_vector(F.array("a")).alias("v"))
    found = clusters.cluster_sums(df, "v", {2: np.array([[0.0], [9.0]]), 3: np.array([[0.0], [9.0], [100.0]]), 1: np.array([[0.0]])})
    got = {r["k"]: r["silhouette"] for r in clusters.silhouettes(df, "v", found).collect()}
    pair = ((81 - 1) / 81 + (64 - 1) / 64) / 3  # the third row is alone in its cluster
    assert got == pytest.approx({2: pair, 3: pair, 1: 0.0})


def test_more_clusters_than_rows(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "a double").select(array_to_vector(F.array("a")).alias("v"))
    best = clusters.best_of_starts(df, "v", [4], starts=3)
    assert best[4].cost == 0.0 and best[4].n.tolist() in ([1, 2], [2, 1])


def test_starts_are_the_same_in_every_run(points):
    first, again = (clusters.hash_starts(df, "v", [2, 3], 3) for df in (points, points.repartition(7)))
    assert first.keys() == again.keys() == {(k, s) for k in (2, 3) for s in range(3)}
    assert all((first[n] == again[n]).all() for n in first)


def test_nearest_is_that_of_exact_differences():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 5)), 1e6 + rng.normal(size=(300, 5)) * 1e-7, np.zeros((3, 5))])
    for centres in (x[:7], np.concatenate([x[300:306], x[:2]]), np.concatenate([x[:2], x[:2], x[-2:]])):
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        assert (clusters._nearest(x, (x * x).sum(axis=1), centres) == d.argmin(axis=1)).all()


def test_one_spark_fit_follows_the_starts(spark, points, monkeypatch):
    """The model is that of the seed of least cost, and only that seed is fitted to its end by Spark."""
    full = []

    class Noted(KMeans):
        def _fit(self, dataset):
            full.append(self.getMaxIter() > 0)
            return super()._fit(dataset)

    rows = points.select("v").persist()
    fits = [KMeans(k=4, featuresCol="v", predictionCol="cluster_id", seed=s, maxIter=40).fit(rows) for s in range(6)]
    monkeypatch.setattr(clusters, "KMeans", Noted)
    model = clusters.kmeans(points, "v", 4, range(6), max_iter=40)
    assert sorted(full) == [False] * 6 + [True]
    want = min(fits, key=lambda m: m.summary.trainingCost)
    assert model.summary.trainingCost == pytest.approx(want.summary.trainingCost, rel=1e-9)
    assert np.stack(model.clusterCenters()) == pytest.approx(np.stack(want.clusterCenters()))

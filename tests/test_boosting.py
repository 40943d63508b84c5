import random
import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import functions as F

from voxfare.operators import boosting, propensity, trees
from voxfare.operators.boosting import OneTaskBoosting


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows in three parts: a real number, many and few levels, a 0/1 column twice, a constant."""
    rnd = random.Random(11)
    data = []
    for i in range(900):
        a, b, c, d = rnd.gauss(0, 1), rnd.randint(0, 60) / 4, rnd.choice([-1.0, 0.0, 1.0]), float(rnd.random() < 0.2)
        data.append((i, float(a + c + d + rnd.gauss(0, 0.7) > 0.3), rnd.choice([0.7, 1.6]), a, b, c, d, d, 3.0))
    df = spark.createDataFrame(data, "id int, target double, weight double, a double, b double, c double, d double, e double, f double")
    return propensity.assemble(df.repartition(3, "id"), list("abcdef")).persist()


@pytest.fixture(autouse=True)
def one_task(monkeypatch):
    """All tables count as large enough."""
    monkeypatch.setattr(boosting, "SPARK_ROWS", 0)


def _pair(**more):
    kw = {"featuresCol": "features", "labelCol": "target", "weightCol": "weight", "seed": 7, **more}
    return OneTaskBoosting(**kw), GBTClassifier(**kw)


def _shape(node):
    return node["leftChild"], node["rightChild"], node["split"], node["rawCount"]


def _numbers(node):
    return [node["prediction"], node["impurity"], node["gain"], *node["impurityStats"]]


@pytest.mark.parametrize(
    "more",
    [
        {"maxIter": 12, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
        {"maxIter": 4, "maxDepth": 4, "minInstancesPerNode": 20, "minInfoGain": 0.01, "maxBins": 8},
        {"maxIter": 3, "maxDepth": 2, "featureSubsetStrategy": "sqrt", "minWeightFractionPerNode": 0.1},
    ],
)
def test_trees_are_those_of_spark(spark, rows, more):
    one, own = _pair(**more)
    fitted, want = one.fit(rows), own.fit(rows)
    got, expected = trees.saved_nodes(fitted, spark), trees.saved_nodes(want, spark)
    assert isinstance(fitted, GBTClassificationModel) and fitted.uid == one.uid
    assert list(fitted.treeWeights) == list(want.treeWeights) and fitted.numFeatures == 6
    assert got.keys() == expected.keys()
    for tree, nodes in expected.items():
        assert {k: _shape(n) for k, n in got[tree].items()} == {k: _shape(n) for k, n in nodes.items()}
        for k, node in nodes.items():
            assert _numbers(got[tree][k]) == pytest.approx(_numbers(node), rel=1e-6, abs=1e-9)
    assert list(fitted.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()))
    pairs = fitted.transform(rows).select("id", F.col("probability").alias("p")).join(want.transform(rows).select("id", F.col("probability").alias("q")), "id").collect()
    assert len(pairs) == 900 and all(r["p"].toArray() == pytest.approx(r["q"].toArray()) for r in pairs)
    assert fitted.getMaxIter() == want.getMaxIter() and fitted.getLabelCol() == "target"


def test_split_points_of_many_rows_are_those_of_spark(spark):
    """Over 10,000 rows Spark looks for split points in a sample; it does so in both of its ways of sampling."""
    for n, parts in ((14_000, 1), (30_000, 2)):
        df = spark.range(0, n, 1, parts).select(
            (F.col("id") * 7919 % 10_007 / 100).alias("a"), F.pow(F.col("id") * 31 % 1_009, 2).alias("b"), (F.xxhash64("id") % 7 > 1).cast("double").alias("target")
        )
        held = propensity.assemble(df.withColumn("weight", 1 + F.col("target")), ["a", "b"]).persist()
        one, own = _pair(maxIter=1, maxDepth=4)
        got, expected = (trees.saved_nodes(e.fit(held), spark)[0] for e in (one, own))
        assert {k: _shape(v) for k, v in got.items()} == {k: _shape(v) for k, v in expected.items()} and len(got) > 5
        held.unpersist()


def _jobs(spark, step):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        step()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_boosted_fit_runs_no_job_per_level(spark, rows):
    few, many = (_jobs(spark, lambda n=n: propensity.boosted("target", rounds=n, depth=3).fit(rows)) for n in (2, 10))
    assert many <= few < 20  # the first may start more


@pytest.mark.parametrize("bad", [{"target": 2.0}, {"weight": -1.0}, {"weight": None}])
def test_rows_that_spark_refuses_are_refused(rows, bad):
    name, value = next(iter(bad.items()))
    spoilt = rows.withColumn(name, F.when(F.col("id") == 5, F.lit(value).cast("double")).otherwise(F.col(name)))
    with pytest.raises(Exception):
        propensity.boosted("target", rounds=2, depth=2).fit(spoilt)


def test_more_rows_than_a_task_takes_go_to_spark(rows, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CELLS", 900 * 6 - 1)
    monkeypatch.setattr(OneTaskBoosting, "_grown", lambda *_: pytest.fail("grown in one task"))
    assert propensity.boosted("target", rounds=2, depth=2).fit(rows).getNumTrees == 2


def test_few_rows_go_to_spark(rows, monkeypatch):
    monkeypatch.setattr(boosting, "SPARK_ROWS", 900)
    ran = []
    whole = OneTaskBoosting._grown
    monkeypatch.setattr(OneTaskBoosting, "_grown", lambda self, *a: ran.append(1) or whole(self, *a))
    propensity.boosted("target", rounds=2, depth=2).fit(rows)
    assert ran == []
    propensity.boosted("target", rounds=2, depth=2, spark_rows=0).fit(rows)
    assert ran == [1]


def test_random_numbers_of_spark():
    # java.util.Random(42).nextLong() and Spark's first state for seed 42
    assert boosting.JavaRandom(42).long() == -5025562857975149833
    assert sorted(boosting.feature_subset(9, 9, 3)) == list(range(9)) and len(set(boosting.feature_subset(42, 34, 5))) == 34
    taken = boosting.uniforms_below([3, 4], 500, 0.8)
    rng = boosting.XorShift(4)
    assert taken[:, 1].tolist() == [rng.uniform() < 0.8 for _ in range(500)] and 0.7 < np.mean(taken) < 0.9

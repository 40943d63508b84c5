"""Vectors and clusters with Spark ML: vectorise, normalise, choose k, fit, label, project, summarise."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.functions import text
from voxfare.functions.scores import holds
from voxfare.operators.ranking import attach
from voxfare.operators.summaries import crosstab, mode_by, with_row_total
from voxfare.operators.voice import cluster_examples
from voxfare.session import side_by_side

SEED = 42
K_RANGE = (4, 12)


def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """Stored float arrays as ML vectors."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def text_vectors(
    df: DataFrame, col: str, out: str = "features", method: str = "tfidf", vocabulary: int = 1 << 18, word_size: int = 100,
    brand_words: Iterable[str] = (),
) -> tuple[DataFrame, PipelineModel]:
    """Texts as TF-IDF or Word2Vec vectors, for use where no stored embeddings exist.

    TF-IDF has one place per word, without hash buckets, for the ``vocabulary`` most frequent words: the vocabulary belongs to the
    model and is held by the driver. ``voice.term_weights`` gives the weights of all words as a table instead.
    """
    stages = [
        RegexTokenizer(inputCol=col, outputCol="__w", pattern=r"[^\p{L}]+", minTokenLength=3),
        StopWordsRemover(inputCol="__w", outputCol="__k", stopWords=list(text.stop_words(brand_words))),
    ]
    if method == "tfidf":
        stages += [
            CountVectorizer(inputCol="__k", outputCol="__tf", vocabSize=vocabulary),
            IDF(inputCol="__tf", outputCol=out),
        ]
    else:
        stages.append(Word2Vec(inputCol="__k", outputCol=out, vectorSize=word_size, minCount=1, seed=SEED))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).drop("__w", "__k", "__tf"), model


def normalize(df: DataFrame, vec: str, out: str = "unit") -> DataFrame:
    """Vectors of length one; clustering then goes by direction."""
    return Normalizer(p=2.0, inputCol=vec, outputCol=out).transform(df)


def k_candidates(n_rows: int, limits: tuple[int, int] = K_RANGE) -> list[int]:
    """Cluster counts worth trying for a table of this size."""
    return list(range(limits[0], min(limits[1], n_rows // 10)))


@dataclass(frozen=True)
class Clustering:
    """Centres with, per centre, the number of rows nearest to it, their sum and their sum of squared lengths."""

    centres: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    cost: float


def _row_blocks(batch: pa.RecordBatch) -> np.ndarray | None:
    """The vectors of an Arrow batch, whose first column is an array of doubles, as one matrix without copies per row."""
    column = batch.column(0)
    if not len(column):
        return None
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) % len(column):
        raise ValueError("every row needs a vector of the same length")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row, ties to the first centre.

    Products of matrices tell the distances up to rounding. Where another centre is within that error of the nearest, exact
    differences decide, so the answer is that of exact differences.
    """
    about = lengths[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    near = about.argmin(axis=1)
    error = 1e-13 * x.shape[1] * (lengths + (centres * centres).sum(axis=1).max())
    close = about <= (about[np.arange(len(x)), near] + 2 * error)[:, None]
    unsure = np.flatnonzero((close.sum(axis=1) != 1) | ~np.isfinite(error))
    if len(unsure):
        near[unsure] = np.stack([((x[unsure] - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)
    return near


def cluster_sums(df: DataFrame, vec: str, sets: Mapping[Any, np.ndarray], costs: bool = True) -> dict[Any, Clustering]:
    """Rows, sums and cost of many sets of centres at once, in one pass over the rows; without ``costs`` the cost is NaN.

    Each task adds up its rows per centre and emits one row for each; Spark adds the vectors of a centre. What reaches the
    driver has the size of the centres.
    """
    names = list(sets)
    shared = df.sparkSession.sparkContext.broadcast([np.asarray(sets[name], dtype=np.float64) for name in names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            x = _row_blocks(batch)
            if x is None:
                continue
            lengths, at = (x * x).sum(axis=1), np.arange(len(x))
            for i, centres in enumerate(shared.value):
                near = _nearest(x, lengths, centres)
                d = ((x - centres[near]) ** 2).sum(axis=1) if costs else np.full(len(x), np.nan)
                k = len(centres)
                member = np.zeros((k, len(x)))
                member[near, at] = 1.0
                new = (np.bincount(near, minlength=k), member @ x, np.bincount(near, lengths, k), np.bincount(near, d, k))
                held[i] = tuple(p + q for p, q in zip(held[i], new)) if i in held else new
        for i, (n, sums, squares, cost) in held.items():
            k = len(n)
            cells = (np.full(k, i, dtype=np.int32), np.arange(k, dtype=np.int32), n.astype(np.int64), pa.array(list(sums)), squares, cost)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], names=["set_no", "centre", "n", "total", "squares", "cost"])

    parts = df.select(vector_to_array(vec).alias("x")).mapInArrow(add, "set_no int, centre int, n long, total array<double>, squares double, cost double")
    added = parts.groupBy("set_no", "centre").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("squares").alias("squares"), F.sum("cost").alias("cost")
    ).collect()  # one row per centre
    out = {}
    for i, name in enumerate(names):
        centres = np.asarray(sets[name], dtype=np.float64)
        n, sums, squares, cost = np.zeros(len(centres), dtype=np.int64), np.zeros_like(centres), np.zeros(len(centres)), 0.0
        for r in added:
            if r["set_no"] == i:
                n[r["centre"]], sums[r["centre"]], squares[r["centre"]] = r["n"], r["total"].toArray(), r["squares"]
                cost += r["cost"]
        out[name] = Clustering(centres, n, sums, squares, cost)
    shared.destroy()
    return out


def silhouettes(df: DataFrame, vec: str, found: Mapping[int, Clustering]) -> DataFrame:
    """Mean silhouette (squared distances) of many clusterings, in one pass: columns k and silhouette.

    The mean squared distance of a row to a cluster follows from the cluster's sums: no row meets another. A row
    alone in its cluster scores 0; clusters without rows do not count.
    """
    names = list(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        rows = 0
        for batch in batches:
            x = _row_blocks(batch)
            if x is None:
                continue
            lengths, at = (x * x).sum(axis=1), np.arange(len(x))
            for i, name in enumerate(names):
                c = found[name]
                own = _nearest(x, lengths, c.centres)
                n = np.maximum(c.n, 1)
                mean = np.maximum(lengths[:, None] + c.squares / n - 2 * (x @ (c.sums / n[:, None]).T), 0.0)
                mean[:, c.n == 0] = np.inf
                inside = mean[at, own] * c.n[own] / np.maximum(c.n[own] - 1, 1)
                mean[at, own] = np.inf
                near = mean.min(axis=1)
                alone = (c.n[own] <= 1) | np.isinf(near)
                most = np.maximum(inside, near)
                total[i] += np.where(alone | (most == 0), 0.0, (near - inside) / np.where(alone | (most == 0), 1.0, most)).sum()
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.int32)), pa.array(total), pa.array(np.full(len(names), rows, dtype=np.int64))], names=["k", "total", "n"])

    parts = df.select(vector_to_array(vec).alias("x")).mapInArrow(score, "k int, total double, n long")
    return parts.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("silhouette"))


def hash_starts(df: DataFrame, vec: str, ks: Sequence[int], starts: int, seed: int = SEED) -> dict[tuple[int, int], np.ndarray]:
    """For each k and start, k rows as first centres: the rows in an order by hash, a block of the largest k for each start.

    Equal rows come once, so that no two centres of a start are equal; too few rows give fewer starts, the first always.
    """
    most = max(ks)
    x = vector_to_array(vec)
    rows = df.select(x.alias("x")).groupBy("x").agg(F.lit(1)).select("x", F.xxhash64(F.lit(seed), "x").alias("h"))
    points = [np.array(r["x"]) for r in rows.orderBy("h").limit(most * starts).collect()]  # starts x the largest k
    blocks = [points[s * most : (s + 1) * most] for s in range(starts)]
    return {(k, s): np.stack(b[:k]) for k in ks for s, b in enumerate(blocks) if len(b) >= k or s == 0 and b}


def lloyd(df: DataFrame, vec: str, starts: Mapping[Any, np.ndarray], max_iter: int, tolerance: float = 1e-4) -> dict[Any, Clustering]:
    """Lloyd's steps for many starts at once, each until no centre moves further than ``tolerance``.

    One pass over the rows moves the centres of every start that still moves; costs are summed once, in a last pass. A centre without rows stays where it is.
    """
    moving, done = dict(starts), {}
    for step in range(max_iter + 1):
        found = cluster_sums(df, vec, moving, costs=False)
        moving = {}
        for name, c in found.items():
            new = np.where(c.n[:, None] > 0, c.sums / np.maximum(c.n, 1)[:, None], c.centres)
            if step < max_iter and ((new - c.centres) ** 2).sum(axis=1).max() > tolerance**2:
                moving[name] = new
            else:
                done[name] = c.centres
        if not moving:
            break
    return cluster_sums(df, vec, done)


def best_of_starts(df: DataFrame, vec: str, ks: Sequence[int], starts: int = 10, seed: int = SEED, max_iter: int = 300, tolerance: float = 1e-4) -> dict[int, Clustering]:
    """The clustering of least cost among the starts of each k, by Lloyd's steps for all of them at once."""
    done = lloyd(df, vec, hash_starts(df, vec, ks, starts, seed), max_iter, tolerance)
    return {k: min((c for (own, _), c in sorted(done.items(), key=lambda x: x[0]) if own == k), key=lambda c: c.cost) for k in ks if any(own == k for own, _ in done)}


def choose_k(df: DataFrame, vec: str, ks: Sequence[int], seed: int = SEED, max_iter: int = 300, starts: int = 10) -> tuple[int, DataFrame]:
    """Cluster count with the greatest mean silhouette over all rows, and the table of scores: k, silhouette, cost."""
    rows = df.select(vec).persist()
    try:
        best = best_of_starts(rows, vec, ks, starts, seed, max_iter)
        scores = [(r["k"], float(r["silhouette"]), float(best[r["k"]].cost)) for r in silhouettes(rows, vec, best).orderBy("k").collect()]
    finally:
        rows.unpersist()
    table = df.sparkSession.createDataFrame(scores, "k int, silhouette double, cost double")
    return max(scores, key=lambda s: (s[1], -s[0]))[0], table


def kmeans(
    df: DataFrame, vec: str, k: int, seeds: Iterable[int] = range(SEED, SEED + 15), max_iter: int = 500
) -> KMeansModel:
    """The fit of least cost among several starts.

    The first centres of every seed are Spark's own. All starts then move together, one pass over the rows per step, and the seed
    of least cost is fitted by Spark. Where costs agree up to rounding the first seed counts.
    """
    rows = df.select(vec).persist()
    try:
        fits = {s: KMeans(k=k, featuresCol=vec, predictionCol="cluster_id", seed=s, maxIter=max_iter) for s in seeds}
        if len(fits) == 1:
            return next(iter(fits.values())).fit(rows)
        first = side_by_side(df.sparkSession, [partial(fit.fit, rows, {fit.maxIter: 0}) for fit in fits.values()])
        starts = {s: np.stack(m.clusterCenters()) for s, m in zip(fits, first)}
        cost = {s: c.cost for s, c in lloyd(rows, vec, starts, max_iter).items()}
        least = min(cost.values())
        return fits[next(s for s in fits if cost[s] <= least * (1 + 1e-12))].fit(rows)
    finally:
        rows.unpersist()


def assign(model: KMeansModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def project2d(df: DataFrame, vec: str) -> DataFrame:
    """First two principal components of every row."""
    model = PCA(k=2, inputCol=vec, outputCol="__pc").fit(df)
    pc = vector_to_array("__pc")
    return model.transform(df).withColumn("pc1", pc[0]).withColumn("pc2", pc[1]).drop("__pc")


def centroids(df: DataFrame, cluster: str, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """Mean place of each cluster in the projection."""
    return df.groupBy(cluster).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, cluster: str) -> DataFrame:
    """Size and share of each cluster, in percent of all rows, one decimal."""
    counts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("frequency"))
    total = counts.agg(F.sum("frequency")).scalar()
    return counts.withColumn("pct_of_total", F.bround(F.col("frequency") / total * 100, 1))


def by_cabin(df: DataFrame, cluster: str, cabin: str, cabins: Sequence[str]) -> DataFrame:
    """Clusters against cabins, with the row total over the listed cabins."""
    return with_row_total(crosstab(df, cluster, cabin, cabins), cabins)


def summary(
    df: DataFrame, kind: str, cluster: str, label: str, rating: str, score: str, recommended: str,
    cabin: str, route: str, key: str, body: str,
) -> DataFrame:
    """One row per cluster: size, share, means, percent recommending, usual cabin and route, examples."""
    stats = df.groupBy(cluster, label).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.bround(F.avg(rating), 2).alias("avg_rating"),
        F.bround(F.avg(score), 3).alias("avg_sentiment"),
        (F.avg(holds(F.col(recommended) == "Yes")) * 100).alias("pct_recommended"),
    )
    total = stats.agg(F.sum("frequency")).scalar()
    out = stats.withColumn("pct_of_total", F.bround(F.col("frequency") / total * 100, 1))
    for part in (mode_by(df, [cluster], cabin), mode_by(df, [cluster], route), cluster_examples(df, cluster, key, body)):
        out = out.join(part, cluster, "left")
    return out.select(
        F.lit(kind).alias("sentiment_type"),
        F.col(cluster).alias("cluster_id"),
        F.col(label).alias("cluster_label"),
        "frequency", "pct_of_total", "avg_rating", "avg_sentiment", "pct_recommended",
        F.col(f"top_{cabin}").alias("top_cabin"),
        F.col(f"top_{route}").alias("top_route"),
        "examples",
    ).orderBy("sentiment_type", F.desc("frequency"), "cluster_id")


def label_rows(df: DataFrame, labels: DataFrame, cluster: str) -> DataFrame:
    return attach(df, labels, [cluster], "left")

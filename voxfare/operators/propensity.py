"""Recommendation propensity: features, split, models, evaluation, explanation, scoring."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from math import comb
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfare.functions.scores import flag_code, literal_map, rebook_code, safe_ratio, theme_code, to_double
from voxfare.operators import trees
from voxfare.operators.boosting import OneTaskBoosting
from voxfare.operators.forests import TreewiseForest
from voxfare.operators.ranking import bounded_rows, deal_folds, exact_quantiles, prefix_sum, row_numbers, salted_join, take_lowest, union_all, with_value
from voxfare.session import checkpointed, side_by_side
from voxfare.sources.files import gathered

SEED = 42

# Display names of the model features.
FEATURE_LABELS = {
    "feat_overall_rating": "Overall Rating (1–10)",
    "feat_seat_comfort": "Seat Comfort Score",
    "feat_cabin_staff": "Cabin Staff Score",
    "feat_food_beverage": "Food & Beverage Score",
    "feat_ife": "IFE Score",
    "feat_ground_service": "Ground Service Score",
    "feat_wifi": "Wi-Fi Score",
    "feat_value_for_money": "Value for Money Score",
    "feat_sentiment_score": "NLP Sentiment Score",
    "feat_trip_verified": "Trip Verified",
    "feat_is_sarcastic": "Sarcastic Tone (NLP)",
    "feat_competitor_mentioned": "Competitor Mentioned",
    "feat_rebook": "Would Rebook Signal",
    "feat_theme_seat_comfort": "NLP Theme: Seat Comfort",
    "feat_theme_cabin_crew": "NLP Theme: Cabin Crew",
    "feat_theme_food_beverage": "NLP Theme: Food & Bev",
    "feat_theme_ife": "NLP Theme: IFE",
    "feat_theme_wifi": "NLP Theme: Wi-Fi",
    "feat_theme_value": "NLP Theme: Value",
    "feat_year": "Year",
    "feat_month": "Month",
}
PREFIX_LABELS = {"seat_": "Cabin: ", "traveller_": "Traveller: ", "emotion_": "Emotion: "}
UP, DOWN = "Increases recommendation", "Decreases recommendation"


# ---------------------------------------------------------------- features

def binary_target(df: DataFrame, recommended: str, out: str = "target") -> DataFrame:
    """Rows with a clear answer, as 1 / 0."""
    return df.filter(F.col(recommended).isin("Yes", "No")).withColumn(
        out, (F.col(recommended) == "Yes").cast("int")
    )


@dataclass(frozen=True)
class FeatureSpec:
    """Which source column feeds which feature, by kind of coding."""

    numeric: Mapping[str, str] = field(default_factory=dict)
    flags: Mapping[str, str] = field(default_factory=dict)
    rebook: Mapping[str, str] = field(default_factory=dict)
    themes: Mapping[str, str] = field(default_factory=dict)
    categories: Mapping[str, str] = field(default_factory=dict)  # prefix -> source column


def coded(df: DataFrame, spec: FeatureSpec, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric, flag, ordinal and theme features; unknown values are NULL."""
    kinds = ((spec.numeric, to_double), (spec.flags, flag_code), (spec.rebook, rebook_code), (spec.themes, theme_code))
    out = [(name, code(src).alias(name)) for names, code in kinds for name, src in names.items()]
    cats = [c for c in spec.categories.values() if c not in keep]
    return df.select(*keep, *cats, *[c for _, c in out]), [n for n, _ in out]


def category_levels(df: DataFrame, col: str, max_levels: int = 1000) -> list[str]:
    """All levels of a category in order, a bounded list; a missing value is the level Unknown."""
    levels = df.select(F.coalesce(F.col(col).cast("string"), F.lit("Unknown")).alias("v")).distinct()
    local = bounded_rows(levels, max_levels)
    if local is None:
        raise ValueError(f"{col} has more than {max_levels} levels; one_hot_sparse codes any number of them")
    return sorted(r["v"] for r in local.collect())


def one_hot(df: DataFrame, col: str, prefix: str, levels: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A 0/1 column per level, none left out."""
    levels = list(levels) if levels is not None else category_levels(df, col)
    value = F.coalesce(F.col(col).cast("string"), F.lit("Unknown"))
    names = [f"{prefix}_{v}" for v in levels]
    return df.select("*", *[(value == v).cast("double").alias(n) for v, n in zip(levels, names)]), names


def level_index(df: DataFrame, col: str) -> DataFrame:
    """(level, index, n): every level of a category with its place in order, from 0, and its number of rows.

    A missing value is the level Unknown. The levels are numbered range by range, so they may be any number.
    """
    level = F.coalesce(F.col(col).cast("string"), F.lit("Unknown")).alias("level")
    counts = df.select(level).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("one"))
    return prefix_sum(counts, "level", ["one"]).select("level", (F.col("cum_one") - 1).cast("int").alias("index"), "n")


def one_hot_sparse(df: DataFrame, col: str, out: str, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with a sparse 0/1 vector ``out`` over all levels of a category, none left out, and the table of levels.

    ``levels`` is a table of ``level_index``; a level that it does not hold gives an empty vector. Unlike ``one_hot`` no level becomes a
    column, so there is no limit to their number. Names with two leading underscores are not allowed.
    """
    if levels is None:
        levels = checkpointed(level_index(df, col), "levels")
    keyed = df.withColumn("__level", F.coalesce(F.col(col).cast("string"), F.lit("Unknown")))
    named = levels.select(F.col("level").alias("__level"), F.col("index").cast("double").alias("__index"))
    coded = salted_join(keyed, named, ["__level"], "left")
    size = levels.count()
    encoder = OneHotEncoder(inputCol="__index", outputCol=out, dropLast=True, handleInvalid="error")
    # one place more than there are levels: the last one, which is dropped, stands for levels without a place
    known = coded.withColumn("__index", F.coalesce("__index", F.lit(float(size))))
    fitted = encoder.fit(levels.sparkSession.createDataFrame([(float(size),)], "__index double"))
    return fitted.transform(known).drop("__index", "__level").select(*df.columns, out), levels


def features(df: DataFrame, spec: FeatureSpec, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Coded and one-hot features beside the kept columns, and the feature names in order."""
    out, names = coded(df, spec, keep)
    for prefix, col in spec.categories.items():
        out, more = one_hot(out, col, prefix)
        names += more
    return out.select(*keep, *names), names


def missing_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values per column and their total, from one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "feature", "n_missing")


def stratified_split(
    df: DataFrame, target: str, key: str, test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: the exact share of each class, in a fixed random order."""
    quota = F.round(F.col("__size") * test_share)
    return take_lowest(df, [target], key, seed, quota).withColumnRenamed("__taken", "is_test")


def fold_column(df: DataFrame, key: str, target: str | None = None, folds: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Fold number in a fixed random order, with the same share of each class of ``target`` in every fold, to the row."""
    return deal_folds(df, [target] if target else [], key, folds, seed + 1, name)


def fit_imputer(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows, the mean of the two middle values where their number is even; a column
    without any value gets 0. One number per column reaches the driver."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    found = {r["feature"]: r["median"] for r in exact_quantiles(long, "value", {"median": 0.5}, ["feature"]).collect()}
    return {c: found.get(c, 0.0) for c in cols}


def impute(medians: Mapping[str, float], df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Features with gaps filled, under their own names; NaN is a gap as well."""
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(medians[c]))) for c in cols}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (k n_c) of each of the k classes."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", share / F.col("n"))


def balanced(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Add the balanced weight n / (k n_c) of each row's class among k classes; a NULL class has no weight."""
    weights = class_weights(df.filter(F.col(target).isNotNull()), target).select(F.col(target).alias("__class"), F.col("weight").alias("__weight"))
    joined = df.join(weights, F.col(target) == F.col("__class"), "left")
    return joined.select(*[c for c in df.columns if c != name], F.col("__weight").alias(name))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def fit_scaler(train: DataFrame, col: str = "features", out: str = "scaled") -> Model:
    """Zero mean, unit (sample) deviation."""
    return StandardScaler(inputCol=col, outputCol=out, withMean=True, withStd=True).fit(train)


# ---------------------------------------------------------------- models

def logistic(train: DataFrame, target: str, features_col: str = "scaled", c: float = 1.0, max_iter: int = 2000):
    """L2 logistic regression; the penalty 1/C is spread over the weight total as Spark averages its loss."""
    total = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        featuresCol=features_col, labelCol=target, weightCol="weight", regParam=1.0 / (c * total),
        elasticNetParam=0.0, maxIter=max_iter, standardization=False,
    )


def forest(target: str, trees: int = 300, min_leaf: int = 5, depth: int = 30, seed: int = SEED):
    """Trees grow until their leaves are small; 30 levels are the most that Spark's trees can have.

    Over 5,000 rows each tree is grown by one task; below, Spark grows them all level by level. The node that each row has reached is then
    kept from pass to pass. Without that every pass walks every row down every tree of its group from the root; the trees are the same.
    """
    return TreewiseForest(
        featuresCol="features", labelCol=target, weightCol="weight", numTrees=trees,
        minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed, cacheNodeIds=True,
    )


def boosted(target: str, rounds: int = 300, step: float = 0.05, depth: int = 5, seed: int = SEED, spark_rows: int | None = None):
    """Every round depends on the one before; where the rows fit into one task, it grows all the trees as Spark's jobs do, unless there are
    ``spark_rows`` or fewer."""
    estimator = OneTaskBoosting(
        featuresCol="features", labelCol=target, weightCol="weight", maxIter=rounds, stepSize=step,
        maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    estimator.spark_rows = spark_rows
    return estimator


def fit(estimator, rows: DataFrame) -> Model:
    """``estimator`` fitted to cached rows. The logistic model adds up one gradient per pass and the boosted one grows a single tree at a time,
    so both read them in few partitions and leave cores to the forest beside them. Samples of tree models are drawn by partition."""
    return estimator.fit(gathered(rows) if isinstance(estimator, (LogisticRegression, GBTClassifier)) else rows)


def cross_validate(estimator, train: DataFrame, target: str, folds: int = 5, fold: str = "fold") -> DataFrame:
    """Mean and deviation of the area under the curve over given folds, numbered from 0; the folds are fitted side by side.

    Spark's ``CrossValidator`` runs only parameter maps side by side, its folds one after another, and fits all rows once more.
    """
    found = {r[fold] for r in train.groupBy(fold).count().limit(folds + 1).collect()}
    if folds < 2 or found != set(range(folds)):
        raise ValueError(f"{fold} must hold each number from 0 to {folds - 1} and no other, in two folds or more")
    evaluator = BinaryClassificationEvaluator(labelCol=target)

    def area(held_out: int) -> float:
        training, validation = (train.filter(c).persist() for c in (F.col(fold) != held_out, F.col(fold) == held_out))
        try:
            return evaluator.evaluate(fit(estimator, training).transform(validation))
        finally:
            training.unpersist()
            validation.unpersist()

    areas = side_by_side(train.sparkSession, [partial(area, i) for i in range(folds)])
    return train.sparkSession.createDataFrame([(float(np.mean(areas)), float(np.std(areas)))], "cv_auc_mean double, cv_auc_sd double")


def cross_validate_all(estimators: Mapping[str, Any], train: DataFrame, target: str, folds: int = 5, fold: str = "fold") -> DataFrame:
    """One row of ``cross_validate`` per model."""
    return union_all(*[cross_validate(e, train, target, folds, fold).select(F.lit(n).alias("model"), "*") for n, e in estimators.items()])


def score(model: Model, df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Predicted class and probability of the positive class."""
    out = model.transform(df)
    return out.select(
        *keep,
        F.col("prediction").cast("int").alias(f"{prefix}_predicted"),
        vector_to_array("probability")[1].alias(f"{prefix}_proba"),
    )


def score_all(models: Mapping[str, Model], df: DataFrame, target: str, key: str) -> DataFrame:
    """Actual class with class and rounded probability of each model, side by side.

    The models run one after another over the same rows, so no join is needed.
    """
    keep = [key, F.col(target).alias("actual")]
    out, added = df, []
    for prefix, model in models.items():
        scored = model.transform(out)
        names = (f"{prefix}_predicted", f"{prefix}_proba")
        out = scored.select(
            *[F.col(c) for c in out.columns],
            F.col("prediction").cast("int").alias(names[0]),
            F.round(vector_to_array("probability")[1], 4).alias(names[1]),
        )
        added += names
    return out.select(*keep, *added)


# ---------------------------------------------------------------- evaluation

def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Cells of the confusion matrix and accuracy, in one row."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    table = df.agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"),
    )
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return table.withColumn("accuracy", safe_ratio(F.col("tp") + F.col("tn"), total))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""

    def row(name: int, hit: str, extra: str, missed: str) -> Column:
        h, e, m = F.col(hit), F.col(extra), F.col(missed)
        return F.struct(
            F.lit(name).alias("class"),
            safe_ratio(h, h + e).alias("precision"),
            safe_ratio(h, h + m).alias("recall"),
            safe_ratio(h * 2, h * 2 + e + m).alias("f1"),
            (h + m).alias("support"),
        )

    both = F.array(row(0, "tn", "fn", "fp"), row(1, "tp", "fp", "fn"))
    return matrix.select(F.explode(both).alias("r")).select("r.*")


def roc(df: DataFrame, actual: str, score_col: str, few: bool = False) -> DataFrame:
    """Points of the curve, one per distinct score from the highest down, by a distributed running sum."""
    known = with_value(df.filter(F.col(actual).isNotNull()), score_col)
    counts = (
        known.groupBy(score_col)
        .agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"))
    )
    run = prefix_sum(counts, score_col, ["pos", "neg"], (), descending=True, few=few)
    return run.select(
        F.col(score_col).alias("threshold"),
        safe_ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        safe_ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        "pos", "neg", "cum_pos", "cum_neg", "total_pos", "total_neg",
    )


def auc(df: DataFrame, actual: str, score_col: str, few: bool = False) -> DataFrame:
    """Area under the curve as the share of ordered (positive, negative) pairs; ties count half."""
    points = roc(df, actual, score_col, few)
    won = F.sum((F.col("cum_pos") - F.col("pos") + F.col("pos") / 2) * F.col("neg"))
    return points.agg(
        safe_ratio(won, F.max(F.col("total_pos").cast("double") * F.col("total_neg").cast("double"))).alias("auc")
    )


def comparison(scored: DataFrame, prefixes: Sequence[str], actual: str = "actual") -> DataFrame:
    """Accuracy, F1 of both classes and area under the curve of several models."""
    out = None
    for p in prefixes:
        matrix = confusion(scored, actual, f"{p}_predicted")
        area = auc(scored, actual, f"{p}_proba").scalar()
        row = matrix.select(
            F.lit(p).alias("model"),
            "accuracy",
            safe_ratio(F.col("tn") * 2, F.col("tn") * 2 + F.col("fn") + F.col("fp")).alias("f1_no"),
            safe_ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1_yes"),
            area.alias("auc"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- importance and explanation

def importances(spark: SparkSession, names: Sequence[str], boosted_model, forest_model, logistic_model) -> DataFrame:
    """One row per feature: importance in both tree models and coefficient."""
    rows = [
        (n, float(b), float(r), float(c))
        for n, b, r, c in zip(
            names,
            boosted_model.featureImportances.toArray(),
            forest_model.featureImportances.toArray(),
            logistic_model.coefficients.toArray(),
        )
    ]
    return spark.createDataFrame(rows, "feature string, boosted_importance double, forest_importance double, lr_coefficient double")


def display_name(c: Column | str) -> Column:
    """Readable label: listed names as given, one-hot names with their group, others in title case."""
    c = F.col(c) if isinstance(c, str) else c
    listed = F.try_element_at(literal_map(FEATURE_LABELS), c)
    other = c
    for prefix, label in PREFIX_LABELS.items():
        other = F.replace(other, F.lit(prefix), F.lit(label))
    return F.coalesce(listed, F.initcap(F.replace(other, F.lit("_"), F.lit(" "))))


def framework(table: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """Ranked features with label, direction of effect and, where given, dimension and insight.

    ``dimensions`` has the columns feature, product_dimension and investment_insight.
    """
    out = table.withColumn("feature_label", display_name("feature")).withColumn(
        "direction", F.when(F.col("lr_coefficient") > 0, UP).otherwise(DOWN)
    ).withColumn("is_zero", F.col("lr_coefficient") == 0)
    if dimensions is not None:
        out = out.join(dimensions, "feature", "left")
    return row_numbers(out, [F.desc("boosted_importance"), F.asc("feature")])


def product_features(table: DataFrame, k: int = 12, prefix: str = "feat_") -> DataFrame:
    """The k best features that are product levers."""
    return table.filter(F.col("feature").startswith(prefix)).orderBy("rank").limit(k)


def linear_shap(model, train: DataFrame, df: DataFrame, names: Sequence[str], features_col: str = "scaled", key: str = "id") -> DataFrame:
    """Exact contributions of a linear model: coefficient times distance from the training mean.

    Long form: one row per row key and feature.
    """
    mean = train.agg(Summarizer.mean(F.col(features_col))).first()[0]  # one number per feature
    x = vector_to_array(features_col)
    parts = F.array(*[
        F.struct(F.lit(n).alias("feature"), ((x[i] - float(mean[i])) * float(model.coefficients[i])).alias("phi"))
        for i, n in enumerate(names)
    ])
    return df.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def global_shap(shap: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return shap.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def tree_paths(model, spark: SparkSession) -> list[dict[str, Any]]:
    """Root-to-leaf paths of an ensemble: per leaf its value, and per feature on the path the interval of
    values that leads there and the share of training weight that followed it.
    """
    weights = list(model.treeWeights)
    leaves = []
    for tree, table in sorted(trees.saved_nodes(model, spark).items()):
        todo = [(0, {})]
        while todo:
            at, taken = todo.pop()
            node = table[at]
            if node["leftChild"] < 0:
                leaves.append({"value": float(node["prediction"]) * weights[tree], "path": taken})
                continue
            f, limit = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            cover = float(node["impurityStats"][0]) or 1.0  # training weight that reached the node
            for child, side in ((node["leftChild"], "low"), (node["rightChild"], "high")):
                low, high, share = taken.get(f, (-np.inf, np.inf, 1.0))
                part = float(table[child]["impurityStats"][0]) / cover
                bounds = (low, min(high, limit)) if side == "low" else (max(low, limit), high)
                todo.append((child, {**taken, f: (*bounds, share * part)}))
    return leaves


def _leaf_contributions(x: np.ndarray, leaves: list[dict[str, Any]], n_features: int) -> np.ndarray:
    """Shapley values of a sum of leaves for every row.

    A leaf pays its value to the coalition of its path features: a feature in the coalition contributes 1 or
    0 (does the row satisfy it?), one outside contributes the share of training weight. With m features on
    the path, the weighted sum over all coalitions of the others is read off the coefficients of the product
    of (share + satisfied * t), so the cost per leaf is m squared vector operations.
    """
    phi = np.zeros((len(x), n_features))
    for leaf in leaves:
        path = leaf["path"]
        if not path:
            continue
        feats = list(path)
        m = len(feats)
        ok = [((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype("float64") for f in feats]
        share = [path[f][2] for f in feats]
        weight = [1.0 / (m * comb(m - 1, s)) for s in range(m)]
        for j, f in enumerate(feats):
            poly = [np.ones(len(x))]
            for k in range(m):
                if k == j:
                    continue
                longer = [np.zeros(len(x)) for _ in range(len(poly) + 1)]
                for d, coef in enumerate(poly):
                    longer[d] += coef * share[k]
                    longer[d + 1] += coef * ok[k]
                poly = longer
            total = sum(w * coef for w, coef in zip(weight, poly))
            phi[:, f] += leaf["value"] * (ok[j] - share[j]) * total
    return phi


def leaf_shap(leaves: Sequence[Mapping[str, Any]], df: DataFrame, names: Sequence[str], key: str, x: Column) -> DataFrame:
    """Contribution of each feature to a sum of leaves (see ``tree_paths``), one row per row key and feature.

    The leaves travel to the workers as one broadcast, of the model's size; rows are handled in Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(leaves))
    names = list(names)
    rows = df.select(F.col(key).cast("string").alias(key), x.alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            phi = _leaf_contributions(np.stack(pdf["x"].to_numpy()), shared.value, len(names))
            yield pd.DataFrame(
                {key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(pdf), "phi": phi.ravel()}
            )

    return rows.mapInPandas(explain, f"`{key}` string, feature string, phi double")


def tree_shap(model, df: DataFrame, names: Sequence[str], key: str, features_col: str = "features") -> DataFrame:
    """Contribution of each feature to the margin of a boosted model, one row per row key and feature."""
    return leaf_shap(tree_paths(model, df.sparkSession), df, names, key, vector_to_array(features_col))


def dependence_grids(df: DataFrame, names: Sequence[str], chosen: Sequence[str], points: int = 100, features_col: str = "features") -> dict[str, tuple[int, list[float]]]:
    """Place and grid of each chosen feature: even steps between the 5 % and 95 % quantiles, or the distinct values
    where those are fewer than ``points``."""
    x = vector_to_array(features_col)
    at = {f: list(names).index(f) for f in chosen}
    shape = df.agg(
        *[
            F.struct(F.approx_count_distinct(x[i]).alias("n"), F.percentile_approx(x[i], [0.05, 0.95], 10_000).alias("q")).alias(f)
            for f, i in at.items()
        ]
    ).first()
    grids = {}
    for f, i in at.items():
        few = None
        if shape[f]["n"] < 2 * points:  # near the limit the estimate does not decide, the count does
            few = bounded_rows(df.select(x[i].alias("v")).distinct(), points - 1)
        grids[f] = (i, sorted(r["v"] for r in few.collect()) if few is not None else [float(v) for v in np.linspace(*shape[f]["q"], points)])
    return grids


def partial_dependence(model, df: DataFrame, names: Sequence[str], chosen: Sequence[str], points: int = 100, features_col: str = "features") -> DataFrame:
    """Mean output of a tree ensemble with one feature set to each grid value, over all rows: ``mean_proba`` of a
    forest, ``mean_margin`` of a boosted model."""
    grids = dependence_grids(df, names, chosen, points, features_col)
    out = "mean_margin" if isinstance(model, GBTClassificationModel) else "mean_proba"
    return trees.partial_dependence(df, vector_to_array(features_col), trees.trees_of(model, df.sparkSession), grids, out)

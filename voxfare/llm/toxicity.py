"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P. The unlabelled sample U is all training documents, whatever their
labels say: it holds toxic ones at the class prior p, as the estimator asks, so confirmed ones belong to it too. A linear
classifier over the presence of words and word beginnings is fitted in numpy: the risk is ``p R+(P) + max(0, R-(U) - p R-(P))``, and where
the second part turns negative the step goes the other way, so the classifier does not learn unlabelled rows as
negatives by heart. Words are chosen by counts over the training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import slices, stored, texts_of

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word beginning.
BEGINNING = 5
#: Bounds of the fit: positives, other rows, and words in the model.
FIT_POSITIVES, FIT_UNLABELLED, FIT_WORDS = 20_000, 40_000, 2_000
#: Documents that must hold a word before the model may weigh it.
LEAST_DOCUMENTS = 5
#: How much more frequent it must be in positives than in all rows: words that tell nothing cost time and add noise.
LEAST_LIFT = 2.0
#: Standard deviations by which its count in positives must exceed that of a word without bearing.
LEAST_DEVIATIONS = 5.0
THRESHOLD = 0.7


def marks_of(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and the beginnings of the longer ones, which inflected forms share."""
    words = set(WORD.findall(text.lower()))
    return words | {"^" + w[:BEGINNING] for w in words if len(w) >= BEGINNING}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        found = marks_of(text) & self.weights.keys()
        f = self.bias + sum(sorted(self.weights[w] for w in found))
        return float(1 / (1 + np.exp(-np.clip(f, -50, 50))))


def held_out(key: Column) -> Column:
    """Rows that no label is learned from; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def fit_nnpu(
    rows: np.ndarray, words: np.ndarray, positive: np.ndarray, n_words: int, prior: float, confirmed: float | None = None,
    rounds: int = 400, rate: float = 0.05, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias from the sparse matrix (rows, words) of word presence; ``positive`` marks confirmed rows.

    ``confirmed`` is the share of confirmed rows among all; it weighs a sample that took the two kinds at different rates.
    """
    n = len(positive)
    confirmed = positive.mean() if confirmed is None else confirmed
    n_pos, n_other = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    in_all = np.where(positive, confirmed / n_pos, (1 - confirmed) / n_other)
    theta = np.zeros(n_words + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        f = theta[-1] + np.bincount(rows, weights=theta[words], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        as_negative = np.logaddexp(0, f)
        rest = (in_all * as_negative).sum() - prior * as_negative[positive].mean()
        up = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        down = in_all * p - np.where(positive, prior * p / n_pos, 0.0)
        slope = up + down if rest >= 0 else -down
        grad = np.append(np.bincount(words, weights=slope[rows], minlength=n_words), slope.sum())
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [sorted(marks_of(t)) for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("print"), part.column("toxic"), pa.array(found, type=pa.list_(pa.string()))], names=["print", "toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the rows that are not held out.

    Equal texts count once, as toxic if one of them is, in the prior as in the sample and its weights. The prior is the
    share of toxic ones among the labelled training texts, so texts must be labelled without regard to toxicity. At most FIT_POSITIVES and FIT_UNLABELLED texts, those
    with the lowest hashes, are taken and weighed by their numbers in the whole table. Several labels of a key: the highest holds. Without
    toxic or without other texts the score is the prior of every document.
    """
    marks = labels.filter(f"`{key}` is not null and `{label}` is not null").groupBy(F.col(key).alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).filter(~held_out(F.col("doc_id")))
    seen = read.join(marks, "doc_id", "left").select("doc_id", "text", F.xxhash64("text").alias("print"), F.col("toxic").isNotNull().cast("int").alias("labelled"), (F.coalesce("toxic", F.lit(0)) == 1).cast("int").alias("toxic"))
    kinds = stored(seen.groupBy("print").agg(F.max("toxic").alias("toxic"), F.max("labelled").alias("labelled"), F.min("doc_id").alias("doc_id")), "toxic-prints")
    counted = kinds.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled")).collect()
    totals, labelled = {r["toxic"]: r["n"] for r in counted}, sum(r["labelled"] for r in counted)
    prior = totals.get(1, 0) / labelled if labelled else 0.0
    lowest = [kinds.filter(F.col("toxic") == flag).orderBy("print").limit(most) for flag, most in ((1, FIT_POSITIVES), (0, FIT_UNLABELLED))]
    # one document stands for all copies of its text, so copies do not meet in one task
    own = read.withColumn("print", F.xxhash64("text"))
    chosen = own.join(lowest[0].unionByName(lowest[1]), ["doc_id", "print"]).dropDuplicates(["print"])
    words = stored(chosen.select("print", "toxic", "text").mapInArrow(_distinct_words, "print long, toxic int, words array<string>"), "toxic-words")
    sizes = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = Model({}, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (50.0 if prior else -50.0))
    if not sizes.get(1) or not sizes.get(0):
        return constant
    counts = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    expected = F.col("n") * sizes[1] / (sizes[0] + sizes[1])
    tell = (F.col("p") - expected) / F.sqrt(expected)
    kept = [r["word"] for r in counts.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("p") > LEAST_LIFT * expected) & (tell >= LEAST_DEVIATIONS)).orderBy(F.desc(tell), "word").limit(FIT_WORDS).select("word").collect()]
    if not kept:
        return constant
    place = {w: i for i, w in enumerate(kept)}

    def chosen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in ws if w in place] for ws in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("toxic"), pa.array(found, type=pa.list_(pa.int32()))], names=["print", "toxic", "at"])

    sample = words.mapInArrow(chosen_words, "print long, toxic int, at array<int>").orderBy("print", "toxic").toPandas()
    rows = np.repeat(np.arange(len(sample)), sample["at"].map(len))
    flat = np.concatenate([np.asarray(a, dtype=np.int64) for a in sample["at"]])
    confirmed = totals[1] / (totals[0] + totals[1])
    weights, bias = fit_nnpu(rows, flat, sample["toxic"].to_numpy() == 1, len(kept), prior, confirmed)
    return Model({w: float(x) for w, x in zip(kept, weights)}, bias)


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Add ``__score`` to all columns of ``docs``."""
    names = [*docs.columns, "__score"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["`__score` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = pa.array([model.score(t) for t in texts_of(part, text)], type=pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=names)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, held_out, score and predicted (1 from THRESHOLD on) of each row.

    A null text counts as empty and is scored like any text. Rows with a null key are held out and scored; repeated rows
    each give a row; an empty table gives an empty result. Other columns are never read.
    """
    model = fit(docs, labels, text, key)
    out = _scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, "text")
    score = F.col("__score")
    return out.select(F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is below THRESHOLD, with all their columns unchanged."""
    model = fit(docs, labels, text, key)
    return _scored(docs, model, text).filter(F.col("__score") < THRESHOLD).select(*docs.columns)

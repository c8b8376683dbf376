"""Quality of documents by a regularised quadratic discriminant over statistics of their texts.

Each class has its own Gaussian over transformed statistics; its covariance is shrunk towards the pooled one and
towards a multiple of the identity. The score is the posterior of label 1, from the difference of the two log-densities:
Mahalanobis distances by triangular solves with Cholesky factors that are computed once, and log-determinants from their diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import materialise, ship_package

POOLED = 0.1  # weight of the pooled covariance
SPHERE = 0.01  # weight of the mean variance on all axes
STEEP = 0.5  # log-density differences are scaled before the logistic, as statistics are not independent

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "letter", "terminal", "comma", "symbol", "bang",
    "bar", "distinct_words", "distinct_lines", "line_words",
)


def statistics(text: Column) -> Column:
    """Transformed statistics of a whole text that is not null, an array in the order of ``FEATURES``.

    Plain expressions without lambdas, so that generated code works out each shared part once.
    """
    n = F.length(text).cast("double")
    words, lines = F.split(F.lower(text), r"\s+"), F.split(text, "\n")
    nw, nl = F.size(words).cast("double"), F.size(lines).cast("double")
    of_class = lambda others: F.length(F.regexp_replace(text, others, ""))  # noqa: E731  characters left without the others
    one_of = lambda chars: n - F.length(F.translate(text, chars, ""))
    part = lambda count: F.log((count + 0.5) / (n - count + 0.5))  # noqa: E731  the logit of a share, smoothed
    return F.array(
        F.log(n + 1),
        F.log(nw),
        F.log((n - nw + 2) / nw),
        part(of_class(r"\P{Lu}+")),
        part(of_class(r"[^0-9]+")),
        part(of_class(r"\S+")),
        part(of_class(r"\P{L}+")),
        part(one_of(".?")),
        part(one_of(",;:")),
        part(one_of("#$%&*+<=>@\\^_~{}[]")),
        part(one_of("!")),
        part(one_of("|")),
        F.log(F.size(F.array_distinct(words)) / nw),
        F.log(F.size(F.array_distinct(lines)) / nl),
        F.log(nw / nl),
    )


@dataclass
class Model:
    prior: float  # log-odds of label 1
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    logdets: list[float]
    steep: float = STEEP

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        gap = np.clip(self.steep * (density[1] - density[0]) + self.prior, -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, pooled: float = POOLED, sphere: float = SPHERE) -> Model | float:
    """Class means and shrunk covariances of ``labelled (x, label)``, from sums that Spark adds up over all rows.

    A task sends one row per class and batch group: counts, sums and products. If a class is missing, the answer is the share of
    label 1 (0.5 without any rows), which then scores all.
    """
    p = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, p)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "v"])

    rows = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(sums, "label int, v array<double>")
    added = rows.select("label", F.posexplode("v").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 (1 + p + p^2) rows
    total = np.zeros((2, 1 + p + p * p))
    for r in added:
        total[r.label, r.i] = r.v
    counts = total[:, 0]
    if counts.min() < 2:
        return float(counts[1] / counts.sum()) if counts.sum() else 0.5
    means = [total[k, 1 : 1 + p] / counts[k] for k in (0, 1)]
    scatter = [total[k, 1 + p :].reshape(p, p) - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / counts.sum()
    factors, logdets = [], []
    for k in (0, 1):
        cov = (1 - pooled) * scatter[k] / counts[k] + pooled * common
        cov = (1 - sphere) * cov + sphere * (np.trace(common) / p + 1e-9) * np.eye(p)
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(chol, np.eye(p)))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Model(0.0, means, factors, logdets)


def score_documents(docs: DataFrame, labels: DataFrame, trains: Column, pooled: float = POOLED, sphere: float = SPHERE) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs (doc_id, text)``.

    ``labels (doc_id, quality)`` teach where the condition ``trains`` on the doc_id holds; classes weigh the same whatever their
    numbers. ``score`` is near 1 where label 1 is likelier, ``predicted`` is 1 from a score of 0.5 on.

    A null text counts as empty, and an empty one has statistics like any other. Of contradicting labels of one document the mean,
    from 0.5 on, says 1. A null doc_id is scored and never taught from. Repeated rows are returned each. Other columns are not
    looked at. Without labels of both classes all documents get the share of label 1 (0.5 without labels). Empty tables are fine.
    """
    ship_package(docs.sparkSession)
    measured = docs.select("doc_id", statistics(F.coalesce(F.col("text"), F.lit(""))).alias("x"))
    measured = materialise(measured, "statistics")
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    model = fit(measured.where(trains).join(taught, "doc_id"), pooled, sphere)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.asarray(batch.flatten(), dtype=np.float64).reshape(len(batch), len(FEATURES))
            yield pa.array(model.scores(x) if isinstance(model, Model) else np.full(len(x), model))

    out = measured.select("doc_id", score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

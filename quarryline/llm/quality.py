"""Document quality by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics. Class means and covariances come from sums over all
training rows, added up in Spark; each covariance is shrunk towards a scaled identity and factored once (Cholesky).
A score is the logistic of the difference of the two classes' Gaussian log densities (Mahalanobis distance, log
determinant) plus the log prior ratio. Null and empty texts have a vector too (all counts zero). Null labels are
ignored; a document labelled more than once counts with its highest label; without two labelled classes every score is
1.0 (nothing is rejected). Repeated rows are scored each; extra columns are ignored by `features` and kept by `score`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

SHRINKAGE = 0.1
_N = 256
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, *range(9, 14)], "line": [10], "bang": [33, 63], "symbol": b"#$%&*@^~", "bar": b"|<>{}[]\\/_=+",
    "stop": b".,;:", "high": range(128, 256), "control": [*range(0, 9), *range(14, 32), 127],
}
_TABLE = np.zeros((_N, len(_CLASSES)))
for _k, _codes in enumerate(_CLASSES.values()):
    _TABLE[list(_codes), _k] = 1
NAMES = [*_CLASSES, "length", "words", "word_length", "distinct", "capitals", "entropy", "line_repeat"]


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics a text."""
    hist, extra = np.zeros((len(texts), _N)), np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if raw:
            hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=_N)
        words, lines = text.split(), text.split("\n")
        extra[i] = len(words), len(set(words)), sum(map(str.istitle, words)), len(set(lines)) / len(lines)
    n = hist.sum(1, keepdims=True)
    share = (hist @ _TABLE + 0.5) / (n + 1)
    p = hist / np.maximum(n, 1)
    words = extra[:, :1]
    tail = np.hstack([np.log1p(n), np.log1p(words), np.log1p(n / (words + 1)), np.sqrt((extra[:, 1:2] + 1) / (words + 1)), np.sqrt((extra[:, 2:3] + 0.5) / (words + 1)), -(p * np.log(np.where(p > 0, p, 1))).sum(1, keepdims=True), extra[:, 3:4]])
    return np.hstack([np.log(share), tail])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the statistics of the whole text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = statistics([t or "" for t in part["text"].to_pylist()])
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], rows], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By label: count, sum and sum of outer products over all (x, label) rows; a fixed number of values reaches the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch["x"].flatten()).reshape(batch.num_rows, -1)
            x, y = np.hstack([np.ones((len(x), 1)), x]), batch["label"].to_numpy()
            for c in np.unique(y):
                m = x[y == c]
                total[int(c)] = total.get(int(c), 0) + m.T @ m
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["label", "i", "v"])

    got = rows.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in sorted({r["label"] for r in got}):
        mine = sorted((r["i"], r["v"]) for r in got if r["label"] == c)
        m = np.array([v for _, v in mine]).reshape(int(round(len(mine) ** 0.5)), -1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


class QuadraticDiscriminant:
    """Two Gaussian classes with shrunk covariances and cached Cholesky factors."""

    def __init__(self, by_label: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.parts = []
        if not (0 in by_label and 1 in by_label):
            return
        n = sum(by_label[c][0] for c in (0, 1))
        centre = sum(by_label[c][1] for c in (0, 1)) / n
        spread = sum(by_label[c][2] for c in (0, 1)) / n - np.outer(centre, centre)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-8))
        for c in (0, 1):
            k, s, q = by_label[c]
            mean = s / k
            cov = (q / k - np.outer(mean, mean)) / np.outer(scale, scale)
            cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(k / n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.ones(len(x))
        logs = [prior - det - 0.5 * ((((x - mean) / scale) @ inverse.T) ** 2).sum(1) for mean, scale, inverse, det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train(feats: DataFrame, labels: DataFrame, column: str = "quality", shrinkage: float = SHRINKAGE) -> QuadraticDiscriminant:
    """Learn from every document that is labelled; `labels` has doc_id and the label column. Only vectors and ids move."""
    known = labels.where(F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("label"))
    return QuadraticDiscriminant(moments(feats.join(known, "doc_id")), shrinkage)


def score(feats: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(doc_id, score) of every row of features()."""
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch["x"].flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return feats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """The label rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    feats = written(features(docs))
    return score(feats, train(feats, training_labels(labels)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those the classifier scores under the threshold; scored where the text is, no text is shuffled.

    The statistics are a table before they are summed, so that a task never runs two Python workers one after another.
    """
    learned_from = training_labels(labels)
    feats = written(features(training_labels(docs)))
    model = train(feats, learned_from)
    drop(feats)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(shared.value.score(statistics([t or "" for t in part["text"].to_pylist()])) >= threshold))

    return docs.mapInArrow(run, docs.schema)

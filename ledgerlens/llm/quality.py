"""A quality classifier: naive Bayes log-count ratios as feature scales of a linear support vector machine."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import write_table

DIMENSIONS = 1 << 18  # hashed n-gram features
SAMPLE_SIZE = 6000  # labelled documents that the model is fitted on, at most
SAMPLE_FEATURES = 12_000_000  # features of these documents together, at most: the driver holds some 20 bytes for each
EPOCHS = 30
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_MIX = 0x9E3779B1


def features(text: str | None) -> np.ndarray:
    """The hashed 1- and 2-grams that a text holds, each once: runs of letters and digits, and runs of signs."""
    tokens = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    if not tokens:
        return np.empty(0, np.int64)
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(_MIX) ^ one[1:] * np.uint64(_MIX + 2)) >> np.uint64(7)
    return np.unique(np.concatenate((one, two)) % np.uint64(DIMENSIONS)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (share of a feature among the positive class's counts / the same of the negative class)."""
    counts = np.full((2, DIMENSIONS), smoothing)
    for row, is_positive in zip(rows, positive, strict=True):
        counts[int(is_positive), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def fit_svm(
    rows: list[np.ndarray], scaled: list[np.ndarray], signs: np.ndarray, cost: float = 1.0, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent.

    Row i has the value scaled[i] at the features rows[i], and a constant 1 at
    the last place of the weights. Each step solves for one row's multiplier
    exactly; rows come in a new random order every epoch, from a fixed seed.
    """
    weights = np.zeros(DIMENSIONS + 1)
    alpha = np.zeros(len(rows))
    slack = 1.0 / (2.0 * cost)
    diagonal = np.array([float(v @ v) + 1.0 + slack for v in scaled])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            margin = float(weights[rows[i]] @ scaled[i]) + weights[-1]
            gradient = signs[i] * margin - 1.0 + slack * alpha[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * scaled[i]
                weights[-1] += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weights


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset that map margins to the probability of the positive class, by Newton's method."""
    n1 = float(positive.sum())
    n0 = len(positive) - n1
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack((margins, np.ones(len(margins))))
    beta = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    """ratios scale the features; weights belong to scaled features; the sigmoid turns margins into scores."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, row: np.ndarray) -> float:
        ratios = self.ratios[row]
        norm = math.sqrt(float(ratios @ ratios)) or 1.0
        return float(self.weights[row] @ ratios) / norm + float(self.weights[-1])

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    """The model of documents given by their features. Every fifth one is kept for the sigmoid.

    With fewer than five documents of a class, the score is the smoothed
    share of the positive class (0.5 without any documents).
    """
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if min(n1, n0) < 5:
        nothing = np.zeros(DIMENSIONS + 1)
        return Model(nothing[:-1], nothing, 0.0, math.log((n1 + 1) / (n0 + 1)))
    held = np.zeros(len(rows), bool)
    for side in (positive, ~positive):
        held[np.flatnonzero(side)[::5]] = True
    learned = np.flatnonzero(~held)
    ratios = log_count_ratios([rows[i] for i in learned], positive[learned])
    scaled = []
    for i in learned:
        values = ratios[rows[i]]
        scaled.append(values / (math.sqrt(float(values @ values)) or 1.0))
    weights = fit_svm([rows[i] for i in learned], scaled, np.where(positive[learned], 1.0, -1.0))
    model = Model(ratios, weights, 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(held)])
    slope, offset = fit_sigmoid(margins, positive[held])
    return Model(ratios.astype(np.float32), weights.astype(np.float32), slope, offset)


def within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of (id, size) in their order that fit into `most` together; one that does not fit is passed over."""
    kept, total = [], 0
    for number, size in sizes:
        if total + size <= most:
            kept.append(number)
            total += size
    return kept


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_SIZE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most `sample` labelled documents with at most `most_features` features together, chosen by hash of doc_id.

    `docs` has doc_id and text, `labels` doc_id and a label 0 or 1. Labels
    that are null or contradict each other are left out, as are documents
    without a doc_id; of texts with one doc_id the largest counts. The chosen
    labels are few, so they are broadcast and no text is shuffled before the
    choice. The driver gets the number of features of each chosen document and the features
    of those that fit, and fits the model.
    """
    agreed = (
        labels.filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
    )
    draw = F.xxhash64("doc_id").alias("draw")
    chosen = agreed.select("doc_id", "label", draw).orderBy("draw", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    whole = texts.groupBy("doc_id", "label", "draw").agg(F.max("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text) for text in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "label": batch.column("label").cast(pa.int32()),
                "draw": batch.column("draw"),
                "size": pa.array(list(map(len, rows)), pa.int32()),
                "features": pa.array([row.astype(np.int32) for row in rows], pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, label int, draw long, size int, features array<int>"
    extracted = write_table(whole.mapInArrow(extract, schema), "labelled-features")
    sizes = sorted((row["draw"], row["doc_id"], row["size"]) for row in extracted.select("draw", "doc_id", "size").collect())
    kept = within([(number, size) for _, number, size in sizes], most_features)
    fitting = docs.sparkSession.createDataFrame([(number,) for number in kept], "doc_id long")  # `sample` rows at most
    found = extracted.join(F.broadcast(fitting), "doc_id").select("doc_id", "label", "features").toArrow().sort_by("doc_id")
    lists = found.column("features").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit(rows, found.column("label").to_numpy() == 1)


def score(text: Column, model: Model) -> Column:
    """The probability, 0 to 1, that a text is of the positive class; a null text counts as empty."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return of(text)

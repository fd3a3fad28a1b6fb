"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import lean, ship, without
from tessella.llm.hashing import TOKENS, collect_features, pair_hashes, sample, token_hashes

#: Weights, as a power of two.
WIDTH = 18
#: Labelled documents to learn from at most.
SAMPLE_ROWS = 6000


def features(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: counts of hashed words and word pairs, damped, at length one."""
    h = token_hashes(TOKENS.findall(text))
    x = np.concatenate([h, pair_hashes(h)]) >> np.uint64(64 - width) if len(h) else h
    index, count = np.unique(x.astype(np.int64), return_counts=True)
    value = np.log1p(count)
    return index, value / max(1e-12, float(np.sqrt(value @ value)))


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with a bias."""

    def __init__(self, width: int = WIDTH, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros(1 + (1 << width)), np.zeros(1 + (1 << width))
        self.alpha, self.beta, self.l1, self.l2, self.width = alpha, beta, l1, l2, width

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        at, v = np.append(index, 1 << self.width), np.append(value, 1.0)
        w = self.weights(at)
        g = (_sigmoid(float(w @ v)) - y) * v
        new = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = new


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights learned from at most `most` labelled documents; the last one is the bias. Without any, all are zero."""
    rows = collect_features(sample(docs, labels, label, most, key, text), features, key)
    model, order = FTRL(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            y, x, v = rows[i]
            model.learn(x, v, y)
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 (double). Null and empty texts get the bias alone. A clashing column is replaced."""
    docs = without(docs, out)
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(weights)  # of a fixed width
    schema, at = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)

        def one(t: bytes | None) -> float:
            x, v = features(t or b"")
            return _sigmoid(float(w[x] @ v + w[-1]))

        for b in batches:
            made = pa.array([one(t) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return docs.mapInArrow(lean(run), schema)

"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled text is a sample of all documents.  The
class prior of the unlabelled text is estimated from a positive-against-unlabelled classifier: the
least ratio of the two score tails.  The classifier itself minimises the non-negative unbiased
risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  over shares of character-class pairs,
repetition and word statistics of the whole text.

Bounds: ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents train it; scoring reads all rows.

Cases: a null text is empty; empty texts get the score of all-zero shares; a text of any length counts
whole; repeated rows and extra columns stay; of sampled rows with one id, the text of the least hash trains; without any positive every score is the prior 0.5; with fewer than 20
positives or 20 unlabelled documents the prior isn't estimated but taken as 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.labelled import fold, sampled, texts_of
from factloom.llm.shared import by_bytes, only

SAMPLE = 6_000
THRESHOLD = 0.3
#: The tail ratio errs upwards, and each excess turns rejects into good ones: it is taken a little lower.
SHADE = 0.98
#: Characters of one class behave alike; each byte has one.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,", b";:?'\"()-", b"!", b"|", b"*&%$#", bytes(range(0x80, 0x100))]
_N = len(_GROUPS) + 1
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _i
FEATURES = _N * _N + 6


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of class pairs, then repetition and word statistics."""
    text = text or ""
    out = np.zeros(FEATURES, np.float32)
    data = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    if len(data) > 1:
        pairs = np.bincount(data[:-1] * np.uint8(_N) + data[1:], minlength=_N * _N)
        out[: _N * _N] = np.sqrt(pairs / (len(data) - 1))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    out[_N * _N :] = (
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        min(20.0, len(text) / n) / 20,
        np.log1p(len(words)) / 10,
        len(set(lines)) / len(lines),
        min(100.0, n / len(lines)) / 100,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _batches(p: np.ndarray, u: np.ndarray, epochs: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rng, size = np.random.default_rng(seed), 256
    steps = max(1, len(u) // size)
    for _ in range(epochs * steps):
        yield p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]


def _tail_ratio(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    """The least ratio of held-out score tails, for one random split in halves."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    half_p, half_u = max(1, len(p) // 2), max(1, len(u) // 2)
    w, adam = np.zeros(p.shape[1]), _Adam(p.shape[1], 0.02)
    for a, b in _batches(p[:half_p], u[:half_u], 20, seed):
        w += adam.step(-a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 1e-4 * w)
    of_p, of_u = np.sort(p[min(half_p, len(p) - 1) :] @ w), np.sort(u[min(half_u, len(u) - 1) :] @ w)  # a single row serves both ends
    cuts = np.quantile(of_p, np.linspace(0.01, 0.9, 90))
    tail_p = 1 - np.searchsorted(of_p, cuts) / len(of_p)
    tail_u = 1 - np.searchsorted(of_u, cuts) / len(of_u)
    noise = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(of_u)) + 1 / np.sqrt(len(of_p)))
    best = int(np.argmin((tail_u + noise) / np.maximum(tail_p, 1e-9)))
    return float(tail_u[best] / tail_p[best])


def estimate_prior(p: np.ndarray, u: np.ndarray, splits: int = 7) -> float:
    """Share of positives in ``u``: the median over random splits of the least ratio of score tails."""
    return float(np.clip(np.median([_tail_ratio(p, u, seed) for seed in range(splits)]), 0.01, 0.99))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        if not texts:
            return np.zeros(0)
        return _sigmoid(self.design(np.stack([features(t) for t in texts])) @ self.weights)


def train(p: np.ndarray, u: np.ndarray, steps: int = 500) -> Model:
    """Non-negative positive-unlabelled learning of a logistic model on feature rows, all rows in each step."""
    if not len(p) or not len(u):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.5)
    model = Model(u.mean(axis=0), u.std(axis=0) + 0.02, np.zeros(0), 0.5)
    p, u = model.design(p), model.design(u)
    prior = SHADE * estimate_prior(p, u)
    w, adam = np.zeros(p.shape[1]), _Adam(p.shape[1], 0.02)
    for _ in range(steps):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = prior * np.log1p(-np.clip(sp, 0, 1 - 1e-12)).mean() - np.log1p(-np.clip(su, 0, 1 - 1e-12)).mean()
        rest = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative >= 0:
            gradient = rest - prior * (p.T @ (1 - sp)) / len(p)
        else:  # the unbiased risk has gone below zero: step back from that fit
            gradient = -rest
        w += adam.step(gradient + 1e-4 * w)
    model.weights, model.prior = w, prior
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` documents labelled good and ``sample`` of all, none of them held out."""
    positives = labels.where((F.col("quality") == 1) & (fold() != 0))
    ids = sampled(positives, sample).withColumn("good", F.lit(True)).unionByName(sampled(docs.where(fold() != 0), sample).withColumn("good", F.lit(False)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in by_bytes(batches, 1):
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["good", "x"])

    found = texts_of(docs, ids).select("good", "text").mapInArrow(rows, "good boolean, x array<float>").toArrow()  # at most 2 * sample rows
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)
    good = found["good"].to_numpy().astype(bool)
    # The rows' order depends on the cluster; the fit must not.
    p, u = (part[np.lexsort(part.T)] if len(part) else part for part in (x[good], x[~good]))
    rng = np.random.default_rng(11)
    return train(p[rng.permutation(len(p))], u[rng.permutation(len(u))])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("quality")
        for texts in batches:
            yield pa.concat_arrays([pa.array(shared.value.scores(part.to_pylist())) for part in by_bytes([texts])] or [pa.array([], pa.float64())])

    return docs.withColumn(name, score(F.col(text_col)))

"""Quality classifier by positive-unlabelled learning with the non-negative risk.

The score is a small network over shape features of the whole text. It minimises prior * E_p[l(g)] + max(0, E_u[l(-g)] -
prior * E_p[l(-g)]) with the logistic loss l, from trusted positives and unlabelled web text; labels of negatives take no
part in it. Nor do they in the class prior, which is a mixture proportion: a network that tells positives from unlabelled rows
is fitted on one half of both, and on the other half the prior is the least ratio of the shares of unlabelled rows and of
positives above a threshold, where both are known well enough (``class_prior``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import steps, text_bytes
from quern.llm.sampling import held_out, rows_of, smallest

#: Rows of each kind that the fit samples at most, those with the smallest hash of their id.
SAMPLE_ROWS = 4_000
SHAPES, HIDDEN = 128, 24

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c == 32 or 9 <= c <= 13 and c != 10 else c for c in range(256))
_RUN = re.compile(rb"([^\n ])\1+")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FIRST = 14


def features(text: bytes) -> np.ndarray:
    """Statistics of the whole text and the shares of its word shapes, hashed; zeros for a text without words."""
    out = np.zeros(_FIRST + SHAPES, np.float32)
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return out
    shaped = text.translate(_SHAPE)
    upper = shaped.count(b"A")
    letters = upper + shaped.count(b"a")
    counts = Counter(words)
    lines = text.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[:_FIRST] = (
        1.0,
        math.log1p(n) / 5,
        upper / max(1, letters),
        letters / size,
        shaped.count(b"0") / size,
        len(counts) / n,
        math.log(len(counts)) / math.log1p(n),
        max(counts.values()) / n,
        repeats / n,
        letters / n / 8,
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / size,
        math.log1p(len(lines)) / math.log1p(n),
        n / size * 5,
    )
    shapes = Counter(_RUN.sub(rb"\1", shaped).split())
    for shape, times in shapes.items():
        out[_FIRST + zlib.crc32(shape) % SHAPES] += times / n
    return out


@dataclass
class Model:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of quality 1."""
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, (x - self.mean) / self.scale)[1], -30, 30)))


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + x @ weights[3] + weights[4]


def _gradient(weights: list[np.ndarray], x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    """Of the sum of slope * g over the rows."""
    hidden, _ = _forward(weights, x)
    back = slope[:, None] * weights[2] * (1 - hidden**2)
    return [x.T @ back, back.sum(0), hidden.T @ slope, x.T @ slope, slope.sum()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk of positives and unlabelled rows, and the direction that a step goes against.

    Where the estimate of the negatives' risk turns negative, that is its gradient's opposite, which undoes the overfit.
    """
    gp, gu = _forward(weights, p)[1], _forward(weights, u)[1]
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    value = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
    down = _gradient(weights, u, _sigmoid(gu) / len(u)), _gradient(weights, p, -prior * _sigmoid(gp) / len(p))
    if negative < 0:
        return value, [-(a + b) for a, b in zip(*down, strict=True)]
    up = _gradient(weights, p, -prior * _sigmoid(-gp) / len(p))
    return value, [a + b + c for a, b, c in zip(*down, up, strict=True)]


def contrast(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Logistic loss of telling positives from unlabelled rows, and its gradient."""
    gp, gu = _forward(weights, p)[1], _forward(weights, u)[1]
    parts = _gradient(weights, u, _sigmoid(gu) / len(u)), _gradient(weights, p, -_sigmoid(-gp) / len(p))
    return np.logaddexp(0, gu).mean() + np.logaddexp(0, -gp).mean(), [a + b for a, b in zip(*parts, strict=True)]


Loss = Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple[float, list[np.ndarray]]]


def minimise(loss: Loss, positive: np.ndarray, unlabelled: np.ndarray, *, rounds: int, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """A network that minimises ``loss`` by Adam over paired batches."""
    width = positive.shape[1]
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.where(scale > 1e-6, scale, 1).astype(np.float32)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / math.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(width), np.float64(0)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    size = min(batch, len(p), len(u))
    t, total = 0, rounds * max(1, len(u) // size)
    while t < total:
        for rows in np.array_split(rng.permutation(len(u)), max(1, len(u) // size)):
            t += 1
            _, grads = loss(weights, p[rng.integers(0, len(p), size)], u[rows])
            step = rate * (1 - t / (total + 1)) / (1 - 0.9**t) * math.sqrt(1 - 0.999**t)
            for i, g in enumerate(grads):
                g = g + decay * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - step * first[i] / (np.sqrt(second[i]) + 1e-8)
            if t >= total:
                break
    return Model(mean.astype(np.float32), scale, weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, *, rounds: int = 20) -> float:
    """The share of positives among unlabelled rows, from positives and unlabelled rows alone.

    Above any threshold of any score the unlabelled rows hold at least ``prior`` times the positives' share, and just that
    much where no negatives are. The threshold is the one whose ratio has the least upper bound (Hoeffding, at 95 %). Rows
    alternate between fitting the score and counting. 0.5 if there are under two rows of a kind.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = minimise(contrast, positive[::2], unlabelled[::2], rounds=rounds)
    p, u = np.sort(model(positive[1::2])), np.sort(model(unlabelled[1::2]))
    above = lambda own: 1 - np.searchsorted(own, p, "left") / len(own)
    slack = sum(math.sqrt(math.log(4 / 0.05) / (2 * len(x))) for x in (p, u))
    share_p, share_u = above(p), above(u)
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, rounds: int = 40, **options) -> Model:
    """Minimises the non-negative risk. With no positives or nothing unlabelled the score is the prior everywhere."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        odds = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(width), np.float64(odds)])
    return minimise(lambda w, p, u: risk(w, p, u, prior), positive, unlabelled, rounds=rounds, **options)


def sampled_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Feature rows of a bounded sample of documents, in order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [features(x).tobytes() for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "row"])

    kind = dict(docs.dtypes)["doc_id"]
    got = sorted((r["doc_id"], bytes(r["row"])) for r in rows_of(docs, ids).mapInArrow(run, f"doc_id {kind}, row binary").collect())
    return np.array([np.frombuffer(x, np.float32) for _, x in got], np.float32).reshape(-1, _FIRST + SHAPES)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` trusted positives and as many unlabelled documents, none of them held out.

    Rows with label 0 are not looked at, nor are null labels and ids. More rows than the bound change the fit little: the
    network has some thousand weights.
    """
    known = labels.select("doc_id", F.col(label_col).alias("label")).where("label = 1 and doc_id is not null")
    positive = sampled_features(docs, smallest(known.select("doc_id"), sample_rows))
    unlabelled = sampled_features(docs, smallest(docs.select("doc_id"), sample_rows))
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    rows = [features(x) for x in text_bytes(batch)]
    return model(np.array(rows, np.float32)).astype(np.float64)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null and empty texts share one score; repeated rows and null ids get theirs; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield batch.filter(pa.array(_scores(shared.value, batch) >= threshold))

    return docs.mapInArrow(run, docs.schema)

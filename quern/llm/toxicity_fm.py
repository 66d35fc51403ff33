"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of the whole text and their beginnings, hashed into SLOTS slots. On the sample, slots
that tell nothing of the label are left out: neither alone (chi-square below LEAST_CHI2) nor in a pair, whose chi-square must
exceed those of its members by LEAST_PAIR_CHI2. The rest get a weight and a vector of FACTORS numbers each. The score is the logistic of bias + sum of weights + sum over pairs of the vectors'
products, so that pairs such as an insult and a mention of a group count beyond their words.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_worker, steps, text_bytes
from quern.llm.sampling import held_out, rows_of, smallest

#: Labelled rows that the fit takes at most, those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
SLOTS, FACTORS, STEM = 1 << 20, 8, 5
#: Presence and label are independent beyond chance above this chi-square (one degree of freedom); rows a slot needs.
LEAST_CHI2, LEAST_ROWS = 12.0, 3
#: The same of a pair beyond its members, where millions of pairs are tried, and the most frequent slots that are paired.
LEAST_PAIR_CHI2, PAIRED = 40.0, 2048
#: Words that a worker remembers the slots of.
MOST_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: bytes) -> set[str]:
    """Distinct words of a text, lower-cased."""
    return set(_WORD.findall(text.decode().lower()))


def slots_of(word: str) -> tuple[int, ...]:
    """The slots of a word and, if it is longer, of its beginning."""
    own = zlib.crc32(word.encode()) % SLOTS
    return (own, zlib.crc32(b"^" + word[:STEM].encode()) % SLOTS) if len(word) > STEM else (own,)


@dataclass
class Model:
    """``slots`` (sorted) have rows in ``weights`` and ``vectors``."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def __call__(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities of label 1 from the slot rows present in each text."""
        out = np.empty(len(rows))
        for i, own in enumerate(rows):
            v = self.vectors[own]
            out[i] = self.bias + self.weights[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def chi_square(seen: np.ndarray, hits: np.ndarray, n: int, good: int) -> np.ndarray:
    """Of presence in ``seen`` rows, ``hits`` of them with label 1, against the label of n rows, ``good`` of them with 1."""
    seen = seen.astype(float)
    spread = seen * (n - seen) * good * (n - good) / n
    return np.divide((hits * float(n) - seen * good) ** 2, spread, out=np.zeros(seen.shape), where=spread > 0)


def chosen_slots(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Slots whose presence tells about the label, alone or together with that of another slot."""
    n, good = len(rows), int(label.sum())
    if not n or not 0 < good < n:
        return np.empty(0, np.int64)
    every = np.concatenate(rows)
    seen = np.bincount(every, minlength=SLOTS)
    alone = chi_square(seen, np.bincount(every, np.repeat(label.astype(float), [len(x) for x in rows]), minlength=SLOTS), n, good)
    kept = (alone >= LEAST_CHI2) & (seen >= LEAST_ROWS)
    often = np.argsort(-seen, kind="stable")[:PAIRED]
    often = np.sort(often[(seen[often] >= LEAST_ROWS) & (seen[often] < n)])
    held = np.zeros((n, len(often)), np.float32)
    for own, x in zip(held, rows, strict=True):
        own[np.isin(often, x, assume_unique=True)] = 1
    both, hits = held.T @ held, held[label == 1].T @ held[label == 1]
    gain = chi_square(both, hits, n, good) - alone[often] - alone[often][:, None]
    kept[often[((gain >= LEAST_PAIR_CHI2) & (both >= LEAST_ROWS)).any(1)]] = True
    return np.flatnonzero(kept)


def fit(rows: list[np.ndarray], label: np.ndarray, *, rounds: int = 100, rate: float = 0.05, decay: float = 2e-4, seed: int = 3) -> Model:
    """Logistic loss over all sampled rows, by Adam. Without rows of both labels every score is the share of label 1."""
    slots = chosen_slots(rows, label)
    share = (label.sum() + 0.5) / (len(label) + 1)
    bias = math.log(share / (1 - share))
    weights = np.zeros(len(slots))
    vectors = np.random.default_rng(seed).normal(0, 0.02, (len(slots), FACTORS))
    if not len(slots):
        return Model(slots, bias, weights, vectors)
    at = [np.flatnonzero(np.isin(slots, x, assume_unique=True)) for x in rows]
    sizes = np.array([len(x) for x in at])
    order = np.concatenate(at)
    owner = np.repeat(np.arange(len(rows)), sizes)
    by_slot = np.argsort(order, kind="stable")
    slot_first = np.flatnonzero(np.r_[True, np.diff(order[by_slot]) > 0])
    slot_ids = order[by_slot][slot_first]
    full = np.flatnonzero(sizes)
    row_first = (np.cumsum(sizes) - sizes)[full]

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), *values.shape[1:]))
        out[full] = np.add.reduceat(values, row_first, axis=0)
        return out

    def by_slots(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slots), *values.shape[1:]))
        out[slot_ids] = np.add.reduceat(values[by_slot], slot_first, axis=0)
        return out

    params = [np.array([bias]), weights, vectors]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, rounds + 1):
        bias, weights, vectors = params
        own = vectors[order]
        total = by_row(own)
        g = bias[0] + by_row(weights[order]) + 0.5 * ((total**2).sum(1) - by_row((own**2).sum(1)))
        slope = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - label) / len(rows)
        each = slope[owner]
        grads = [np.array([slope.sum()]), by_slots(each) + decay * weights, by_slots(each[:, None] * (total[owner] - own)) + decay * vectors]
        for i, x in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * x
            second[i] = 0.999 * second[i] + 0.001 * x * x
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model(slots, float(params[0][0]), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled documents that aren't held out. Null labels and ids are not learned from.

    A document with several labels counts as 1 if any of them is.
    """
    known = labels.select("doc_id", F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    ids = smallest(known.select("doc_id"), sample_rows)
    label = {r["doc_id"]: r["label"] for r in known.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("label").alias("label")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [np.unique(np.array([s for w in terms(x) for s in slots_of(w)], np.int32)).tobytes() for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "row"])

    kind = dict(docs.dtypes)["doc_id"]
    got = sorted((r["doc_id"], bytes(r["row"])) for r in rows_of(docs, ids).mapInArrow(run, f"doc_id {kind}, row binary").collect())
    return fit([np.frombuffer(x, np.int32) for _, x in got], np.array([label[i] == 1 for i, _ in got], float))


class Scorer:
    """A model with a bounded memory of words and the model's rows for their slots."""

    def __init__(self, model: Model):
        self.model = model
        self.row_of = {int(s): n for n, s in enumerate(model.slots)}
        self.words: dict[str, tuple[int, ...]] = {}

    def rows(self, text: bytes) -> list[int]:
        words, found = self.words, set()
        if len(words) > MOST_WORDS:
            words.clear()
        for w in terms(text):
            hit = words.get(w)
            if hit is None:
                hit = words[w] = tuple(self.row_of[s] for s in slots_of(w) if s in self.row_of)
            found.update(hit)
        return sorted(found)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null and empty texts have no terms and share the bias's score; repeated rows and null ids get theirs; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SLOTS

    def run(batches: Iterator[pa.RecordBatch], key: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(key, lambda: Scorer(shared.value))
        for batch in steps(batches, keep=key):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.model([scorer.rows(x) for x in text_bytes(batch)]))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""LM scoring by online logistic context mixing.

A text is its words, lower-cased (A-Z), and an end. Its probability is the product over binary decisions, three kinds of them:

    again     where the word before stood earlier in the text: is this word the one that followed it there?
    frequent  if not: is it one of the frequent words? These have exact counts, by cluster of the text so far
    spelling  if neither: the bits of its bytes and a blank, in a Huffman code of bytes; its probability is joined with exact
              counts of all rare words by absolute discounting, from the cluster to the corpus to the spelling

Every decision is predicted by several hashed contexts: the words before and the word that is expected (so contexts cross
words), the outcomes so far, what share of decisions fell which way in this text (learned as the text goes on), and for bits
the last 2, 3, 4 and 6 bytes in the cluster. Each predictor gives log-odds from how often its slot saw a zero and a one. They are
combined by weights that a gate picks, and refined by an adaptive table of the outcome by gate and estimate.

Training meets all tokens of all training documents. Counts of all words by cluster are added up by shuffle, stay distributed and
grow with the corpus. Contexts of again and frequent are learned online in each task, one mini-batch after the other: predict,
adjust weights and refinement, then count. Tables are added over the tasks, weights averaged by how often each gate was met.
Spelling is learned from all distinct words, each in its likeliest cluster and judged without its own counts. The cluster of the text so far
is the likeliest by its words before; the words that tell clusters apart are those most frequent in all training documents, and
clusters are fitted by expectation-maximisation over all of these, one pass of Spark for each round.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, bucket_of, give_back, per_worker, steps, text_bytes, written_by_workers

#: Rows whose bucket is this one of so many are held out of training.
BUCKETS, HELD_OUT = 5, 1
#: Words that count as frequent: at most so many, held by each worker, and met so often. All others are joined.
TOP, LEAST = 1 << 19, 4
#: Words that tell clusters apart, and clusters.
MARKERS, CLUSTERS = 2048, 6
#: Bits of the table sizes of spelling contexts and of word contexts, at every size of corpus.
SPELL_BITS, WORD_BITS = 22, 18
#: Words of a cluster's counts that are drawn from the corpus' shares.
SMOOTH = 2000.0
#: Bytes of tokens that are spelled at a time, and counted; bytes of text in one step; decisions learned from at a time.
CHUNK_BYTES, COUNT_BYTES, STEP, BATCH = 1 << 14, 1 << 14, 1 << 20, 1 << 16
#: Rows of counts that a task holds before it hands them on.
MOST_COUNTS = 1 << 20
#: Ranges in which partial tables are added up.
RANGES = 32

_ORDERS = (2, 3, 4, 6)
_EDGES = np.array([1, 2, 4, 16, 256])
_LEVELS = len(_EDGES) + 1
_BINS, _REACH = 33, 8.0
_U = np.uint64
_WHITE = np.isin(np.arange(256), [*range(9, 14), 32])


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, BUCKETS) == HELD_OUT


def tokens_of(text: bytes) -> list[bytes]:
    """Words and the end, which is the empty token."""
    words = text.translate(LOWER).split()
    words.append(b"")
    return words


@dataclass
class Tokens:
    """The tokens of some texts one after the other, numbered by their distinct names."""

    at: np.ndarray
    names: pa.Array
    sizes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def hashes(self) -> np.ndarray:
        """64 bits of each name."""
        names = self.names.to_numpy(zero_copy_only=False).tolist()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, names), _U, len(names))


def tokenise(texts: list[bytes]) -> Tokens:
    """The same tokens as ``tokens_of``, cut without a Python object for each."""
    text = b" ".join([*texts, b""]).translate(LOWER)  # a blank after each text
    data = np.frombuffer(text, np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stops = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(ends, starts, "right")
    lengths = np.zeros(len(starts) + len(texts), np.int64)
    lengths[np.arange(len(starts)) + owner] = stops - starts
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    met = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[~white].tobytes())]).dictionary_encode()
    return Tokens(met.indices.to_numpy(), met.dictionary, np.bincount(owner, minlength=len(texts)) + 1)


# Mixing: log-odds of several predictors, weights by gate, refinement.


def log_odds(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float32) + np.float32(0.4)
    return np.log(counts[..., 1] / counts[..., 0])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + _REACH) * (_BINS - 1) / (2 * _REACH)), 0, _BINS - 1).astype(np.int64)


def mix(weights: np.ndarray, odds: np.ndarray, gates: np.ndarray) -> np.ndarray:
    """Log-odds combined by the weights of each gate; the last weight is a bias."""
    *each, bias = np.ascontiguousarray(weights.T)
    x = bias.take(gates)
    for own, row in zip(each, odds, strict=True):
        x += own.take(gates) * row
    return np.clip(x, -_REACH * 1.4, _REACH * 1.4)


@dataclass
class Mixer:
    weights: np.ndarray
    refine: np.ndarray

    def __call__(self, odds: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Probability of a one: the mix, averaged with the refined value of its bin."""
        x = mix(self.weights, odds, gates)
        return 0.5 * (_squash(x) + self.refine.ravel().take(gates * _BINS + _bin(x)))


class Learner:
    """Weights by Adam, one mini-batch after the other, and what refinement needs."""

    def __init__(self, start: np.ndarray, rate: float = 0.02):
        self.rate, self.t = rate, 0
        self.weights = start.astype(np.float64)
        self.first, self.second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.mass = np.zeros(len(start))
        self.seen, self.ones = np.zeros((2, len(start) * _BINS))

    def note(self, odds: np.ndarray, gates: np.ndarray, bit: np.ndarray) -> np.ndarray:
        x = mix(self.weights, odds, gates)
        cell = gates * _BINS + _bin(x)
        self.seen += np.bincount(cell, minlength=len(self.seen))
        self.ones += np.bincount(cell, bit, minlength=len(self.seen))
        self.mass += np.bincount(gates, minlength=len(self.mass))
        return x

    def step(self, odds: np.ndarray, gates: np.ndarray, bit: np.ndarray, x: np.ndarray | None = None) -> None:
        self.t += 1
        slope = _squash(mix(self.weights, odds, gates) if x is None else x) - bit
        change = np.stack([np.bincount(gates, slope * row, minlength=len(self.mass)) for row in (*odds, 1)], 1) / len(gates)
        self.first, self.second = 0.9 * self.first + 0.1 * change, 0.999 * self.second + 0.001 * change**2
        rate = self.rate / (1 + 2 * self.t / 1000)
        self.weights -= rate * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-7)

    def vectors(self) -> list[np.ndarray]:
        """What is added up over learners."""
        return [(self.weights * self.mass[:, None]).ravel(), self.mass, self.seen, self.ones]


def joined(start: np.ndarray, sums: list[np.ndarray] | None) -> Mixer:
    """The mixer of all learners from the sums of their vectors: weights averaged by how often each gate was met."""
    weights, refine = start.astype(np.float64), np.tile(_squash(np.linspace(-_REACH, _REACH, _BINS)), (len(start), 1))
    if sums is not None:
        own, mass, seen, ones = sums
        met = mass > 0
        weights[met] = own.reshape(start.shape)[met] / mass[met][:, None]
        refine = (ones.reshape(refine.shape) + 20 * refine) / (seen.reshape(refine.shape) + 20)
    return Mixer(weights.astype(np.float32), np.clip(refine, 1e-5, 1 - 1e-5).astype(np.float32))


def summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the arrays ``vector`` by ``name`` over all tasks; they have a few thousand places in all."""
    rows = parts.where("vector is not null").select("name", F.posexplode("vector")).groupBy("name", "pos").agg(F.sum("col").alias("x")).collect()
    out = {name: np.zeros(1 + max(r["pos"] for r in rows if r["name"] == name)) for name in {r["name"] for r in rows}}
    for r in rows:
        out[r["name"]][r["pos"]] = r["x"]
    return out


def sums_of(found: dict[str, np.ndarray], name: str) -> list[np.ndarray] | None:
    return [found[f"{name}{i}"] for i in range(4)] if f"{name}0" in found else None


# Spelling: bits of bytes.


def code_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and bits of every byte value in a canonical Huffman code; no value is rarer than one in some thousand."""
    total = int(counts.sum())
    heap = [(int(c) + 1 + (total >> 12), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    length = np.zeros(256, np.int64)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        length[[*x, *y]] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    bits, code, last = np.zeros(256, np.int64), 0, 0
    for value in sorted(range(256), key=lambda v: (length[v], v)):
        code <<= int(length[value]) - last
        bits[value], last, code = code, int(length[value]), code + 1
    return length, bits


@dataclass
class Paths:
    """Bytes of tokens one after the other, each with its blank, and the contexts of every byte."""

    data: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    orders: list[np.ndarray]


def paths(tokens: list[bytes], cluster: np.ndarray) -> Paths:
    data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(data)) - begin[owner]
    mark = (cluster[owner].astype(_U) + _U(1)) * _U(0xA0761D6478BD642F)
    orders, context = [], np.zeros(len(data), _U)
    for k in range(1, max(_ORDERS) + 1):  # bytes before the word's first count as blanks
        before = np.full(len(data), 32, _U)
        before[k:] = data[:-k] if k < len(data) else before[k:]
        before[place < k] = 32
        context = context | before << _U(8 * (k - 1))
        if k in _ORDERS:
            h = (context * _U(0x9E3779B97F4A7C15) + _U(k) ^ mark) * _U(0x94D049BB133111EB)
            orders.append(h ^ h >> _U(29))
    return Paths(data, owner, begin, orders)


def bit_slots(p: Paths, code: tuple[np.ndarray, np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """For the first, second, ... bit of the bytes that have one: which bytes, its slot in every context's table, the bit.

    A slot depends on the context and on the bits of the byte that are known so far, with a leading one.
    """
    length, value = code[0][p.data], code[1][p.data]
    own, contexts = np.arange(len(length)), list(p.orders)
    for j in range(int(length.max(initial=0))):
        kept = np.flatnonzero(length > j)
        if len(kept) < len(own):
            own, length, value, contexts = own.take(kept), length.take(kept), value.take(kept), [x.take(kept) for x in contexts]
        left = length - j
        partial = ((1 << j) | value >> left).astype(_U) * _U(0xD6E8FEB86659FD93)
        yield own, [(((x ^ partial) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - bits)).view(np.int64) for x in contexts], value >> (left - 1) & 1


def chunks(tokens: list[bytes], most: int) -> Iterator[slice]:
    """Slices of the tokens with at most ``most`` bytes each, or one token."""
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    start = 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def count_spelling(tokens: list[bytes], cluster: np.ndarray, code: tuple[np.ndarray, np.ndarray], tables: np.ndarray, bits: int) -> None:
    """Adds the bits of words of clusters to the tables (orders x slots x 2) of their contexts."""
    for part in chunks(tokens, COUNT_BYTES):
        for _, at, bit in bit_slots(paths(tokens[part], cluster[part]), code, bits):
            for x, table in zip(at, tables, strict=True):
                np.add.at(table.reshape(-1), x * 2 + bit, table.dtype.type(1))


_LEVEL_OF = np.searchsorted(_EDGES, np.arange(_EDGES[-1] + 1), "right").astype(np.uint8)


def levels(counts: np.ndarray) -> np.ndarray:
    """How often a slot was seen, from never to very often."""
    return _LEVEL_OF[np.minimum(counts[..., 0].astype(np.int64) + counts[..., 1], _EDGES[-1])]


def narrow(counts: np.ndarray) -> np.ndarray:
    """Rows of (zeros, ones) in 16 bits; larger ones are halved until they fit, which keeps their odds."""
    most = counts.max(1, keepdims=True) if len(counts) else counts[:, :1]
    shift = np.maximum(0, np.ceil(np.log2((most + 1.0) / 65536))).astype(np.uint32)
    return (counts >> shift).astype(np.uint16)


#: Steps of log-odds that a packed table tells apart in one, and the log-odds of its cells.
_STEPS = np.float32(8)
_ODDS_OF = (np.arange(256, dtype=np.float32) - 128) / _STEPS


def packed(counts: np.ndarray) -> np.ndarray:
    """Log-odds in eight bits, and above them how often the slot was seen."""
    odds = np.clip(np.rint(log_odds(counts) * _STEPS), -127, 127).astype(np.int16) + 128
    return (levels(counts).astype(np.uint16) << 8) | odds.astype(np.uint16)


def spell_start() -> np.ndarray:
    return np.tile(np.array([0.1, 0.2, 0.4, 0.3, 0], np.float32), (_LEVELS**2, 1))


def learn_spelling(learner: Learner, tables: np.ndarray, bits: int, code: tuple[np.ndarray, np.ndarray], tokens: list[bytes], cluster: np.ndarray) -> None:
    """Bits of words that the tables counted once each, judged without their own counts; in the order of the words."""
    for part in chunks(tokens, CHUNK_BYTES):
        for _, at, bit in bit_slots(paths(tokens[part], cluster[part]), code, bits):
            odds, total = np.empty((len(at), len(bit)), np.float32), None
            for row, x, table in zip(odds, at, tables, strict=True):
                zeros, ones = (table.reshape(-1).take(2 * x + i).astype(np.float32) for i in (0, 1))
                zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
                np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), out=row)
                total, before = zeros + ones, total
            rank = [_LEVEL_OF.take(np.minimum(x, _EDGES[-1]).astype(np.int64)).astype(np.int64) for x in (before, total)]
            gates = rank[0] * _LEVELS + rank[1]
            learner.step(odds, gates, bit, learner.note(odds, gates, bit))


@dataclass
class Spelling:
    bits: int
    tables: np.ndarray  # packed, orders x slots
    code: tuple[np.ndarray, np.ndarray]
    mixer: Mixer

    def log_prob(self, tokens: list[bytes], cluster: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's bytes and blank in its cluster."""
        out = np.empty(len(tokens))
        for part in chunks(tokens, CHUNK_BYTES):
            p = paths(tokens[part], cluster[part])
            total = np.ones(len(p.data))  # of a byte's bits: over 1e-80
            for own, at, bit in bit_slots(p, self.code, self.bits):
                cells = [table.take(x) for table, x in zip(self.tables, at, strict=True)]
                gates = (cells[-2] >> 8) * np.uint16(_LEVELS) + (cells[-1] >> 8)
                one = self.mixer([_ODDS_OF.take(x & 255) for x in cells], gates.astype(np.int64))
                total[own] *= np.where(bit == 1, one, 1 - one)
            out[part] = np.add.reduceat(np.log(total), p.begin)
        return out


# Clusters of texts.


@dataclass
class Clusters:
    """A mixture over texts by their marker words."""

    markers: np.ndarray  # hashes, sorted
    prior: np.ndarray
    evidence: np.ndarray  # (markers + 1) x clusters, log-probabilities; the last row is no evidence

    def __post_init__(self) -> None:
        # multiples of 2**-20: sums are exact, so ties fall alike whatever texts are summed before
        self.prior, self.evidence = np.rint(self.prior * 2.0**20) / 2**20, np.rint(self.evidence * 2.0**20) / 2**20

    def marker(self, hashes: np.ndarray) -> np.ndarray:
        return place_in(self.markers, hashes, len(self.markers))

    def walk(self, marker: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cluster before each token, from the tokens of the same text before it."""
        first, best, out = np.cumsum(sizes) - sizes, None, np.zeros(len(marker), np.int64)
        for k, (own, prior) in enumerate(zip(np.ascontiguousarray(self.evidence.T), self.prior, strict=True)):
            found = own.take(marker)
            upto = np.cumsum(found)
            upto -= found
            upto -= np.repeat(upto.take(first) - prior, sizes)
            if best is None:
                best = upto
            else:
                out[upto > best] = k
                np.maximum(best, upto, out=best)
        return out

    def of_texts(self, marker: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The cluster of each whole text."""
        return (np.add.reduceat(self.evidence[marker], np.cumsum(sizes) - sizes, axis=0) + self.prior).argmax(1)

    def fitted(self, counts: np.ndarray, words: np.ndarray) -> Clusters:
        """The same clusters from counts of markers in each, and of all words in each."""
        logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(counts))))
        logs -= logs.max(1, keepdims=True) if len(logs) else 0
        return Clusters(self.markers, np.log((words + 1) / (words.sum() + len(words))), np.vstack((logs, np.zeros((1, len(words))))))


def place_in(known: np.ndarray, hashes: np.ndarray, none: int = -1) -> np.ndarray:
    """Places of hashes among sorted known ones."""
    if not len(known):
        return np.full(len(hashes), none, np.int64)
    order = np.argsort(hashes)  # in order, the search stays in cache
    own = hashes[order]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.where(known[at] == own, at, none)
    return out


@dataclass
class Marked:
    """The markers of some texts: how many kinds each text has, and of each its place and the log of 1 + its count."""

    sizes: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, marker: np.ndarray, sizes: np.ndarray, markers: int) -> Marked:
        """From the marker of each token, ``markers`` for none."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        cell, n = np.unique((owner * (markers + 1) + marker)[marker < markers], return_counts=True)
        return cls(np.bincount(cell // (markers + 1), minlength=len(sizes)), cell % (markers + 1), np.log1p(n))

    def scores(self, weights: np.ndarray, unit: bool) -> np.ndarray:
        """Products of each text with the columns of ``weights``; ``unit``: of the text at length one."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = np.zeros((len(self.sizes), weights.shape[1]))
        for k, own in enumerate(np.ascontiguousarray(weights.T)):
            out[:, k] = np.bincount(owner, self.x * own.take(self.at), minlength=len(out))
        return out / np.maximum(1e-6, np.sqrt(np.bincount(owner, self.x**2, minlength=len(out))))[:, None] if unit else out


def farthest(parts: Iterable[Marked], seeds: np.ndarray, least: float) -> tuple[float, list[int], list[float]] | None:
    """The text least like any of ``seeds`` (columns of length one), of those with logs of ``least`` or more in all: how
    far, its markers, its logs. Without seeds the text with most. Any text of a word or two would be far."""
    best = None
    for p in parts:
        far = much = np.bincount(np.repeat(np.arange(len(p.sizes)), p.sizes), p.x, minlength=len(p.sizes))
        if seeds.shape[1]:
            far = np.where(much >= least, -p.scores(seeds, True).max(1), -2.0)
        ends = np.cumsum(p.sizes)
        for i in np.flatnonzero(far == far.max(initial=-3.0)):
            own = slice(ends[i] - p.sizes[i], ends[i])
            found = (float(far[i]), p.at[own].tolist(), p.x[own].tolist())
            best = found if best is None else max(best, found)
    return best


def moments(parts: Iterable[Marked], weights: np.ndarray, prior: np.ndarray, unit: bool) -> np.ndarray:
    """Sums over texts of their shares in the clusters: of each marker's logs, and in the last row of texts."""
    out = np.zeros((len(weights) + 1, len(prior)))
    for p in parts:
        score = p.scores(weights, unit) + prior
        share = np.exp(score - score.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        out[-1] += share.sum(0)
        for k, own in enumerate(np.ascontiguousarray(share.T)):
            out[:-1, k] += np.bincount(p.at, p.x * np.repeat(own, p.sizes), minlength=len(weights))
    return out


def fitted_clusters(known: np.ndarray, far: Callable, total: Callable, n: int, rounds: int = 20) -> Clusters:
    """Expectation-maximisation of a multinomial mixture, begun from texts that are far apart. ``far`` and ``total`` are
    ``farthest`` and ``moments`` of all texts."""
    if not len(known) or n < 2:
        return Clusters(known, np.zeros(n), np.zeros((len(known) + 1, n)))
    seeds, every = np.zeros((len(known), 0)), total(np.zeros((len(known), 1)), np.zeros(1), False)
    least = float(every[:-1].sum() / every[-1, 0])  # the mean of all texts
    while seeds.shape[1] < n:
        _, at, x = far(seeds, least)
        own = np.zeros(len(known))
        own[at] = x
        seeds = np.c_[seeds, own / max(1e-6, np.linalg.norm(own))]
    sums, before = total(20 * seeds, np.zeros(n), True), None
    for left in range(rounds - 1, -1, -1):
        words, texts = sums[:-1] + 0.05, sums[-1]
        logs = np.log(words / words.sum(0))
        prior = np.log((texts + 1) / (texts.sum() + n))
        if not left or before is not None and abs(texts - before).max() < 1e-4 * texts.sum():
            break
        sums, before = total(logs, prior, False), texts
    return Clusters(known, prior, np.vstack((logs - logs.max(1, keepdims=True), np.zeros((1, n)))))


def fit_clusters(texts: list[list[bytes]], n: int = CLUSTERS, rounds: int = 20) -> Clusters:
    """Clusters of texts that are at hand."""
    often = Counter(t for text in texts for t in text if t)
    known = np.array(sorted(xxhash.xxh3_64_intdigest(t) for t, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:MARKERS]), _U)
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for text in texts for t in text], _U)
    part = Marked.of(place_in(known, hashes, len(known)), np.array([len(x) for x in texts], np.int64), len(known))
    return fitted_clusters(known, lambda *x: farthest([part], *x), lambda *x: moments([part], *x), n, rounds)


# Decisions about words.


@dataclass
class Frequent:
    """Frequent words by sorted hash: how often, in all and by cluster."""

    hashes: np.ndarray
    count: np.ndarray
    by_cluster: np.ndarray | None
    known: np.ndarray | None = None

    def log_prob(self, at: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Of frequent words among frequent words, in a cluster."""
        logs = self.logs()
        return logs.take(at * (len(logs) // max(1, len(self.hashes))) + cluster)

    def logs(self) -> np.ndarray:
        """All of them, by word and cluster."""
        if self.known is None:
            share = SMOOTH * self.count / max(1.0, self.count.sum())
            self.known = np.log((self.by_cluster + share[:, None]) / (self.by_cluster.sum(0, dtype=np.float64) + SMOOTH)).astype(np.float32).ravel()
        return self.known

    def without_counts(self) -> Frequent:
        """What scoring needs: the logs alone, not the counts that they come from."""
        return Frequent(self.hashes, self.count, None, self.logs())


#: Gates and start of the weights of both decisions: three tables, the share in this text, a bias.
AGAIN_GATES, FREQUENT_GATES = 24, 12
_PREDICTORS = 3


def word_start(gates: int) -> np.ndarray:
    return np.tile(np.array([0.3, 0.3, 0.3, 0.2, 0], np.float32), (gates, 1))


def _slot(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), _U)
    for x in parts:
        h = (h ^ x.astype(_U)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
    return (h * _U(0xBF58476D1CE4E5B9) >> _U(64 - WORD_BITS)).astype(np.int64)


@dataclass
class Choice:
    """Decisions of one kind: places of the tokens, table slots of their contexts, odds so far in the text, gates, outcomes."""

    at: np.ndarray
    slots: list[np.ndarray]
    share: np.ndarray
    gates: np.ndarray
    bit: np.ndarray


def choices(t: Tokens, hashes: np.ndarray, top: np.ndarray, cluster: np.ndarray) -> tuple[Choice, Choice]:
    """The decisions ``again`` and ``frequent`` about the tokens. ``top``: place among the frequent words, or -1, by name."""
    n, first = len(t.at), np.repeat(t.first, t.sizes)
    begins = np.arange(n) == first
    place = np.arange(n) - first
    before = np.r_[-1, t.at[:-1]].astype(np.int64)
    before[begins] = -1
    order = np.argsort(before.astype(np.int32), kind="stable")
    word, text = before.take(order), first.take(order)
    same = np.flatnonzero((word[1:] == word[:-1]) & (text[1:] == text[:-1]))
    last = np.full(n, -1)
    last[order[same + 1]] = order[same]  # where the word before this one stood last, the place after it
    has = last >= 0
    expected = np.where(has, t.at.take(last), -1)
    hit = expected == t.at

    def so_far(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x) - x
        return total - total.take(first)

    met = np.r_[hashes, _U(0)]  # -1: the text begins
    # how many of the tokens just before were hits
    missed = np.maximum.accumulate(np.where(hit, 0, np.arange(n) + 1))
    run = np.where(begins, 0, np.arange(n) - np.r_[0, missed[:-1]])
    # outcomes of the four tokens before: 0 rare, 1 frequent, 2 hit, 3 there is none
    known = (top >= 0).take(t.at)
    outcome = np.where(hit, 2, known)
    latest = np.where(begins, 3, np.r_[0, outcome[:-1]])
    past = latest * 64  # the latest first
    for j in range(2, 5):
        older = np.full(n, 3)
        older[j:] = np.where(place[j:] >= j, outcome[: max(0, n - j)], 3)
        past += older << 2 * (4 - j)

    tried, hits = so_far(has.astype(np.int64)), so_far(hit.astype(np.int64))
    at = np.flatnonzero(has)
    own, tried, hits = run.take(at), tried.take(at), hits.take(at)
    length, tries = np.minimum(own, 7), (tried >= 8).astype(np.int64) + (tried >= 64)
    hashed, word = met.take(expected.take(at)), met.take(before.take(at))
    again = Choice(at, [length * 3 + tries, _slot(hashed, np.minimum(own, 3)), _slot(word, hashed)], np.log((hits + 0.2) / (tried - hits + 1)), length * 3 + tries, hit.take(at).astype(np.int64))

    left = ~hit
    common = known & left
    commons, lefts = so_far(common.astype(np.int64)), so_far(left.astype(np.int64))
    at = np.flatnonzero(left)
    kind = np.where(has, 1 + (top >= 0).take(expected), 0).take(at)
    commons, lefts, latest, cluster, place = (x.take(at) for x in (commons, lefts, latest, cluster, place))
    parts = (place >= 8).astype(np.int64) + (place >= 64)
    frequent = Choice(
        at,
        [_slot(met.take(before.take(at)), np.ones(1, np.int64)), past.take(at) * CLUSTERS + cluster, (kind * 4 + latest) * CLUSTERS + cluster],
        np.log((commons + 2) / (lefts - commons + 0.5)),
        latest * 3 + parts,
        common.take(at).astype(np.int64),
    )
    return again, frequent


class ChoiceLearner:
    """Tables and weights of one kind of decision, learned as decisions come."""

    def __init__(self, gates: int):
        self.tables = np.zeros((_PREDICTORS, 1 << WORD_BITS, 2), np.uint32)
        self.odds = np.zeros((_PREDICTORS, 1 << WORD_BITS), np.float32)
        self.mixing = Learner(word_start(gates))
        self.met, self.renewed = 0, 0

    def learn(self, c: Choice) -> None:
        """In mini-batches; the tables' odds follow their counts whenever these have grown by a quarter, or by four batches."""
        for a in range(0, len(c.at), BATCH):
            for own in self._parts(a, min(a + BATCH, len(c.at))):
                slots, bit = [x[own] for x in c.slots], c.bit[own]
                odds = [*(table.take(x) for table, x in zip(self.odds, slots, strict=True)), c.share[own]]
                self.mixing.step(odds, c.gates[own], bit, self.mixing.note(odds, c.gates[own], bit))
                for table, x in zip(self.tables, slots, strict=True):
                    np.add.at(table.reshape(-1), x * 2 + bit, np.uint32(1))
                self.met += len(bit)
                if self.met - self.renewed >= min(self.renewed // 4, 4 * BATCH):
                    self.odds, self.renewed = log_odds(self.tables), self.met

    def _parts(self, a: int, b: int) -> Iterator[slice]:
        """Small batches first, so that little text is learned from too."""
        while a < b:
            stop = min(b, a + min(BATCH, max(1 << 12, self.met // 4)))
            yield slice(a, stop)
            a = stop


@dataclass
class ChoiceModel:
    odds: np.ndarray  # predictors x slots
    mixer: Mixer

    def log_prob(self, c: Choice) -> np.ndarray:
        """Natural log-probability of each decision."""
        one = self.mixer([*(table.take(x) for table, x in zip(self.odds, c.slots, strict=True)), c.share], c.gates)
        return np.log(np.where(c.bit == 1, one, 1 - one))


# Training.


def count_words(docs: DataFrame, clusters: Clusters) -> DataFrame:
    """``token, cluster, n`` over all tokens of ``docs`` (doc_id, text) and the clusters of whole texts, added up in each task
    before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(clusters)  # bounded by MARKERS
    width = len(clusters.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by(["token", "cluster"]).aggregate([("n", "sum")])
            return pa.table({"token": found["token"], "cluster": found["cluster"], "n": found["n_sum"]})

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(table.set_column(0, "token", table["token"].cast(pa.string())).to_batches(1 << 16))

        for batch in steps(batches, budget=STEP):
            t = tokenise(text_bytes(batch))
            own = shared.value.of_texts(shared.value.marker(t.hashes())[t.at], t.sizes)
            n = np.bincount(t.at.astype(np.int64) * width + np.repeat(own, t.sizes), minlength=len(t.names) * width)
            at = np.flatnonzero(n)
            held.append(pa.table({"token": t.names.take(pa.array(at // width)), "cluster": pa.array((at % width).astype(np.int32)), "n": pa.array(n[at])}))
            rows += len(at)
            if rows > MOST_COUNTS:
                held = [merged()]
                rows = held[0].num_rows
                if rows > MOST_COUNTS // 2:
                    yield from out(held[0])
                    held, rows = [], 0
        if held:
            yield from out(merged())

    return docs.select("doc_id", "text").mapInArrow(run, "token string, cluster int, n long").groupBy("token", "cluster").agg(F.sum("n").alias("n"))


def train_clusters(docs: DataFrame, n: int = CLUSTERS) -> Clusters:
    """Clusters of all ``docs`` (doc_id, text): markers by exact counts of all words, every round over every text."""
    spark = docs.sparkSession
    one = Clusters(np.empty(0, _U), np.zeros(1), np.zeros((1, 1)))
    often = count_words(docs, one).where("token <> ''").orderBy(F.desc("n"), "token").limit(MARKERS).collect()  # bounded by MARKERS
    known = np.array(sorted(xxhash.xxh3_64_intdigest(r["token"].encode()) for r in often), _U)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, budget=STEP):
            t = tokenise(text_bytes(batch))
            p = Marked.of(place_in(known, t.hashes(), len(known))[t.at], t.sizes, len(known))
            columns = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((p.sizes, "<u2"), (p.at, "<u2"), (np.rint(np.expm1(p.x)), "<u4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["sizes", "at", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Marked]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, at, count = (np.frombuffer(x, kind) for x, kind in zip(row, ("<u2", "<u2", "<u4"), strict=True))
                yield Marked(sizes.astype(np.int64), at.astype(np.int64), np.log1p(count))

    parts = written_by_workers(docs.select("doc_id", "text"), "marked", mark, "sizes binary, at binary, n binary")

    def far(seeds: np.ndarray, least: float) -> tuple[float, list[int], list[float]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = farthest(read(batches), seeds, least)
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("far", "at", "x"), found, strict=True))], schema=pa.schema([("far", pa.float64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))

        return tuple(parts.mapInArrow(run, "far double, at array<int>, x array<double>").orderBy(F.desc("far"), F.desc("at"), F.desc("x")).first())

    def total(weights: np.ndarray, prior: np.ndarray, unit: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from ranges(moments(read(batches), weights, prior, unit).ravel())

        def ranges(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, own in enumerate(np.array_split(sums, RANGES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums[i] = sums.get(i, 0) + np.frombuffer(x)
            for i, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "sums"])

        kind, out = "part int, sums binary", np.zeros((len(weights) + 1, len(prior)))
        for r in parts.mapInArrow(run, kind).repartition(6, "part").mapInArrow(add, kind).collect():  # of fixed size
            np.array_split(out.reshape(-1), RANGES)[r["part"]][:] = np.frombuffer(r["sums"])
        return out

    return fitted_clusters(known, far, total, n)


_PARTS = "name string, part int, table binary, vector array<double>"
_PART_SCHEMA = pa.schema([("name", pa.string()), ("part", pa.int32()), ("table", pa.binary()), ("vector", pa.list_(pa.float64()))])


def emitted(name: str, learner: Learner | None, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What a task has learned, as rows: vectors to be added up in columns, and ranges of a table of counts, compressed: a
    task that met little says little."""
    vectors = [] if learner is None else learner.vectors()
    parts = [] if table is None else np.array_split(table.ravel(), RANGES)
    rows = [{"name": f"{name}{i}", "vector": x.tolist()} for i, x in enumerate(vectors)] + [{"name": name, "part": i, "table": pa.compress(x.astype("<u4").tobytes(), "zstd", asbytes=True)} for i, x in enumerate(parts) if x.any()]
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema=_PART_SCHEMA)


def added_tables(parts: DataFrame, slots: dict[str, int], tag: str = "") -> DataFrame:
    """``name, part, table``: sums of the ranges over all tasks, each range in a task of its own, in 16 bits. ``slots``: of all
    ranges of a name. With a ``tag``, written."""
    sizes = {name: n * 8 // RANGES for name, n in slots.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(pa.decompress(data.as_buffer(), sizes[name], "zstd"), "<u4")
                sums[name, part] = sums[name, part] + own if (name, part) in sums else own.astype(np.uint64)
        for (name, part), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([narrow(own.reshape(-1, 2)).tobytes()], pa.binary())], names=["name", "part", "table"])

    rows = parts.where("table is not null").select("name", "part", "table").repartition(RANGES, "name", "part")
    kind = "name string, part int, table binary"
    return written_by_workers(rows, tag, add, kind) if tag else rows.mapInArrow(add, kind)


def learn_choices(docs: DataFrame, frequent: Frequent, clusters: Clusters) -> tuple[ChoiceModel, ChoiceModel]:
    """Both decisions about words, learned online from all tokens of ``docs`` in each task, then added and averaged."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent.hashes, clusters))  # bounded by TOP and MARKERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        learners = [ChoiceLearner(g) for g in (AGAIN_GATES, FREQUENT_GATES)]
        for batch in steps(batches, budget=STEP):
            t = tokenise(text_bytes(batch))
            hashes = t.hashes()
            for learner, c in zip(learners, choices(t, hashes, place_in(known, hashes), own.walk(own.marker(hashes)[t.at], t.sizes)), strict=True):
                learner.learn(c)
        for name, learner in zip("af", learners, strict=True):
            if learner.mixing.t:
                yield from emitted(name, learner.mixing, learner.tables)

    parts = written_by_workers(docs.select("doc_id", "text"), "choices", run, _PARTS)
    found, tables = summed(parts), {x: np.zeros((_PREDICTORS << WORD_BITS, 2), np.uint16) for x in "af"}
    for r in added_tables(parts, dict.fromkeys("af", _PREDICTORS << WORD_BITS)).collect():  # of fixed size
        np.array_split(tables[r["name"]].reshape(-1), RANGES)[r["part"]][:] = np.frombuffer(r["table"], np.uint16)
    return tuple(ChoiceModel(log_odds(tables[x]).reshape(_PREDICTORS, -1), joined(word_start(g), sums_of(found, x))) for x, g in (("a", AGAIN_GATES), ("f", FREQUENT_GATES)))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte occurs in the words, and a blank after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in steps(batches, "token"):
            counts += np.bincount(np.frombuffer(b" ".join(text_bytes(batch, "token")) + b" ", np.uint8), minlength=256)
        yield pa.RecordBatch.from_pylist([{"name": "bytes", "vector": counts.astype(float).tolist()}], schema=_PART_SCHEMA)

    found = summed(words.select("token").mapInArrow(run, _PARTS)).get("bytes", np.zeros(256))
    return found.astype(np.int64)


def learn_words(words: DataFrame, code: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[list[str], Mixer]:
    """Spelling from distinct words (``token, cluster``): files of its tables, and how they are mixed."""
    words, key = words.select("token", "cluster"), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in steps(batches, "token"):
            tables = np.zeros((len(_ORDERS), 1 << bits, 2), np.uint32) if tables is None else tables
            count_spelling(text_bytes(batch, "token"), batch.column(1).to_numpy(), code, tables, bits)
        if tables is not None:
            yield from emitted("s", None, tables)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(spell_start())
        for batch in steps(batches, "token", keep=key):
            tables = per_worker(key, lambda: load(files, bits))
            learn_spelling(learner, tables, bits, code, text_bytes(batch, "token"), batch.column(1).to_numpy())
        if learner.t:
            yield from emitted("s", learner, None)

    files = added_tables(words.mapInArrow(count, _PARTS), {"s": len(_ORDERS) << bits}, "tables").inputFiles()  # RANGES at most
    return files, joined(spell_start(), sums_of(summed(words.mapInArrow(learn, _PARTS)), "s"))


def load(files: list[str], bits: int, form=None) -> np.ndarray:
    """The spelling tables from files in the shared folder, (zeros, ones) or what ``form`` makes of these; one range at a time."""
    shape = (len(_ORDERS), 1 << bits)
    out = np.zeros((*shape, 2), np.uint16) if form is None else np.full(shape, form(np.zeros((1, 2), np.uint16))[0])
    bounds = np.array_split(out.reshape(-1, 2) if form is None else out.reshape(-1), RANGES)  # views
    for filesystem, path in map(pafs.FileSystem.from_uri, files):
        for batch in pq.ParquetFile(filesystem.open_input_file(path)).iter_batches(1):
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(data.as_buffer(), np.uint16).reshape(-1, 2)
                bounds[n][:] = part if form is None else form(part)
    return out


@dataclass
class Rare:
    """How words that are not frequent are discounted: by cluster, and in all."""

    discount: float
    words: np.ndarray  # occurrences by cluster
    kinds: np.ndarray  # distinct ones by cluster
    n: int
    v: int

    def prob(self, c, by_cluster, cluster: int, spelled):
        """Probability of a rare word of count ``c`` and ``by_cluster`` in a cluster; numbers, arrays or columns alike."""
        whole = self.corpus(c, spelled)
        if not self.words[cluster]:
            return whole
        return _over(by_cluster, self.discount) / float(self.words[cluster]) + float(self.discount * self.kinds[cluster] / self.words[cluster]) * whole

    def corpus(self, c, spelled):
        return _over(c, self.discount) / float(self.n) + float(self.discount * self.v / self.n) * spelled if self.n else spelled


def _over(c, discount: float):
    return F.greatest(c - discount, F.lit(0.0)) if isinstance(c, Column) else np.maximum(c - discount, 0)


@dataclass
class Model:
    """What workers hold, but for the spelling tables in the shared folder."""

    again: ChoiceModel
    frequent_choice: ChoiceModel
    frequent: Frequent
    clusters: Clusters
    files: list[str]
    bits: int
    code: tuple[np.ndarray, np.ndarray]
    mixer: Mixer

    def spelling(self) -> Spelling:
        return Spelling(self.bits, load(self.files, self.bits, packed), self.code, self.mixer)


def train(docs: DataFrame) -> tuple[Model, Rare, DataFrame, int, int]:
    """The model, the discounts and counts (``token, c, c0, ...``) of rare words, N and V of the training tokens."""
    own = docs.where(~held_out(F.col("doc_id")))
    clusters = train_clusters(own)
    give_back()
    width = len(clusters.prior)
    counts = count_words(own, clusters)
    by_cluster = [F.sum(F.when(F.col("cluster") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(width)]
    totals = written_by_workers(counts.groupBy("token").agg(F.sum("n").alias("c"), *by_cluster), "tokens")
    sums = totals.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]

    found = totals.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "token").limit(TOP).toArrow()  # bounded by TOP
    least = max(LEAST, found.column("c").to_numpy().min() + 1 if found.num_rows == TOP else 0)
    found = found.filter(pa.compute.greater_equal(found.column("c"), int(least)))
    names = (x.cast(pa.binary()).to_numpy(zero_copy_only=False) for part in found.column("token").chunks for x in (part.slice(a, 1 << 14) for a in range(0, len(part), 1 << 14)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for part in names for x in part), _U, found.num_rows)
    order = np.argsort(hashes)
    by = np.stack([found.column(f"c{k}").to_numpy().astype(np.float32) for k in range(width)], 1)
    frequent = Frequent(hashes[order], found.column("c").to_numpy()[order].astype(np.float64), by[order])
    del found, by
    at = place_in(frequent.hashes, clusters.markers)
    every = totals.agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width))).first()
    words = np.array([every[k] or 0 for k in range(width)], float)
    clusters = clusters.fitted(np.where((at >= 0)[:, None], np.r_[frequent.by_cluster, np.zeros((1, width))][at], 0), words)

    rest = totals.where(F.col("c") < int(least))
    r = rest.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), *(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2)),
        *(F.sum(f"c{k}").alias(f"w{k}") for k in range(width)), *(F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"k{k}") for k in range(width)),
    ).first()
    once, twice = r["n1"] or 0, r["n2"] or 0
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
    rare = Rare(discount, *(np.array([r[f"{x}{k}"] or 0 for k in range(width)]) for x in "wk"), r["n"] or 0, r["v"])

    again, choice = learn_choices(own, frequent, clusters)
    # each distinct word is learned in the cluster where it is most frequent, and in an order of its own
    most = F.greatest(*(F.col(f"c{k}") for k in range(width)))
    best = F.coalesce(*(F.when(F.col(f"c{k}") == most, F.lit(k)) for k in range(width)))
    mixed = F.xxhash64("token")
    words = totals.select("token", best.cast("int").alias("cluster")).repartition(max(6, totals.rdd.getNumPartitions() // 2), mixed).sortWithinPartitions(mixed)
    words = written_by_workers(words, "words")
    code = code_of(byte_counts(words))
    files, mixer = learn_words(words, code, SPELL_BITS)
    return Model(again, choice, frequent, clusters, files, SPELL_BITS, code, mixer), rare, rest, n, v


# Scoring.


class Scorer:
    def __init__(self, model: Model, n: int, v: int):
        self.model, self.spelling, self.floor = model, model.spelling(), n + 0.5 * (v + 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Per text: tokens, coded bytes, of these known here, base and score (log10) but for rare words, and these:
        ``token, cluster, times, left, spelled``: how often, how often not foretold, log10 of the spelling."""
        m, t = self.model, tokenise(texts)
        hashes = t.hashes()
        top = place_in(m.frequent.hashes, hashes)
        cluster = m.clusters.walk(m.clusters.marker(hashes)[t.at], t.sizes)
        logs = np.zeros(len(t.at))
        again, frequent = choices(t, hashes, top, cluster)
        for model, c in ((m.again, again), (m.frequent_choice, frequent)):
            logs[c.at] += model.log_prob(c)
        common = frequent.at[frequent.bit == 1]
        logs[common] += m.frequent.log_prob(top[t.at[common]], cluster[common])
        place = top[t.at]
        count = np.where(place >= 0, np.r_[m.frequent.count, 0][place], 0)
        base = np.where(place >= 0, np.log10((count + 0.5) / self.floor), 0)
        sizes = np.diff(np.frombuffer(t.names.buffers()[1], np.int32, len(t.names) + 1, 4 * t.names.offset))
        sums = [np.add.reduceat(x, t.first) for x in (sizes[t.at] + 1, place >= 0, base, logs / math.log(10))]

        rare = np.flatnonzero(place < 0)
        left = np.zeros(len(t.at), np.int64)
        left[frequent.at] = 1
        width, names = m.clusters.evidence.shape[1], len(t.names)
        owner = np.repeat(np.arange(len(t.sizes)), t.sizes)[rare]
        own, at, times = np.unique((owner * names + t.at[rare]) * width + cluster[rare], return_inverse=True, return_counts=True)
        kinds, kind = np.unique(own % (names * width), return_inverse=True)
        words = t.names.take(pa.array(kinds // width))
        spelled = self.spelling.log_prob(words.to_numpy(zero_copy_only=False).tolist(), kinds % width) / math.log(10) if len(kinds) else np.zeros(0)
        columns = [words.cast(pa.string()).take(pa.array(kind)), pa.array((own % width).astype(np.int32)), pa.array(times), pa.array(np.bincount(at, left[rare], minlength=len(own)).astype(np.int64)), pa.array(spelled[kind])]
        ends = np.searchsorted(own, np.arange(len(t.sizes) + 1) * names * width)
        return t.sizes, *sums, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["token", "cluster", "times", "left", "spelled"]))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row (scores in log10).

    ``bits_per_byte`` is over the bytes that are coded: those of the words, and one for each token. Null and empty texts hold
    the end alone. Null ids count as the text "" for the split; repeated rows are counted and scored as rows of their own;
    with nothing to train on, counts are zero and bits are even. An empty table gives an empty result; only doc_id and text
    are read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    model, rare, rest, n, v = train(docs)
    floor, width = n + 0.5 * (v + 1), len(model.clusters.prior)
    shared = spark.sparkContext.broadcast(replace(model, frequent=model.frequent.without_counts()))  # bounded by TOP and WORD_BITS

    def run(batches: Iterator[pa.RecordBatch], key: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(key, lambda: Scorer(shared.value, n, v))
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches, budget=STEP, keep=key):
            sizes, coded, known, base, own, words = scorer(text_bytes(batch))
            numbers = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0), pa.array(sizes), pa.array(coded.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own), words], names=["row", "doc_id", "n_tokens", "coded", "known", "base", "score", "rare"])

    # written: the row numbers hold from here on
    scored = written_by_workers(docs, "scored", run, f"row long, doc_id {kind}, n_tokens long, coded long, known long, base double, score double, rare array<struct<token:string,cluster:int,times:bigint,left:bigint,spelled:double>>")
    each = scored.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(rest, "token", "left")
    c = F.coalesce("c", F.lit(0))
    spelled = F.pow(F.lit(10.0), "spelled")
    p = F.coalesce(*(F.when(F.col("cluster") == k, rare.prob(c, F.coalesce(f"c{k}", F.lit(0)), k, spelled)) for k in range(width)))
    scale = F.lit(rare_floor(rare))  # spellings too unlikely for a double: their log is added instead
    logs = F.when((c == 0) & (F.col("spelled") < -250), scale[F.col("cluster")] + F.col("spelled")).otherwise(F.log10(p))
    added = each.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / floor)).alias("base_more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"), F.sum(F.when(F.col("left") > 0, F.col("left") * logs).otherwise(0.0)).alias("more")
    )
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return scored.join(added, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total * math.log2(10) / F.col("coded")).alias("bits_per_byte"),
    )


def rare_floor(rare: Rare) -> list[float]:
    """log10 of what a spelling's probability is multiplied by where a word was never met, by cluster."""
    return [math.log10(rare.prob(0.0, 0.0, k, 1.0)) for k in range(len(rare.words))]

"""Document quality from random-indexing word vectors and a two-layer network.

Every term has a fixed sparse ternary index vector, drawn from its hash. A term's word vector is
its index vector plus the index vectors of its neighbours over all texts, scaled to length one;
tasks add the neighbours up in whole numbers, so the order of the texts does not matter. A document
is the mean of its terms' vectors, once over occurrences and once over distinct terms, with two counts. One hidden layer and a logistic unit, trained in numpy, give a logit; one
temperature, fitted on rows kept aside, makes probabilities of it. The network's fit reads a bounded sample
of labelled rows (``sample``, lowest hashes of doc_id); scoring covers every whole text.

Defined results: null and empty texts score as a text without terms; without both classes among
the labelled rows every score is 0. Repeated rows score alike; labels that are null are not learned.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts

SAMPLE = 12_000  # labelled rows that the fit reads, at most
BUCKETS = 1 << 15
BLOCK = 32  # buckets that are added up together
WIDTH = 64
HIDDEN = 32
WINDOW = 2
CUT = 0.7
_TERM = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class TermIds:
    """Bucket of each term occurrence: words by lower case and shape, other characters as runs."""

    def __init__(self, kept: int = 500_000):
        self.seen: dict[str, int] = {}
        self.kept = kept

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.seen) > self.kept:
            self.seen = {}
        seen, terms = self.seen, _TERM.findall(text) if text else []
        ids = list(map(seen.get, terms))
        if None in ids:
            for w in set(terms).difference(seen):
                key = w if not w[0].isalnum() else ("^" + w.lower() if len(w) > 1 and w.isupper() else w.lower())
                seen[w] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS
            ids = list(map(seen.__getitem__, terms))
        return np.array(ids, np.int32)


def index_vectors(seed: int = 11, nonzero: int = 6) -> np.ndarray:
    """The ternary index vector of every bucket."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :nonzero]
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (BUCKETS, nonzero)), axis=1)
    return out


class NeighbourSums:
    """The sums, for each bucket, of the index vectors of its neighbours up to WINDOW terms away.

    Neighbouring terms are counted as pairs, in slices of about ``together``; a pair then adds its
    count to the few cells where the other's index vector is not zero.
    """

    def __init__(self, together: int = 1 << 22):
        index = index_vectors()
        at = np.nonzero(index)
        self.cells = (at[1] + np.where(index[at] < 0, WIDTH, 0)).astype(np.int32).reshape(BUCKETS, -1)  # negative entries in a second row
        self.sums = np.zeros((BUCKETS, WIDTH), np.int64)
        self.together, self.pairs, self.held = together, [], 0

    def add(self, docs: list[np.ndarray]) -> None:
        gap = np.full(WINDOW, -1, np.int32)
        for start in range(0, len(docs), 256):
            ids = np.concatenate([x for d in docs[start : start + 256] for x in (d, gap)])
            for k in range(1, WINDOW + 1):
                a, b = ids[:-k], ids[k:]
                self.pairs.append((a.astype(np.int64) * BUCKETS + b)[(a >= 0) & (b >= 0)])
                self.held += len(self.pairs[-1])
            if self.held >= self.together:
                self.flush()

    def flush(self) -> None:
        pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *self.pairs]))
        self.pairs, self.held = [], 0
        if not len(pairs):
            return
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        n, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
        left, right = pairs // BUCKETS, pairs % BUCKETS
        for some in np.array_split(np.arange(len(pairs)), 1 + len(pairs) // 500_000):
            for own, other in ((left[some], right[some]), (right[some], left[some])):
                cells = (own * (2 * WIDTH))[:, None] + self.cells[other]
                counts = np.bincount(cells.ravel(), np.repeat(n[some], cells.shape[1]), BUCKETS * 2 * WIDTH).astype(np.int64).reshape(BUCKETS, 2, WIDTH)
                self.sums += counts[:, 0] - counts[:, 1]


def scaled(sums: np.ndarray) -> np.ndarray:
    """Word vectors: index vectors plus the neighbours' sums, rows scaled to length one."""
    out = (index_vectors() + sums).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors over every text of ``docs``; a task sends BUCKETS rows at most, and so do all of them together to the driver."""

    def make():
        terms, near = TermIds(), NeighbourSums()

        def step(texts):
            near.add([terms(t) for t in texts])
            return {"block": [], "sums": []}

        def finish():
            near.flush()
            blocks = near.sums.reshape(-1, BLOCK * WIDTH)
            used = np.flatnonzero(blocks.any(axis=1))
            return {"block": used.astype(np.int32), "sums": [x.tobytes() for x in blocks[used]]}

        step.finish = finish
        return step

    def add_up(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * WIDTH, np.int64)
        for x in rows["sums"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"block": rows["block"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    got = map_texts(docs, ["text"], make, "block int, sums binary").groupBy("block").applyInArrow(add_up, "block int, sums binary").toArrow()
    out = np.zeros((BUCKETS // BLOCK, BLOCK * WIDTH), np.int64)
    for block, x in zip(got["block"].to_pylist(), got["sums"].to_pylist(), strict=True):
        out[block] = np.frombuffer(x, np.int64)
    out = out.reshape(BUCKETS, WIDTH)
    return scaled(out)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means over occurrences and over distinct terms, log count, and share of distinct terms."""
    if not len(ids):
        return np.zeros(2 * WIDTH + 2, np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    used = np.flatnonzero(counts != 0)
    v, n = vectors[used], counts[used].astype(np.float32)
    return np.concatenate([n @ v / len(ids), v.mean(axis=0), [np.log1p(len(ids)) / 10, len(used) / len(ids)]]).astype(np.float32)


class Network:
    """Standardised inputs, one tanh layer, a logit divided by the temperature."""

    def __init__(self, vectors, mean, scale, w1, b1, w2, b2, temperature):
        self.parts = (vectors, mean, scale, w1, b1, w2, b2, temperature)

    def logits(self, x: np.ndarray) -> np.ndarray:
        _, mean, scale, w1, b1, w2, b2, _ = self.parts
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        z = self.logits(np.stack([pool(d, self.parts[0]) for d in docs])).astype(float) / self.parts[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on four fifths of the rows of pooled texts ``x``; the temperature minimises the log loss of the fifth kept aside."""
    if not len(x) or y.min() == y.max():
        width = 2 * WIDTH + 2
        return Network(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), -30.0, 1.0)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(x), bool)
    aside[rng.permutation(len(x))[: len(x) // 5]] = True
    mean, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-4
    z, t = (x - mean) / scale, y.astype(np.float32)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    p = [a.astype(np.float32) for a in p]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(~aside)
    for _ in range(epochs):
        rng.shuffle(rows)
        for some in np.array_split(rows, max(1, len(rows) // 128)):
            step += 1
            h = np.tanh(z[some] @ p[0] + p[1])
            gap = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[some]) / len(some)
            back = gap[:, None] * p[2] * (1 - h**2)
            grads = [z[some].T @ back + decay * p[0], back.sum(axis=0), h.T @ gap + decay * p[2], gap.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit, truth = net.logits(x[aside]).astype(float), y[aside]
    if len(truth):
        grid = np.exp(np.linspace(-1.5, 1.5, 61))
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -logit, logit) / g)) for g in grid]
        net.parts = (*net.parts[:-1], float(grid[int(np.argmin(loss))]))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Word vectors over all of ``docs``; the network on at most ``sample`` rows of ``labels`` (doc_id, label 0/1) and their texts."""
    chosen = bounded_sample(labels.where("label is not null and doc_id is not null").select("doc_id", "label").distinct(), sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` short rows
    texts = texts.select(F.xxhash64("doc_id").alias("at"), F.col("label").cast("int").alias("label"), "text")
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        terms = TermIds()
        return lambda at, ys, texts: {"at": at, "label": ys, "pooled": [pool(terms(t), shared.value).tobytes() for t in texts]}

    got = map_texts(texts, ["at", "label", "text"], make, "at long, label int, pooled binary").toArrow().sort_by([("at", "ascending"), ("label", "ascending"), ("pooled", "ascending")])
    x = np.frombuffer(b"".join(got["pooled"].to_pylist()), np.float32).reshape(-1, 2 * WIDTH + 2)
    return train(x, got["label"].to_numpy().astype(float), vectors)


def score(docs: DataFrame, held_out: Column, model: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    def make():
        net, terms = Network(*shared.value), TermIds()

        def step(ids, held, texts):
            scores = net.score([terms(t) for t in texts]).tolist()
            return {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(s >= CUT) for s in scores]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), ["doc_id", "held_out", "text"], make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """Learn from ``labels`` rows (doc_id, label) that are not held out; score every row of ``docs``."""
    return score(docs, held_out, fit(docs, labels.where(~held_out), sample))

"""Toxicity by a second-order factorization machine over hashed terms.

Terms are a document's distinct lower-case words and their first characters, hashed, and marks for
first characters that two, or three or more, of the distinct words share: one form of a stem may
be harmless where several are not. Besides one weight a term, each has a small vector; the dot
product of two terms' vectors is the weight of their meeting in a document, so an insult together
with a group's mention can score above the sum of both. Most of the machine's terms are those that
tell the classes apart by themselves; the rest are the most frequent others, which may do so in pairs.

Fitting runs in numpy on a bounded sample of labelled rows (``sample``, lowest hashes of doc_id),
and of each on its first ``LONGEST`` of the machine's terms, in the order of their choice; terms
are counted and chosen from whole texts, and scoring covers every whole text, on the executors.

Defined results: null and empty texts score as a text without terms; without both classes among
the labelled rows every score is 0. Repeated rows score alike; labels that are null are not learned.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, map_texts

SAMPLE = 20_000  # labelled rows that the fit reads, at most
TERMS = 20_000  # hashed terms that the machine has, at most
BITS = 20
RANK = 8
FREQUENT = 512  # terms of those that are there for their meetings with others
LONGEST = 2_000  # terms of a text that the fit reads, at most
STEMS = (4, 5, 7)
POSITIVE = 2.5  # weight of a toxic row in the loss
CUT = 0.7
_WORD = re.compile(r"[^\W_]+")


class TermHasher:
    """Hashed terms of texts; one bounded cache of words a task."""

    def __init__(self, kept: int = 500_000):
        self.seen: dict[str, tuple[int, ...]] = {}
        self.kept = kept

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.seen) > self.kept:
            self.seen = {}
        seen, out = self.seen, []
        for w in set(_WORD.findall(text.lower())) if text else ():
            pair = seen.get(w)
            if pair is None:
                keys = [w, *(f"^{k}{w[:k]}" for k in STEMS)]
                pair = seen[w] = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) >> (32 - BITS) for k in keys)
            out.extend(pair)
        terms, n = np.unique(np.array(out, np.int32), return_counts=True)
        marks = [(terms[n >= k].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(k * 0x05EBCA77)) >> np.uint32(32 - BITS) for k in (2, 3)]
        return np.unique(np.concatenate([terms, *(m.astype(np.int32) for m in marks)]))


class FactorizationMachine:
    """score(terms): bias + sum of weights + half the difference of squared sums and sums of squares of the vectors."""

    def __init__(self, at: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.at, self.bias, self.weight, self.factor = at, bias, weight, factor  # at: a term's row by hash, 0: none
        self.square = (factor**2).sum(axis=1)

    def score(self, terms: np.ndarray) -> float:
        rows = self.at[terms]
        rows = rows[rows > 0]
        total = self.factor[rows].sum(axis=0)
        z = self.bias + self.weight[rows].sum() + 0.5 * (float(total @ total) - float(self.square[rows].sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select_terms(term: np.ndarray, df: np.ndarray, pos: np.ndarray, n: int, p: float, most: int, least_df: int = 5, least_gap: float = 6.63) -> np.ndarray:
    """A row (from 1) for each chosen term, 0 for all others, given the documents that hold a term, and the positive ones.

    The first are the terms that tell the classes apart by chi-square, best first, as far as
    ``least_gap``; the last ``FREQUENT`` are the most frequent others.
    """
    gap = (pos - df * p) ** 2 / np.maximum(df * p * (1 - p) * (1 - df / n), 1e-9)
    often = np.flatnonzero(df >= least_df)
    by_gap = often[np.lexsort((term[often], -gap[often]))]
    by_gap = by_gap[gap[by_gap] >= least_gap][: max(0, most - FREQUENT)]
    rest = np.setdiff1d(often, by_gap)
    by_df = rest[np.lexsort((term[rest], -df[rest]))][:FREQUENT]
    at = np.zeros(1 << BITS, np.int32)
    order = term[np.concatenate([by_gap, by_df])]
    at[order] = np.arange(1, len(order) + 1)
    return at


def counted(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the documents that hold them, and the positive ones of those."""
    term, at = np.unique(np.concatenate(docs), return_inverse=True)
    return term, np.bincount(at).astype(float), np.bincount(at, np.repeat(y, [len(d) for d in docs]))


def train(docs: list[np.ndarray], y: np.ndarray, at: np.ndarray | None = None, terms: int = TERMS, rank: int = RANK, epochs: int | None = None, rate: float = 0.1, l2: float = 2e-5, seed: int = 7) -> FactorizationMachine:
    """Logistic loss by AdaGrad in mini-batches; all randomness comes from ``seed``.

    ``docs`` are the documents' terms, or their rows in ``at`` if that is given.
    """
    if not len(docs) or y.min() == y.max():
        return FactorizationMachine(np.zeros(1 << BITS, np.int32), -30.0, np.zeros(1, np.float32), np.zeros((1, rank), np.float32))
    epochs = epochs or max(12, min(80, 240_000 // len(docs)))  # small samples need as many steps as large ones
    if at is None:
        at = select_terms(*counted(docs, y), len(docs), float(y.mean()), terms)
        docs = [at[d] for d in docs]
    rows = [r[r > 0] for r in docs]
    rng, size = np.random.default_rng(seed), int(at.max()) + 1
    weight, factor = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_f, seen_b = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for some in np.array_split(order, max(1, len(order) // 256)):
            ids = np.concatenate([rows[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            f = factor[ids]
            total = np.stack([np.bincount(owner, f[:, k], len(some)) for k in range(rank)], axis=1)
            square = np.bincount(owner, (f**2).sum(axis=1), len(some))
            z = bias + np.bincount(owner, weight[ids], len(some)) + 0.5 * ((total**2).sum(axis=1) - square)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * np.where(y[some] > 0, POSITIVE, 1.0) / np.sqrt(len(some))
            used, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, gap[owner]) + l2 * weight[used]
            each = gap[owner][:, None] * (total[owner] - f)
            gf = np.stack([np.bincount(back, each[:, k]) for k in range(rank)], axis=1) + l2 * factor[used]
            seen_w[used] += g**2
            seen_f[used] += gf**2
            seen_b += gap.sum() ** 2
            weight[used] -= (rate * g / np.sqrt(seen_w[used])).astype(np.float32)
            factor[used] -= (0.2 * rate * gf / np.sqrt(seen_f[used])).astype(np.float32)
            bias -= rate * gap.sum() / np.sqrt(seen_b)
    return FactorizationMachine(at, bias, weight, factor)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, label 0/1) and their texts in ``docs``."""
    chosen = bounded_sample(labels.where("label is not null and doc_id is not null").select("doc_id", "label").distinct(), sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` short rows
    texts = texts.select(F.xxhash64("doc_id").alias("at"), F.col("label").cast("int").alias("label"), "text")
    scratch = Scratch(docs.sparkSession, "toxicity")

    def make():
        terms = TermHasher()
        return lambda at, ys, texts: {"at": at, "label": ys, "terms": [terms(t) for t in texts]}

    held = scratch.keep("terms", map_texts(texts, ["at", "label", "text"], make, "at long, label int, terms array<int>"))
    n, positive = held.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < positive < n:
        return train([], np.zeros(0))
    found = held.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos")).where("df > 1").toArrow()  # 2**BITS rows at most
    rows = select_terms(found["term"].to_numpy(), found["df"].to_numpy().astype(float), found["pos"].to_numpy().astype(float), n, positive / n, TERMS)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def pick():
        def step(at, ys, terms):
            found = [shared.value[np.array(x, np.int32)] for x in terms]
            return {"at": at, "label": ys, "rows": [np.sort(r[r > 0])[:LONGEST].tobytes() for r in found]}

        return step

    got = map_texts(held, ["at", "label", "terms"], pick, "at long, label int, rows binary").toArrow().sort_by([("at", "ascending"), ("label", "ascending"), ("rows", "ascending")])
    scratch.drop("terms")
    return train([np.frombuffer(x, np.int32) for x in got["rows"].to_pylist()], got["label"].to_numpy().astype(float), rows)


def score(docs: DataFrame, held_out: Column, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.at, model.bias, model.weight, model.factor))

    def make():
        machine, terms = FactorizationMachine(*shared.value), TermHasher()

        def step(ids, held, texts):
            scores = [machine.score(terms(t)) for t in texts]
            return {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(s >= CUT) for s in scores]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), ["doc_id", "held_out", "text"], make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """Learn from ``labels`` rows (doc_id, label) that are not held out; score every row of ``docs``."""
    return score(docs, held_out, fit(docs, labels.where(~held_out), sample))

"""Language identification as inference of a mixture of languages.

Each language is a smoothed distribution over hashed letter bigrams and trigrams. A document is taken as a
mixture: expectation-maximisation estimates the share of every language from the n-gram
likelihoods. Sets of languages are compared by penalised likelihood (k - 1 free shares cost
``penalty`` times the logarithm of the n-gram count each): all languages, then one less each time,
the one of the smallest share, and every language alone. The largest share in the best of these
names the document's language and is its score.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no shares;
equal shares go to the name that sorts first; with nothing to learn from, every document is ``und``.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, released, sliced

BUCKETS = 1 << 15


@cache
def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower case, or a blank where it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters than letters as one blank, blanks at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = letter_table()[np.minimum(points, 0xFFFF)]
    if not text.isascii() and (far := np.flatnonzero(points > 0xFFFF)).size:
        x[far] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in points[far].tolist()]
    blank = x == 32
    if blank.all():
        return np.zeros(0, np.uint32)
    keep = np.empty(len(x), bool)
    keep[0] = not blank[0]
    np.logical_not(blank[1:] & blank[:-1], out=keep[1:])
    x = x[keep]
    out = np.full(len(x) + 2 - int(x[-1] == 32) - int(x[0] == 32), 32, np.uint32)
    out[1 - int(x[0] == 32) :][: len(x)] = x
    return out


def grams(text: str | None) -> np.ndarray:
    """The hashed buckets of a text's bigrams and trigrams of letters, blanks included."""
    x = letters(text) if text else np.zeros(0, np.uint32)
    if not len(x):
        return np.zeros(0, np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two, three])
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


class MixtureModel:
    """log_p: a row of log probabilities for each of ``names``."""

    def __init__(self, names: list[str], log_p: np.ndarray, penalty: float = 3.0):
        self.names, self.log_p, self.penalty = names, log_p, penalty
        scaled = log_p.T - log_p.T.max(axis=1, keepdims=True, initial=-np.inf) if len(names) else log_p.T
        self.log_ratio = np.ascontiguousarray(scaled, dtype=np.float32)
        self.ratio = np.exp(self.log_ratio)

    @staticmethod
    def em(p: np.ndarray, weight: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, float]:
        """Shares and log likelihood: p has a row for each n-gram, divided by its largest likelihood."""
        share = np.full(p.shape[1], 1 / p.shape[1], p.dtype)
        for _ in range(rounds):
            mixed = p @ share
            share = share * ((weight / mixed) @ p)
            share = np.maximum(share / share.sum(), 1e-9)
        return share, float(weight @ np.log(p @ share))

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of the chosen set with their shares, largest first."""
        ids = grams(text)
        if not len(ids) or not self.names:
            return []
        counts = np.bincount(ids, minlength=BUCKETS)
        seen = np.flatnonzero(counts != 0)
        weight = counts[seen].astype(np.float32)
        p = self.ratio[seen]
        alone = weight @ self.log_ratio[seen]
        first = int(np.argmax(alone))
        best, best_share, chosen = float(alone[first]), np.ones(1), np.array([first])
        cost = self.penalty * math.log(len(ids) + 1)
        left = np.arange(len(self.names))
        while len(left) > 1:
            trial, fit = self.em(p[:, left], weight)
            if fit - cost * (len(left) - 1) > best:
                best, best_share, chosen = fit - cost * (len(left) - 1), trial, left
            left = np.delete(left, len(left) - 1 - int(np.argmin(trial[::-1])))
        pairs = [(self.names[i], min(1.0, float(s))) for i, s in zip(chosen.tolist(), best_share.tolist(), strict=True)]
        return sorted(pairs, key=lambda x: (-x[1], x[0]))


def fit(train: DataFrame, alpha: float = 0.1, penalty: float = 3.0) -> MixtureModel:
    """Count n-grams over every row of ``train`` (text, lang non-null).

    Tasks pre-aggregate, so the driver receives at most BUCKETS counts a language.
    """

    def make():
        held: dict[str, np.ndarray] = {}

        def step(texts, langs):
            for t, lang in zip(texts, langs, strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                ids = grams(t)
                if len(ids):
                    held[lang] += np.bincount(ids, minlength=BUCKETS)
            return {"lang": [], "bucket": [], "n": []}

        def finish():
            rows = [(lang, np.flatnonzero(c), c) for lang, c in sorted(held.items())]
            return {
                "lang": [lang for lang, at, _ in rows for _ in range(len(at))],
                "bucket": np.concatenate([at for _, at, _ in rows] or [np.zeros(0, np.int64)]).astype(np.int32),
                "n": np.concatenate([c[at] for _, at, c in rows] or [np.zeros(0, np.int64)]),
            }

        step.finish = finish
        return step

    counts = map_texts(train.where("lang is not null"), ["text", "lang"], make, "lang string, bucket int, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(pa.compute.unique(got["lang"]).to_pylist())
    table = np.zeros((len(names), BUCKETS))
    if names:
        row = pa.compute.index_in(got["lang"], pa.array(names)).to_numpy()
        table[row, got["bucket"].to_numpy()] = got["n"].to_numpy()
    log_p = np.log((table + alpha) / (table.sum(axis=1, keepdims=True) + alpha * BUCKETS))
    return MixtureModel(names, log_p, penalty)


def shared_model(docs: DataFrame, model: MixtureModel):
    """Broadcast parts of a model: at most BUCKETS numbers a language."""
    return docs.sparkSession.sparkContext.broadcast((model.names, model.log_p, model.penalty))


def mixtures(docs: DataFrame, model: MixtureModel, carry: list[str]) -> DataFrame:
    """``carry``, lang_pred, score, languages and shares of each row."""
    shared = shared_model(docs, model)

    def make():
        m = MixtureModel(*shared.value)

        def step(*columns):
            found = [m.infer(t) for t in columns[-1]]
            return dict(zip(carry, columns, strict=False)) | {
                "lang_pred": [x[0][0] if x else "und" for x in found],
                "score": [x[0][1] if x else 0.0 for x in found],
                "languages": [[a for a, _ in x] for x in found],
                "shares": [[b for _, b in x] for x in found],
            }

        return step

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_texts(docs, [*carry, "text"], make, f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")


def accepted(docs: DataFrame, model: MixtureModel, least_share: float) -> DataFrame:
    """Rows whose largest share is ``least_share`` or more, all columns; a null lang becomes the inferred one."""
    shared, text, lang = shared_model(docs, model), docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        m = MixtureModel(*shared.value)
        for batch in batches:
            for b in sliced(batch, 1000):
                found = [(m.infer(t) or [(None, 0.0)])[0] for t in b.column(text).to_pylist()]
                filled = pa.compute.coalesce(b.column(lang), pa.array([name for name, _ in found], b.schema.field(lang).type))
                out = pa.RecordBatch.from_arrays([filled if i == lang else c for i, c in enumerate(b.columns)], schema=b.schema)
                yield out.filter(pa.array([share > 0 and share >= least_share for _, share in found], pa.bool_()))
        m = batch = b = found = filled = out = None
        released()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that are not held out, then infer every row: doc_id, held_out, lang_pred, score, languages, shares."""
    model = fit(docs.where(~held_out))
    out = mixtures(docs.withColumn("__held_out", held_out).select("doc_id", "text", F.col("__held_out").alias("held_out")), model, ["doc_id", "held_out"])
    return out

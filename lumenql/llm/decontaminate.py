"""Benchmark decontamination by spaced-seed hashing.

Texts and test items are sequences of lower-case words. A seed mask picks six of up to eleven
neighbouring words and ignores the others, so it still hits where ignored words were substituted.
The masks are chosen once, by rule, so that any two substitutions within WINDOW words leave a hit,
and so does any one substitution in a whole item of LEAST words or more but fewer than WINDOW.
Every position of every document is hashed under every mask and joined with the hashes of the
items; each hit is then verified on its diagonal: a document contains an item if some WINDOW
neighbouring words (or the whole item, if shorter) match it word for word, in place, but for
``MISSES`` in WINDOW. Items of fewer than LEAST words are found as exact copies only, by a hash of
the whole item at every position. The items of a block (bounded by ``block`` rows) are broadcast; larger
benchmarks are worked off in further blocks, each against all documents.

Defined results: null and empty texts and items never match. Repeated documents and items are reported each for itself.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, released, sliced

WINDOW, MISSES, WEIGHT, LEAST = 13, 2, 6, 8
BLOCK = 20_000
PAIRS = 1 << 22
_WORD = re.compile(r"\w+")


@cache
def masks() -> tuple[tuple[int, ...], ...]:
    """Offsets of the words that each mask reads: greedily, the mask that leaves fewest substitution patterns unhit. All read the first two words."""
    open_patterns = {(n, frozenset(x)) for n in range(LEAST, WINDOW + 1) for x in itertools.combinations(range(n), MISSES * n // WINDOW)}
    choices = [(0, 1, *inner, span - 1) for span in range(WEIGHT, 12) for inner in itertools.combinations(range(2, span - 1), WEIGHT - 3)]
    hits = {m: {(n, x) for n, x in open_patterns if any(not x & {p + o for o in m} for p in range(n - m[-1]))} for m in choices}
    out = []
    while open_patterns:
        best = max(choices, key=lambda m: (len(hits[m] & open_patterns), -m[-1]))
        out.append(best)
        open_patterns -= hits[best]
    return tuple(out)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class SeedIndex:
    """Seeds of a block of items, and the search of one document against them."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.names = [], []
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for name, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            if len(w) >= LEAST:
                self.ids.append(np.array(w, np.int32))
                self.names.append(name)
            elif w:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(name)
        self.short_hash = {n: np.unique(np.concatenate([self.whole(np.array(w, np.int32), n) for w in found])) for n, found in self.short.items()}
        rng = np.random.default_rng(1)
        self.factor = rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
        self.pairs = np.zeros(PAIRS, bool)
        for x in self.ids:
            self.pairs[self.pair(x)] = True  # which first two words any item has; one look-up rules out most positions
        found = [(h, np.full(len(p), i), p) for i, x in enumerate(self.ids) for h, p in [self.seeds(x)]]
        h, item, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def whole(x: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each position on."""
        h = np.zeros(max(0, len(x) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)].astype(np.uint64)
        return h

    @staticmethod
    def pair(x: np.ndarray) -> np.ndarray:
        return (x[:-1] * 1_000_003 + x[1:]) & (PAIRS - 1)

    def seeds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first position of every seed of a sequence whose words are all known to the items."""
        opens = np.flatnonzero(self.pairs[self.pair(x)])
        hashes, places = [], []
        for k, mask in enumerate(masks()):
            p = opens[: np.searchsorted(opens, len(x) - mask[-1])]
            read = x[p[:, None] + np.array(mask)]
            known = read.all(axis=1)
            if not known.any():
                continue
            p, y = p[known], read[known].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = ((y ^ (y >> np.uint64(31))) * self.factor[: len(mask)]).sum(axis=1) + np.uint64(k)
            hashes.append(h ^ (h >> np.uint64(29)))
            places.append(p)
        return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """For each matching item: matching words on its best diagonal, words of the item, first word in the document."""
        get = self.vocab.get
        words = words_of(text)
        x = np.fromiter(map(get, words, itertools.repeat(0)), np.int32, len(words))
        return self.aligned(x) | self.copies(x)

    def copies(self, x: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The short items that a sequence contains word for word, at their first places."""
        out: dict[int, tuple[int, int, int]] = {}
        for n, found in self.short.items():
            for p in np.flatnonzero(np.isin(self.whole(x, n), self.short_hash[n])).tolist():
                for name in found.get(tuple(x[p : p + n].tolist()), ()):
                    out.setdefault(name, (n, n, p))
        return out

    def aligned(self, x: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The items of LEAST words or more that a sequence contains, by their seeds."""
        if len(x) < LEAST:
            return {}
        h, p = self.seeds(x)
        likely = self.bits[(h >> np.uint64(42)).astype(np.int64)]
        h, p = h[likely], p[likely]
        if not len(h):
            return {}
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = high - low
        if not n.sum():
            return {}
        each = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.stack([self.item[each], np.repeat(p, n) - self.at[each]], axis=1), axis=0)
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in pairs.tolist():
            y = self.ids[item]
            a, b = max(0, -shift), min(len(y), len(x) - shift)
            same = y[a:b] == x[a + shift : b + shift]
            size = min(WINDOW, len(y))
            if len(same) < size:
                continue
            sums = np.cumsum(np.concatenate([[0], same]))
            if (sums[size:] - sums[:-size]).max() >= size - MISSES * size // WINDOW:
                got = (int(sums[-1]), len(y), a + shift)
                if got > best.get(item, (0, 0, 0)):
                    best[item] = got
        return {self.names[i]: v for i, v in best.items()}


def blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``block`` rows, each collected by itself."""
    n = max(1, -(-benchmark.count() // block))
    for k in range(n):
        yield [(r[0], r[1]) for r in benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).select("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, matched, item_words, start: a row for each document and item it contains."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parts = []
    for items in blocks(benchmark.where("item_id is not null"), block):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared):
            index = SeedIndex(shared.value)

            def step(ids, texts):
                rows = [(d, i, *v) for d, t in zip(ids, texts, strict=True) for i, v in sorted(index.search(t).items())]
                return dict(zip(("doc_id", "item_id", "matched", "item_words", "start"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

            return step

        parts.append(map_texts(docs, ["doc_id", "text"], make, f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, matched long, item_words long, start long"))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; filtered where they are read, without a join."""
    out, spark = docs, docs.sparkSession
    at = docs.columns.index("text")
    schema: T.StructType = docs.schema
    for items in blocks(benchmark.where("item_id is not null"), block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = SeedIndex(shared.value)
            for batch in batches:
                for b in sliced(batch, 1000):
                    yield b.filter(pa.array([not index.search(t) for t in b.column(at).to_pylist()], pa.bool_()))
            index = batch = b = None
            released()

        out = out.mapInArrow(run, schema)
    return out

"""Byte-level BPE by a pair occurrence index over a whole batch of distinct words.

All distinct pre-tokens of a batch lie in one symbol array as doubly linked lists. An index maps
each mergeable pair, by rank, to every position where it starts. Active ranks are taken in
ascending order; one rank's positions are merged together in numpy, and only the neighbours they
touch enter the index anew. Each distinct word is encoded once a task, however often it occurs.

Defined results: null and empty texts have no tokens and decode to ''. The special tokens that the
file lists are recognised inside texts, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts

# Letters and numbers that Unicode 16.0 added to 15.1, which the tokenizer's classes have.
ADDED_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# The White_Space property.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@cache
def splitter(last: int) -> re.Pattern:
    """The byte-level pre-tokenizer with its Unicode classes spelled out up to the code point ``last``.

    The standard library's engine is about three times as fast on spelled-out classes as one with properties.
    """

    def ranges(major: str, added: list[tuple[int, int]]) -> str:
        hit = np.array([unicodedata.category(chr(c))[0] == major for c in range(last + 1)])
        for a, b in added:
            hit[a : b + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        return spell(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))

    def spell(pairs) -> str:
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs)

    letter, number, blank = ranges("L", ADDED_LETTERS), ranges("N", ADDED_NUMBERS), spell(WHITE)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else the next free code point from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """Encodes and decodes with one vocabulary; ``kept`` bounds the bytes of the cache of encoded words, ids and all."""

    def __init__(self, spec: str, kept: int = 96 << 20):
        model, symbols = json.loads(spec), byte_symbols()
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        piece = {i: bytes(symbols[c] for c in x) for x, i in vocab.items()} | {i: x.encode() for x, i in self.special.items()}
        pieces = [piece.get(i, b"") for i in range(max(piece) + 1)]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(x) for x in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.of_byte = np.full(256, -1, np.int32)
        for c, b in symbols.items():
            self.of_byte[b] = vocab[c]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = {int(t): r for r, t in enumerate(self.made)}
        if len(born) != len(merges) or any(born.get(int(t), -1) >= r for side in (self.left, self.right) for r, t in enumerate(side)):
            raise ValueError("merging all positions of a rank at once needs merges that only use earlier ones")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        """Empty the cache of encoded words."""
        self.codes = [i.to_bytes(4, "little") for i in self.special.values()]
        self.place: dict[str | int, int] = {i: k for k, i in enumerate(self.special.values())}
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none merges it."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1 if len(raw) else 0
        sym = self.of_byte[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
        sym[ends] = -1  # a barrier after each word
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Enter positions under their ranks."""
            keep = ranks >= 0
            positions, ranks = positions[keep], ranks[keep]
            if not len(ranks):
                return
            by = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by], ranks[by]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ranks)], strict=True):
                r = int(ranks[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions[a:b])

        if n > 1:
            note(np.arange(n - 1, dtype=np.int32), self.ranks(sym[:-1], sym[1:]))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            p = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            left, right, made = int(self.left[r]), int(self.right[r]), int(self.made[r])
            p = p[sym[p] == left]
            p = p[sym[nxt[p]] == right]
            if left == right and len(p) > 1:  # of overlapping pairs, every second from the left
                p = np.unique(p)
                first = np.concatenate([[True], nxt[p[:-1]] != p[1:]])
                start = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
                p = p[(np.arange(len(p)) - start) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q] = made, -2
            nxt[p], prv[after] = after, p
            before = prv[p]
            inside = before >= 0
            before = before[inside]
            here = np.concatenate([before, p])
            note(here, self.ranks(sym[here], sym[nxt[here]]))
        alive = sym >= 0
        out = sym[alive].astype("<u4").tobytes()
        upto = (np.cumsum(alive)[ends] * 4).tolist() if n else []
        return [out[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def split(self, text: str) -> list[str]:
        return splitter(sys.maxunicode if not text.isascii() and ASTRAL.search(text) else 0xFFFF).findall(text)

    def encode_batch(self, texts: list[str | None], together: int = 6_000_000) -> list[bytes]:
        """The ids of each text; the new words of about ``together`` characters of text are encoded at once."""
        out: list[bytes] = []
        rows: list[np.ndarray] = []
        held = 0
        for t in texts:
            if t and self.cut and self.cut.search(t):
                row: list[str | int] = []
                for i, x in enumerate(self.cut.split(t)):
                    row.extend([self.special[x]] if i % 2 else self.split(x))
                rows.append(self._places(row))
            else:
                rows.append(self._places(self.split(t) if t else []))
            held += len(t or "")
            if held >= together:
                out.extend(self._encode_rows(rows))
                rows, held = [], 0
        return out + self._encode_rows(rows)

    def _places(self, row: list[str | int]) -> np.ndarray:
        """Places of words in the cache; new ones get the next places, and their codes with the batch."""
        place = self.place
        found = list(map(place.get, row))
        if None in found:
            for w in set(row).difference(place):
                place[w] = len(place)
                self.held += 160 + 6 * len(w)
            found = list(map(place.__getitem__, row))
        return np.array(found, np.int32)

    def _encode_rows(self, rows: list[np.ndarray]) -> list[bytes]:
        new = list(itertools.islice(self.place, len(self.codes), None))
        for a, b in self._slices(new):
            self.codes.extend(self.encode_words(new[a:b]))
        get = self.codes.__getitem__
        out = [b"".join(map(get, row.tolist())) for row in rows]
        if self.held > self.kept:
            self.forget()
        return out

    @staticmethod
    def _slices(words: list[str], most: int = 1 << 24) -> list[tuple[int, int]]:
        """Runs of words of about ``most`` characters, to bound the arrays; a longer word stands alone."""
        out, start, held = [], 0, 0
        for i, w in enumerate(words):
            held += len(w)
            if held > most:
                out.append((start, i + 1))
                start, held = i + 1, 0
        return [*out, (start, len(words))] if start < len(words) else out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        at = np.frombuffer(ids, "<u4")
        sizes = self.length[at]
        shift = self.start[at] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes().decode("utf-8", "replace")


def load_spec(spark: SparkSession, path: str):
    """The tokenizer file, read on the driver and broadcast (a vocabulary, about 1.5 MB whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@cache
def encoder(spec: str) -> PairIndexEncoder:
    """One encoder a Python worker: tasks that follow in the same worker reuse its table, but not its word cache."""
    return PairIndexEncoder(spec)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, token_ids array<int> of each row; duplicate rows are kept, null texts get an empty list."""
    spec = load_spec(docs.sparkSession, path)

    def make():
        enc = encoder(spec.value)

        def step(keys, texts):
            return {key: keys, "token_ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in enc.encode_batch(texts)]}

        step.close = enc.forget
        return step

    return map_texts(docs, [key, text], make, f"{key} {docs.schema[key].dataType.simpleString()}, token_ids array<int>")


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """key, text of each row of token ids."""
    spec = load_spec(tokens.sparkSession, path)

    def make():
        enc = encoder(spec.value)
        return lambda keys, rows: {key: keys, "text": [enc.decode(np.array(x or [], "<u4").tobytes()) for x in rows]}

    return map_texts(tokens, [key, ids], make, f"{key} {tokens.schema[key].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked: encode, then decode those ids, in one pass."""
    spec = load_spec(docs.sparkSession, path)

    def make():
        enc = encoder(spec.value)

        def step(keys, texts):
            rows = enc.encode_batch(texts)
            return {
                "doc_id": keys,
                "n_tokens": [len(x) // 4 for x in rows],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in rows],
                "decoded_sha256": [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in rows],
            } | ({"token_ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in rows]} if with_ids else {})

        step.close = enc.forget
        return step

    return map_texts(docs, ["doc_id", "text"], make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)

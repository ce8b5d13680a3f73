"""Cross-entropy difference of a target and a background bigram model.

Both models are counted over all documents (the target over the rows flagged as such) and share
one vocabulary: every word of the corpus, and one unknown word. Unigrams are smoothed by
``alpha``; a bigram's probability is its count, with ``mass`` pseudo-counts spread as the unigrams
are, over the count of its context. No word and no bigram is cut, so both grow with the corpus.

The documents are tokenised into chunks of about ``chunk`` tokens. Each chunk counts its words,
contexts and bigrams by key, and sends them, packed, to as many buckets of the key space as the
corpus needs for each to stay small. A bucket adds up what it gets and answers each chunk with the
sums, in the order of the chunk's keys. A chunk is then scored with the sums of its own keys alone:
neither driver nor executor ever holds the model. Keys are 63-bit hashes; a collision, about
five expected among 10^10 keys, adds two counts up.
A token's loss is -ln p; a document's score is its mean loss under the target less its mean loss
under the background, so the lower, the more it is like the target.

Defined results: null and empty texts have no tokens, losses of 0 and difference 0. Without target
rows both models are the smoothed vocabulary, the target's a uniform one.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dropped_shuffles, hash_bits, map_texts, may_occur

ALPHA = 0.5
MASS = 20.0
CHUNK = 2_000_000
CHUNK_ROWS = 20_000
BUCKET = 1_000_000  # tokens of the corpus for each bucket of keys
BITS = 23
_CONTEXT, _PAIR, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(r"\w+")


class WordHashes:
    """64-bit hashes of a text's lower-case words; one bounded cache a task."""

    def __init__(self, kept: int = 500_000):
        self.seen: dict[str, int] = {}
        self.kept = kept

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.seen) > self.kept:
            self.seen = {}
        seen, words = self.seen, _WORD.findall(text.lower()) if text else []
        out = list(map(seen.get, words))
        if None in out:
            for w in set(words).difference(seen):
                seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out = list(map(seen.__getitem__, words))
        return np.array(out, np.uint64)


def ids_of(hashes: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary; its length for the unknown word."""
    at = np.searchsorted(vocab, hashes)
    if not len(vocab):
        return np.zeros(len(hashes), np.int64)
    return np.where(vocab[np.minimum(at, len(vocab) - 1)] == hashes, at, len(vocab)).astype(np.int64)


def pair_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """Key of each token's bigram; the first token's context is the start mark, ``size``."""
    if not len(ids):
        return ids
    return np.concatenate([[size], ids[:-1]]) * (size + 1) + ids


def counted(keys: list[np.ndarray], flags: list[bool], kind) -> dict:
    """Distinct keys of a batch with their counts over all rows and over the flagged rows."""
    every = np.concatenate(keys) if keys else np.zeros(0, kind)
    target = np.repeat(np.array(flags, bool), [len(k) for k in keys]) if keys else np.zeros(0, bool)
    found, back = np.unique(every, return_inverse=True)
    return {"k": pa.array(found.view(np.int64)), "n": pa.array(np.bincount(back, minlength=len(found)).astype(np.int64)), "t": pa.array(np.bincount(back[target], minlength=len(found)).astype(np.int64))}


def totals(flagged: DataFrame, make) -> DataFrame:
    """k, n, t summed over the corpus."""
    return map_texts(flagged, ["text", "target"], make, "k long, n long, t long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


class PairModels:
    """Target and background over one vocabulary, in memory: for small corpora, and for single texts."""

    def __init__(self, vocab, uni, context, keys, pair):
        self.vocab, self.uni, self.context, self.keys, self.pair = vocab, uni, context, keys, pair

    @classmethod
    def build(cls, vocab, counts, size_all, size_target, pairs, alpha, mass):
        """counts: (words, 2) background and target; pairs: keys and their (n, 2) counts."""
        v = len(vocab)
        sums = np.array([size_all, size_target], float)
        full = np.vstack([counts, np.maximum(sums - counts.sum(axis=0), 0)])  # the last row is the unknown word
        uni = (full + alpha) / (sums + alpha * (v + 1))
        keys, n = pairs
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(float)
        of, word = keys // (v + 2), keys % (v + 2)
        seen = np.stack([np.bincount(of, n[:, j], v + 2) for j in (0, 1)], axis=1)
        pair = np.log((n + mass * uni[word]) / (seen[of] + mass))
        return cls(vocab, np.log(uni).astype(np.float32), np.log(mass / (seen + mass)).astype(np.float32), keys, pair.astype(np.float32))

    def losses(self, hashes: np.ndarray) -> tuple[int, float, float]:
        """Tokens, and mean losses under the target and the background."""
        if not len(hashes):
            return 0, 0.0, 0.0
        ids = ids_of(hashes, self.vocab)
        keys = pair_keys(ids, len(self.vocab) + 1)
        log_p = self.uni[ids] + self.context[np.concatenate([[len(self.vocab) + 1], ids[:-1]])]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            log_p[known] = self.pair[at[known]]
        mean = log_p.mean(axis=0, dtype=np.float64)
        return len(ids), -float(mean[1]), -float(mean[0])


def fit(flagged: DataFrame, rare: float = 0.0, rare_pair: float = 0.0, alpha: float = ALPHA, mass: float = MASS) -> PairModels:
    """Count words, then bigrams of the vocabulary, over every row of ``flagged`` (text, target boolean), into memory.

    Words and bigrams of a lower relative frequency than ``rare`` and ``rare_pair`` may be left out.
    """
    spark = flagged.sparkSession

    def words():
        hashes = WordHashes()
        return lambda texts, flags: counted([hashes(t) for t in texts], flags, np.uint64)

    scratch = Scratch(spark, "lmscore")
    uni = scratch.keep("words", totals(flagged, words))
    n, t = (float(x or 0) for x in uni.agg(F.sum("n"), F.sum("t")).first())
    kept = uni.where(F.col("n") >= rare * n).toArrow() if n else uni.limit(0).toArrow()
    vocab, counts = kept["k"].to_numpy().view(np.uint64), np.stack([kept["n"].to_numpy(), kept["t"].to_numpy()], axis=1)
    order = np.argsort(vocab)
    vocab, counts = vocab[order], counts[order].astype(float)
    shared = spark.sparkContext.broadcast(vocab)

    def pairs():
        hashes = WordHashes()
        return lambda texts, flags: counted([pair_keys(ids_of(hashes(x), shared.value), len(shared.value) + 1) for x in texts], flags, np.int64)

    with dropped_shuffles(spark):
        both = totals(flagged, pairs).where(F.col("n") >= rare_pair * n).toArrow()
    scratch.drop("words")
    pair_counts = np.stack([both["n"].to_numpy(), both["t"].to_numpy()], axis=1)
    return PairModels.build(vocab, counts, n, t, (both["k"].to_numpy(), pair_counts), alpha, mass)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(x: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view(kind).ravel()


class Chunk:
    """Words, contexts and bigrams of some documents, by key, with counts over all of them and over the flagged ones.

    The keys of words are odd, all others even.
    """

    def __init__(self, tokens: list[bytes], flags: list[bool]):
        docs = [np.frombuffer(t, np.uint64) for t in tokens]
        self.size = np.array([len(d) for d in docs], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *docs])
        target = np.repeat(np.array(flags, bool), self.size)
        words, at = np.unique(every, return_inverse=True)
        opens = np.zeros(len(every), bool)
        opens[(np.cumsum(self.size) - self.size)[self.size > 0]] = True
        before = np.where(opens, len(words), np.roll(at, 1))  # len(words) is the start mark
        pairs, self.at = np.unique(before * (len(words) + 1) + at, return_inverse=True)
        self.context, self.word = pairs // (len(words) + 1), pairs % (len(words) + 1)
        marked, odd = np.append(words, np.uint64(0)), np.uint64(1)
        first = mixed(marked[self.context] + np.where(self.context == len(words), _CONTEXT, odd))
        keys = [words | odd, mixed(words ^ _CONTEXT) & ~odd, mixed(first * _PAIR + marked[self.word]) & ~odd]
        self.starts = np.cumsum([0] + [len(k) for k in keys])
        keys = np.concatenate(keys)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        inner = before < len(words)
        places = [(at, target, len(words)), (before[inner], target[inner], len(words)), (self.at, target, len(pairs))]
        self.counts = np.concatenate([np.stack([np.bincount(x, minlength=m), np.bincount(x[f], minlength=m)]) for x, f, m in places], axis=1)

    def cuts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that the keys fall into, and where each begins and the last ends."""
        of = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        some, first = np.unique(of, return_index=True)
        return some.astype(np.int64), np.append(first, len(of))

    def sent(self, chunk: int, part: int, buckets: int) -> pa.RecordBatch:
        """bucket, chunk, part, size, keys, counts: one row for each bucket."""
        some, cut = self.cuts(buckets)
        counts, spans = self.counts[:, self.order], list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        return pa.RecordBatch.from_pydict({
            "bucket": some,
            "chunk": np.full(len(some), chunk),
            "part": np.full(len(some), part),
            "size": np.diff(cut).astype(np.int64),
            "keys": pa.array([packed(np.diff(self.keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
            "counts": pa.array([packed(np.ascontiguousarray(counts[:, a:b]).ravel()) for a, b in spans], pa.binary()),
        })

    def losses(self, sums: list[np.ndarray], corpus: np.ndarray, vocab: int, alpha: float, mass: float) -> np.ndarray:
        """Mean losses of each document under background and target, given the sums over the corpus by bucket.

        ``corpus`` has the tokens and the non-empty documents of both.
        """
        counts = np.zeros((len(self.keys), 2))
        counts[self.order] = np.concatenate([np.zeros((0, 2)), *sums])
        word, context, pair = (counts[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True))
        uni = (word + alpha) / (corpus[0] + alpha * (vocab + 1))
        seen = np.vstack([context, corpus[1]])
        loss = (np.log(seen[self.context] + mass) - np.log(pair + mass * uni[self.word]))[self.at]
        doc = np.repeat(np.arange(len(self.size)), self.size)
        return np.stack([np.bincount(doc, loss[:, j], len(self.size)) / np.maximum(self.size, 1) for j in (0, 1)], axis=1)


def chunked(flagged: DataFrame, chunk: int) -> DataFrame:
    """chunk, place, doc_id, target, n_tokens, tokens of each row of ``flagged`` (doc_id, text, target): word hashes, and places in chunks of any rows in turn."""

    def make():
        hashes, name, tokens, rows = WordHashes(), uuid.uuid4().int >> 65, 0, 0

        def step(ids, texts, flags):
            nonlocal name, tokens, rows
            found, names, places = [hashes(t) for t in texts], [], []
            for x in found:
                if rows and (tokens + len(x) > chunk or rows == CHUNK_ROWS):
                    name, tokens, rows = uuid.uuid4().int >> 65, 0, 0
                names.append(name)
                places.append(rows)
                tokens, rows = tokens + len(x), rows + 1
            return {"chunk": names, "place": places, "doc_id": ids, "target": flags, "n_tokens": [len(x) for x in found], "tokens": [x.tobytes() for x in found]}

        return step

    return map_texts(flagged, ["doc_id", "text", "target"], make, f"chunk long, place long, doc_id {flagged.schema['doc_id'].dataType.simpleString()}, target boolean, n_tokens long, tokens binary")


def parts(batches):
    """chunk, first place, tokens and flags of neighbouring rows of one chunk; one that a file's split cuts comes in parts."""
    name, last, first, tokens, flags = None, -1, 0, [], []
    for b in batches:
        for c, p, t, f in zip(*(b.column(x).to_pylist() for x in ("chunk", "place", "tokens", "target")), strict=True):
            if (c, p) != (name, last + 1):
                if tokens:
                    yield name, first, tokens, flags
                name, first, tokens, flags = c, p, [], []
            last = p
            tokens.append(t)
            flags.append(f)
    if tokens:
        yield name, first, tokens, flags


def sums_by_chunk(texts: DataFrame, buckets: int) -> DataFrame:
    """chunk, part, bucket, size, sums, words: the sums over the corpus for each part's keys, and in one row a bucket its distinct words."""

    def send(batches):
        for name, first, tokens, flags in parts(batches):
            yield Chunk(tokens, flags).sent(name, first, buckets)

    def add_up(rows: pa.Table) -> pa.Table:
        sizes = rows["size"].to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x, n, np.uint64), dtype=np.uint64) for x, n in zip(rows["keys"].to_pylist(), sizes, strict=True)])
        counts = np.concatenate([unpacked(x, 2 * n, np.int64).reshape(2, n) for x, n in zip(rows["counts"].to_pylist(), sizes, strict=True)], axis=1)
        found, at = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(at, c, len(found)).astype(np.int64) for c in counts])[:, at]
        ends = np.cumsum(sizes)
        out = [packed(np.ascontiguousarray(sums[:, e - n : e]).ravel()) for e, n in zip(ends, sizes, strict=True)]
        words = np.zeros(len(sizes), np.int64)
        words[0] = np.count_nonzero(found & np.uint64(1))
        return pa.table({"chunk": rows["chunk"], "part": rows["part"], "bucket": rows["bucket"], "size": rows["size"], "sums": pa.array(out, pa.binary()), "words": words})

    sent = texts.select("chunk", "place", "tokens", "target").mapInArrow(send, "bucket long, chunk long, part long, size long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add_up, "chunk long, part long, bucket long, size long, sums binary, words long")


def score(flagged: DataFrame, alpha: float = ALPHA, mass: float = MASS, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference of each row of ``flagged`` (doc_id, text, target), which the models are counted over."""
    scratch = Scratch(flagged.sparkSession, "lmscore")
    texts = scratch.keep("texts", chunked(flagged, chunk))
    some = F.col("n_tokens") > 0
    corpus = texts.agg(F.sum("n_tokens"), F.sum(F.when(F.col("target"), F.col("n_tokens"))), F.count_if(some), F.count_if(some & F.col("target"))).first()
    corpus = np.array([float(x or 0) for x in corpus]).reshape(2, 2)
    sums = scratch.keep("sums", sums_by_chunk(texts, 1 + int(corpus[0, 0]) // bucket))
    vocab = sums.agg(F.sum("words")).first()[0] or 0
    schema = flagged.sparkSession.createDataFrame([], f"doc_id {flagged.schema['doc_id'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, difference double").schema

    def step(docs: pa.Table, sums: pa.Table) -> pa.Table:
        docs, sums = docs.sort_by("place"), sums.sort_by([("part", "ascending"), ("bucket", "ascending")])
        got = [unpacked(x, 2 * n, np.int64).reshape(2, n).T for x, n in zip(sums["sums"].to_pylist(), sums["size"].to_pylist(), strict=True)]
        of, place = sums["part"].to_numpy(), docs["place"].to_numpy()
        cut = [0, *np.searchsorted(place, np.unique(of)).tolist()[1:], len(place)]  # parts without a token have no sums
        tokens, flags, out = docs["tokens"].to_pylist(), docs["target"].to_pylist(), []
        for first, (a, b) in zip(np.unique(of).tolist() or [0], zip(cut[:-1], cut[1:], strict=True), strict=True):
            mine = [got[i] for i in np.flatnonzero(of == first)]
            out.append(Chunk(tokens[a:b], flags[a:b]).losses(mine, corpus, vocab, alpha, mass))
        back, target = np.concatenate(out).T
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": docs["n_tokens"], "target_loss": target, "background_loss": back, "difference": target - back})

    texts = texts.select("chunk", "place", "doc_id", "target", "n_tokens", "tokens")
    return texts.groupBy("chunk").cogroup(sums.drop("words").groupBy("chunk")).applyInArrow(step, schema)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, **settings) -> DataFrame:
    """Score every row of ``docs``; the target are the rows whose doc_id is in ``target_ids``.

    Only texts that may be of the target, by a fixed-size bitmap, meet the ids in a join, which is
    exact. The ids grow with the corpus, so they are merged, never broadcast, at any size.
    """
    chosen = target_ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).where("doc_id is not null").distinct()
    scratch = Scratch(docs.sparkSession, "lmtarget")
    bits = scratch.keep("bits", hash_bits(chosen.select(F.xxhash64("doc_id").alias("h")), BITS))
    may = may_occur(F.xxhash64("doc_id"), bits, BITS) & F.col("doc_id").isNotNull()
    texts = docs.select("doc_id", "text")
    marked = texts.where(may).join(chosen.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    flagged = texts.where(~may).select("doc_id", "text", F.lit(False).alias("target")).union(marked.select("doc_id", "text", F.coalesce("target", F.lit(False))))
    return score(flagged, **settings)

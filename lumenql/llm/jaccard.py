"""Exact Jaccard join on word-shingle sets by universe partition and the pigeonhole principle.

Sets are banded by size so that similar sets lie in one band or in neighbouring ones; a set signs
its own band and, if it may have partners there, the next. Within a band two similar sets differ in
at most H tokens. Tokens are hashed into m = H + 1 + s segments. A set of n tokens differs from its
own partners in h <= H tokens, so of the first h + 1 + s segments at least s + 1 agree wholly, and a
signature of each one of these with two tokens or more finds every pair of which one set has at most
s lighter ones: a set signs by its own size, not by the band's greatest.
Light segments are not signed so: empty ones agree among strangers, and those of one token agree
wherever two texts share a phrase, ever more often as the corpus grows. Sets with more of them are
rare; among themselves they are found by one-deletion neighbourhoods of all their segments (two subsets
that differ by one token share a key), and the emptiest also by the tokens of a prefix, which closes
the last gap. The split of the budget between whole segments and one-deletions is chosen a band by
cost: s minimises the expected number of signatures.

Equal sets are one class first, by 128-bit set hashes, however many copies there are. Signatures
are sorted within hash partitions and read as a stream; only shared ones go on. The members of a
bucket are compared with the one of the highest standing (the size of all its buckets), which in a
group of edited copies is the original, for a few rounds of components. Then every pair of a bucket
that is still in different components is compared, behind a filter inside the join: sizes, and
1,024-bit parity sketches that bound the difference of two sets from below. Only classes of a pair
that passes this filter have their whole sets fetched, and the pair is verified on these. So no pair
inside a component is ever built, and none is missed.

Defined results: the empty set (null, empty or blank text) links with nothing. Null ids are never
a component's name; a null-id row that links with no other has a null component. Repeated rows are
copies like any other. Fewer words than a shingle has make one shingle of the whole sequence.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bits_for, hash_bits, map_texts, may_occur, released

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_STAR_ROUNDS = 3
SKETCH = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base, as many as the longest word so far needs."""

    def __init__(self):
        self.at = np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.at):
            self.at = np.full(2 * n, _B, np.uint64)
            self.at[0] = 1
            self.at = np.cumprod(self.at, dtype=np.uint64)
        return self.at


_POWERS = Powers()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower changes A-Z only
    blank = _BLANK[raw]
    inside = ~blank
    first = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(inside & np.concatenate([blank[1:], [True]]))
    size = last - first + 1
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    words = mix(np.add.reduceat(_BYTE[raw[inside]] * _POWERS.upto(int(size.max()))[place], start) + size.astype(np.uint64) * _A)
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = h * _B + words[k : k + n]
    return np.unique(mix(h + np.uint64(min(width, len(words)))))


def set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(np.sum(mix(x + _A)).view(np.int64)), int(np.sum(mix(x ^ _B) ^ (x >> np.uint64(7))).view(np.int64))


def class_key(x: np.ndarray) -> int:
    a, b = set_key(x)
    return int(mix(np.array([a & (2**64 - 1)], np.uint64) * _B + np.array([b & (2**64 - 1)], np.uint64) + np.uint64(len(x)))[0].view(np.int64))


class Bands:
    """Size bands and their segment counts for links of 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // self.percent)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def apart(self, n: int, k: int) -> int:
        """The most tokens in which a set of n tokens differs from a similar one, if neither is above band k."""
        return (n + min(self.low[k + 1] - 1, n * 100 // self.percent)) * (100 - self.percent) // (100 + self.percent)

    @cache  # noqa: B019 - one object a process
    def shape(self, k: int) -> tuple[int, int]:
        """H, the largest difference of two similar sets of at most the band's size, and the spare segments s."""
        while len(self.low) < k + 2:
            self.band(self.low[-1])
        low, high = self.low[k], self.low[k + 1] - 1
        most = 2 * high * (100 - self.percent) // (100 + self.percent)
        sizes = {max(1, low * self.percent // 100), max(1, low * (100 + self.percent) // 200), low, (low + high) // 2, high}
        factor = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 3)))])  # logarithms of factorials

        def cost(s: int) -> float:
            """Expected signatures a token over the sizes that sign the band: segments, and deletions where too many are light."""
            total, m, i = 0.0, most + 1 + s, np.arange(s + 1)
            for n in sizes:
                signed = self.apart(n, k) + 1 + s
                light = signed * ((1 - 1 / m) ** n + n / m * (1 - 1 / m) ** (n - 1))
                fewer = float(np.exp(-light + i * math.log(max(light, 1e-12)) - factor[: s + 1]).sum())
                total += (signed - light + max(0.0, 1 - fewer) * 1.3 * n) / n
            return total

        tries = sorted({min(most + 1, max(j + 1, int(1.15**j))) for j in range(90)})
        return most, min(tries, key=cost)


def segment_keys(x: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """All signatures of a set in a band."""
    most, spare = bands.shape(band)
    apart = bands.apart(len(x), band)
    if apart == 0:
        return np.zeros(0, np.uint64)  # only equal sets can link, and those are one class
    m, signed, salt = most + 1 + spare, apart + 1 + spare, np.uint64((band * 0x10001 + 1) * int(_A) % 2**64)
    token = mix(x ^ salt)
    part = ((token >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part, token = part[order], mix(token[order] + _C)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(token, starts)
    label = mix(part[starts] + salt)
    size = np.diff(np.append(starts, len(part)))
    whole = (size > 1) & (part[starts] < signed)
    out = [mix(sums[whole] ^ label[whole])]
    if signed - np.count_nonzero(whole) > spare:
        deep = label ^ _B
        shorter = np.repeat(sums, size) - token
        out += [mix(sums ^ deep), mix(shorter ^ np.repeat(deep, size))[np.repeat(size, size) > 1]]
        if m - len(starts) >= spare + 2:
            keep = len(x) - -(-len(x) * bands.percent // 100) + 1
            out.append(mix(x[:keep] ^ (salt ^ np.uint64(2))))
    return np.unique(np.concatenate(out))


def signatures(x: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set in its own band and in the next, where larger partners are."""
    if not len(x):
        return np.zeros(0, np.uint64)
    k = bands.band(len(x))
    last = bands.band(len(x) * 100 // bands.percent)
    return np.concatenate([segment_keys(x, j, bands) for j in range(k, last + 1)])


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of the token counts in SKETCH hash buckets: two sketches differ in no more bits than the sets differ in tokens."""
    odd = np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, cid: the class of equal sets; the set's sketch; h: the text's hash."""

    def make():
        def step(ids, texts, hashes):
            sets = [shingles(t, width) for t in texts]
            return {"doc_id": ids, "n_shingles": [len(x) for x in sets], "cid": [class_key(x) for x in sets], "sketch": [sketch(x) for x in sets], "h": hashes}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), ["doc_id", "text", "h"], make, f"doc_id {kind}, n_shingles long, cid long, sketch array<long>, h long")


def buckets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """sig, cid for the signatures that two classes or more have."""

    def make():
        bands, done = Bands(percent), set()

        def step(texts):
            sigs, cids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for t in texts:
                x = shingles(t, width)
                cid = class_key(x)
                if cid in done:
                    continue
                if len(done) > 100_000:
                    done.clear()
                done.add(cid)
                s = signatures(x, bands)
                sigs.append(s)
                cids.append(np.full(len(s), cid, np.int64))
            return {"sig": pa.array(np.concatenate(sigs).view(np.int64)), "cid": pa.array(np.concatenate(cids))}

        return step

    signed = map_texts(docs, ["text"], make, "sig long, cid long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches):
        held = np.zeros((2, 0), np.int64)
        shared: int | None = None  # signature of the run that the last batch ended in, if its classes were shown

        def shown(rows: np.ndarray, final: bool):
            nonlocal shared
            sig, cid = rows
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])])
            sig, cid = sig[new], cid[new]
            opens = np.concatenate([[True], sig[1:] != sig[:-1]])
            first = np.maximum.accumulate(np.where(opens, np.arange(len(sig)), 0))
            size = np.bincount(first, minlength=len(sig))[first]
            out = (size > 1) | (sig == shared if shared is not None else False)
            back = (sig == sig[-1]) & ~out if not final else np.zeros(len(sig), bool)  # a lone last row may have company in the next batch
            shared = int(sig[-1]) if out[-1] else None
            return pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(cid[out])], ["sig", "cid"]), np.stack([sig[back], cid[back]])

        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])], axis=1)
            if rows.shape[1]:
                got, held = shown(rows, False)
                yield got
        if held.shape[1]:
            yield shown(held, True)[0]
        held = rows = got = b = None
        released()

    return signed.repartition(n, "sig").sortWithinPartitions("sig", "cid").mapInArrow(runs, "sig long, cid long")


def token_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cid, tokens for the classes in ``wanted`` (cid, h), where h is the hash of one of the class's texts.

    A bitmap of the hashes spares most texts the way to Python; the join behind it is exact.
    """
    bits = bits_for(wanted.count())
    texts = docs.select("text", F.xxhash64("text").alias("h")).where(may_occur(F.col("h"), hash_bits(wanted.select("h"), bits), bits))

    def make():
        done: set[int] = set()

        def step(texts, hashes):
            cids, sets = [], []
            for t, h in zip(texts, hashes, strict=True):
                if h not in done:
                    if len(done) > 100_000:
                        done.clear()
                    done.add(h)
                    x = shingles(t, width)
                    cids.append(class_key(x))
                    sets.append(x.view(np.int64))
            return {"cid": cids, "tokens": sets}

        return step

    found = map_texts(texts, ["text", "h"], make, "cid long, tokens array<long>").join(wanted.select("cid").hint("merge"), "cid", "left_semi")
    return found.dropDuplicates(["cid"])


def may_link(n: tuple[Column, Column], sketch: tuple[Column, Column], percent: int) -> Column:
    """What sizes and sketches allow; false only for pairs that cannot link."""
    apart = reduce(add, (F.bit_count(sketch[0][i].bitwiseXOR(sketch[1][i])) for i in range(SKETCH // 64)))
    near = F.least(*n) * 100 >= F.greatest(*n) * percent
    return near & (apart * (100 + percent) <= (n[0] + n[1]) * (100 - percent))


def promising(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    known = outlines.select("cid", "n", "sketch")
    left, right = known.toDF("a", "n_a", "sketch_a"), known.toDF("b", "n_b", "sketch_b")
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(may_link((F.col("n_a"), F.col("n_b")), (F.col("sketch_a"), F.col("sketch_b")), percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Sets and pairs grow with the corpus: merged, never broadcast, at any size."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.hint("merge").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """cid, comp: the least class reachable over edges (a, b), by least neighbours and pointer jumps."""
    both = scratch.keep(f"{name}-edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("cid"), F.least("a", "b").alias("comp"))
    labels = scratch.keep(f"{name}-comp", labels)
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["cid"] == near["a"]).select("cid", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("over"))
        step = scratch.keep(f"{name}-step", step.join(jump, "comp", "left").select("cid", "was", F.least("comp", F.coalesce("over", "comp")).alias("comp")))
        moved = not step.where("comp < was").isEmpty()
        labels = scratch.keep(f"{name}-comp", step.select("cid", "comp"))
        if not moved:
            scratch.drop(f"{name}-edges", f"{name}-step")
            return labels


def linked(docs: DataFrame, rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """cid, comp for all classes of ``rows`` that link with another one; None if there are none."""
    found = scratch.keep("buckets", buckets(docs, width, percent))
    if found.isEmpty():
        return None
    slim = found.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("who"))
    slim = slim.groupBy("n", "who").agg(F.min("sig").alias("sig")).select("sig", "n")  # buckets of the same members say the same
    members = scratch.keep("plain", found.join(slim, "sig"))
    scratch.drop("buckets")
    standing = members.groupBy("cid").agg(F.sum("n").alias("standing"))  # an original shares more with its edited copies than they do with each other
    known = rows.select("cid", F.col("n_shingles").alias("n"), "sketch", "h").dropDuplicates(["cid"])
    outlines = scratch.keep("outlines", known.join(standing.select("cid"), "cid", "left_semi"))
    members = scratch.keep("members", members.join(standing, "cid").select("sig", "n", "cid", "standing"))
    scratch.drop("plain")
    labels, edges, tried, sets = None, None, None, None
    for k in range(_STAR_ROUNDS + 1):
        left = members.drop("n") if k == 0 else members.where("n > 2").drop("n")  # two members have been compared
        marked = left.withColumn("comp", F.col("cid")) if labels is None else left.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        mixed = marked.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("cid", "standing").alias("head"), F.max_by("comp", "standing").alias("main")).where("low < high").drop("low", "high")
        mixed = scratch.keep("mixed", mixed)  # written, so that adaptive execution can split the joins with hot buckets
        if k < _STAR_ROUNDS:  # all members against the bucket's member of the highest standing
            rest = marked.join(mixed.select("sig", "head", "main"), "sig").where("comp <> main")
            pairs = rest.select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).distinct()
        else:  # all that is still apart and that sizes and sketches allow
            apart = marked.join(mixed.select("sig"), "sig").join(outlines, "cid").select("sig", "cid", "comp", "n", "sketch")
            apart = scratch.keep("apart", apart)
            one, other = apart.toDF("sig", "a", "comp_a", "n_a", "sketch_a"), apart.toDF("sig", "b", "comp_b", "n_b", "sketch_b")
            pairs = one.join(other, (one["sig"] == other["sig"]) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & may_link((F.col("n_a"), F.col("n_b")), (F.col("sketch_a"), F.col("sketch_b")), percent)).select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        fresh = scratch.keep("fresh", pairs if k == _STAR_ROUNDS else promising(pairs, outlines, percent))
        need = fresh.select(F.col("a").alias("cid")).union(fresh.select("b")).distinct()
        need = need if sets is None else need.join(sets.select("cid"), "cid", "left_anti")
        need = scratch.keep("need", need.join(outlines.select("cid", "h"), "cid"))
        if not need.isEmpty():
            more = scratch.keep(f"sets-{k}", token_sets(docs, need, width))
            sets = more if sets is None else sets.union(more)
        if sets is None:
            continue  # no pair so far
        new = scratch.keep("new", verified(fresh, sets, percent))
        tried = scratch.keep("tried", fresh if tried is None else tried.union(fresh))
        if not new.isEmpty():
            edges = scratch.keep("edges", new if edges is None else edges.union(new))
            labels = components(edges, scratch, "round")
    scratch.drop("members", "outlines", "need", "tried", "apart", "fresh", "new", "edges", "mixed", *(f"sets-{k}" for k in range(_STAR_ROUNDS + 1)))
    return labels


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.keep("classes", classes(docs, width))
    labels = linked(docs, rows, width, percent, scratch)
    rows = rows.drop("sketch", "h")
    if labels is None:
        rows = rows.withColumn("comp", F.col("cid"))
    else:
        rows = rows.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    names = scratch.keep("names", rows.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("name")))  # written: the join with a large component can be split
    out = rows.join(names, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))

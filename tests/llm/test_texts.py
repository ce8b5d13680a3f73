"""Operators on one text at a time, against plain versions, libraries and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenql.llm import bpe, decontaminate, langid, quality, queries, repetition, toxicity, wordpiece
from lumenql.llm.common import fold, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def byte_bpe():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return bpe.PairIndexEncoder(f.read()), tokenizers.Tokenizer.from_file(path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab  's\n<|>endoftext")), max_size=60), max_size=6))
def test_bpe_like_the_library(byte_bpe, texts):
    mine, library = byte_bpe
    for text, ids in zip(texts, mine.encode_batch([t + "<|endoftext|>aaaa" for t in texts]), strict=True):
        want = library.encode(text + "<|endoftext|>aaaa", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, byte_bpe):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = queries.op1_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows[:300]:
        ids = byte_bpe[1].encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_bpe_awkward(spark, awkward, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(awkward, path), path)
    assert sorted((repr(r[0]), r[1]) for r in back.collect()) == sorted((repr(r[0]), r[1] or "") for r in awkward.select("doc_id", "text").collect())
    assert bpe.digest(empty, path).count() == 0


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    rows = queries.op2_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_mixture(spark):
    model = langid.fit(table(spark, SF, "documents"))
    by = {r["lang"]: r["text"] for r in table(spark, SF, "documents").where("n_chars > 3000").collect()}
    found = dict(model.infer(by["en"][:1500] + "\n" + by["de"][:1500]))
    assert set(found) == {"en", "de"} and all(0.3 < v < 0.7 for v in found.values())
    assert [k for k, _ in model.infer(by["fr"])] == ["fr"] and model.infer("12 ?!") == [] and model.infer(None) == []


def test_language_awkward(spark, awkward, empty):
    rows = langid.identify(awkward, fold(F.col("doc_id"), 3) == 1).collect()
    assert len(rows) == awkward.count() and {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2, 9)) for r in rows)
    assert langid.identify(empty, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


def test_language_of_many_parts():
    """All five languages of a text are found, and only those; one alone stays alone."""
    rng = np.random.default_rng(2)
    alphabets = {n: "abcdefghijklmnopqrstuvwxyz"[3 * i : 3 * i + 3] for i, n in enumerate(["one", "two", "three", "four", "five", "six"])}
    text = {n: " ".join("".join(rng.choice(list(x), 5)) for _ in range(80)) for n, x in alphabets.items()}
    counts = np.stack([np.bincount(langid.grams(t), minlength=langid.BUCKETS) for t in text.values()]) + 0.1
    model = langid.MixtureModel(list(text), np.log(counts / counts.sum(axis=1, keepdims=True)))
    for n in (1, 2, 4, 5):
        some = list(text)[:n]
        found = dict(model.infer(" ".join(text[k] for k in some)))
        assert set(found) == set(some) and all(abs(v - 1 / n) < 0.05 for v in found.values())


def test_word_pieces_against_greedy():
    automaton = wordpiece.Automaton(["a", "ab", "abc", "x"], ["b", "c", "bc", "cd", "d", "ab"])

    def greedy(word):
        first, other, at, n = {"a", "ab", "abc", "x"}, {"b", "c", "bc", "cd", "d", "ab"}, 0, 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (other if at else first)), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    import itertools

    for n in range(1, 7):
        for w in itertools.product("abcdx", repeat=n):
            assert automaton.pieces("".join(w)) == greedy("".join(w)), w


def test_word_pieces_against_the_library(spark):
    models = pytest.importorskip("tokenizers").models
    first, other = wordpiece.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    ids: dict[str, int] = {}
    for p in ["[UNK]", *first, *("##" + x for x in other)]:
        ids.setdefault(p, len(ids))
    library = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**6)
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").limit(60).collect()}
    for r in queries.op3_token_counts(spark, SF).where(F.col("doc_id").isin(list(docs))).collect():
        words = re.findall(r"\w+|[^\w\s]", docs[r["doc_id"]])
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(len(library.tokenize(w)) for w in words))


def test_word_pieces_awkward(spark, awkward, empty):
    path = queries.tokenizer("piece_bpe_32k.model")
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in wordpiece.token_counts(awkward, path).collect()}
    assert rows[0] == rows[1] == rows[2] == (0, 0) and rows[4][0] == 30_000
    assert wordpiece.token_counts(empty, path).count() == 0


def plain_repetition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    shares, kept = [], True
    for n, limit in repetition.NGRAM_LIMITS.items():
        met, later = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            later |= {i + k for k in range(n)} if g in met else set()
            met.add(g)
        share = sum(len(words[i]) for i in later) / max(1, sum(map(len, words)))
        shares.append(share)
        kept &= share <= limit
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words)}, shares, kept


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n#|"), max_size=200))
def test_repetition_small(text):
    check_repetition(text)


def check_repetition(text):
    base, shares, kept = plain_repetition(text)
    got = repetition.measure(text)
    assert {k: got[k] for k in base} == base
    assert got["dup_ngram_chars"] == pytest.approx(shares)
    assert got["kept"] == (not base["base_failed"] and kept and got["dup_line_share"] <= repetition.LINE_LIMIT and got["dup_line_chars"] <= repetition.LINE_CHARS_LIMIT)


def test_repetition_documents(spark, awkward, empty):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for text in list(docs.values())[:150]:
        check_repetition(text)
    assert queries.op7_repetition(spark, SF).count() == len(docs)
    rows = {r["doc_id"]: r for r in repetition.repetition(awkward).collect()}
    assert not rows[0]["kept"] and rows[4]["kept"] and rows[4]["n_words"] == 30_000
    assert repetition.repetition(empty).count() == 0


def auc(y, p):
    rank = np.argsort(np.argsort(p, kind="stable"))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.97)])
def test_classifiers_held_out(spark, name, label, least):
    """In every language alike."""
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert auc(rows[label].to_numpy(), rows["score"].to_numpy()) > least
    for _, some in rows.groupby("lang"):
        assert auc(some[label].to_numpy(), some["score"].to_numpy()) > least
    if label == "toxic":
        marked = rows.merge(table(spark, sf, "documents").select("doc_id", "text").toPandas(), on="doc_id")
        told = marked[(marked["toxic"] == 1) & marked["text"].str.contains(r"\b(?:idiot|moron|scum|loser|clown|trash|stupid|pathetic|worthless|disgusting)\b", case=False)]
        assert len(told) > 30 and (told["predicted"] == 1).mean() > 0.9
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    good = rows[rows[label] == (0 if label == "toxic" else 1)]
    assert (good["predicted"] == (0 if label == "toxic" else 1)).mean() > 0.98


def test_machine_learns_pairs():
    """Two terms that mean nothing alone and everything together."""
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        docs.append(np.array(sorted({int(x) for x in rng.integers(100, 140, 5)} | ({1} if a else set()) | ({2} if b else set())), np.int32))
        y.append(float(a and b))
    machine = toxicity.train(docs, np.array(y), epochs=30)
    score = lambda *t: machine.score(np.array(t, np.int32))
    assert score(1, 2) > 0.8 and max(score(1), score(2), score(100)) < 0.3


def test_machine_scores_all_pairs():
    """The score against the sum over all pairs of terms, one by one."""
    rng = np.random.default_rng(1)
    at = np.zeros(1 << toxicity.BITS, np.int32)
    at[:30] = np.arange(30)
    weight, factor = rng.normal(size=30).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32)
    for n in (0, 1, 2, 9):
        terms = rng.choice(np.arange(1, 40), n, replace=False)
        rows = [int(at[t]) for t in terms if at[t]]
        z = 0.3 + sum(weight[i] for i in rows) + sum(float(factor[i] @ factor[j]) for k, i in enumerate(rows) for j in rows[:k])
        assert toxicity.FactorizationMachine(at, 0.3, weight, factor).score(terms) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_terms_mark_shared_stems():
    """Two words of one stem give a mark that one word, however often, does not."""
    terms = toxicity.TermHasher()
    one, twice, two, three = (set(terms(t).tolist()) for t in ("stemword", "stemword stemword", "stemword stemwort", "stemword stemwort stemwood"))
    assert one == twice and len(two - one - set(terms("stemwort").tolist())) == 3 and len(three) > len(two)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{i}", ("vile trash " if i % 2 else "kind word ") * 3) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, label int")
    for module in (toxicity, quality):
        rows = {r["doc_id"]: r["score"] for r in module.classify(docs, labels, F.lit(False)).collect()}
        assert len(rows) == 40 and rows["d1"] > rows["d0"]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_awkward(spark, awkward, empty, module):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, label int")
    rows = module.classify(awkward, labels, F.col("doc_id") == 3).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    one = module.classify(awkward, labels.where("label = 1"), F.lit(False)).collect()
    assert max(r["score"] for r in one) < 1e-9
    assert module.classify(empty, labels.limit(0), F.lit(False)).count() == 0


def test_word_vectors_cover_unlabelled_texts(spark):
    """Neighbours count in every text, labelled or not."""
    rows = [(1, "good clean words"), (2, "bad poor words"), (3, "lonely term beside others and lonely again"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    got, index, ids = quality.fit(docs, labels).parts[0], quality.index_vectors(), quality.TermIds()
    want = index.astype(float)
    for x in (ids(t).tolist() for _, t in rows):
        for i, a in enumerate(x):
            want[a] += sum(index[x[j]] for j in range(max(0, i - 2), min(len(x), i + 3)) if j != i)
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-6)


def test_masks_leave_no_pattern():
    import itertools

    for miss in itertools.combinations(range(decontaminate.WINDOW), decontaminate.MISSES):
        assert any(all(p + o not in miss for o in m) for m in decontaminate.masks() for p in range(decontaminate.WINDOW - m[-1]))


def test_decontamination_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, SF).collect()}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    bench = [(r["item_id"], split(r["text"])) for r in items.collect()]
    want = set()
    for r in docs.limit(150).collect():
        x = split(r["text"])
        for item, y in bench:
            size = min(decontaminate.WINDOW, len(y))
            grid = {w: np.array([v == w for v in y]) for w in set(x)}
            same = np.stack([grid[w] for w in x]) if x else np.zeros((0, len(y)), bool)
            for shift in range(-len(y) + size, len(x) - size + 1):
                d = np.diagonal(same, -shift).astype(int)
                if len(d) >= size and np.convolve(d, np.ones(size, int), "valid").max() >= size - decontaminate.MISSES * size // decontaminate.WINDOW:
                    want.add((r["doc_id"], item))
    ids = {r["doc_id"] for r in docs.limit(150).collect()}
    assert {p for p in found if p[0] in ids} == want
    assert found


def test_decontamination_substitutions_and_blocks(spark, awkward, empty):
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30))), (2, None), (3, "too short"), (4, ""), (5, "Eight words that make up one whole item")], "item_id long, text string")
    w = [f"q{i}" for i in range(30)]
    w[3], w[9], w[16], w[22] = "no", "none", "nil", "null"
    docs = spark.createDataFrame([(1, "before " + " ".join(w) + " after"), (2, "clean text of many words that is no item of any kind at all"), (3, "so eight WORDS that make up one whole item."), (4, None)], "doc_id long, text string")
    for block in (1, 100):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, block).collect()} == {(1, 1), (3, 5)}
        assert {r["doc_id"] for r in decontaminate.clean(docs, items, block).collect()} == {2, 4}
    assert decontaminate.clean(awkward, items).count() == awkward.count()
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == 4


def test_decontamination_of_short_items():
    """One substitution at any place of an item of 8 to 12 words, and exact copies of still shorter ones."""
    for n in range(1, 13):
        index = decontaminate.SeedIndex([(1, " ".join(f"q{i}" for i in range(n))), (2, "other words " * 10)])
        allowed = decontaminate.MISSES * n // decontaminate.WINDOW if n >= decontaminate.LEAST else 0
        assert index.search("a b " + " ".join(f"Q{i}" for i in range(n)) + ", c") == {1: (n, n, 2)}
        for at in range(n):
            w = [f"q{i}" if i != at else "no" for i in range(n)]
            assert index.search(f"a b {' '.join(w)} c") == ({1: (n - 1, n, 2)} if allowed else {})
    assert decontaminate.SeedIndex([(1, "a few words"), (2, "")]).search("") == {}


def test_fold_is_crc32(spark):
    assert spark.range(50).select(fold(F.col("id"), 3)).toPandas().iloc[:, 0].tolist() == [zlib.crc32(str(i).encode()) % 3 for i in range(50)]

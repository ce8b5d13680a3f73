"""Operators over the whole corpus: line runs, Jaccard components, language models, and the pipeline."""

import gc
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenql.llm import jaccard, linededup, lmscore, queries
from lumenql.llm.common import table, trim_executors

from .conftest import BLOCK

SF = "/root/testdata/sf0.001"


def oracle(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in got.description)
    at = [[d[0] for d in got.description].index(n) for n in names]
    return names, sorted(tuple(r[i] for i in at) for r in got.fetchall())


@pytest.mark.parametrize("name", ["op4_line_dedup", "op9_jaccard_join"])
def test_against_sql(spark, name):
    names, want = oracle(name)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want


def plain_lines(rows, least):
    """Lines of every run that starts at an earlier place too and has enough words."""
    lines = [(d, p, x) for d, t in sorted(rows) for p, x in enumerate(t.split("\n"))]
    gone = set()
    for i in range(len(lines)):
        for j in range(i):
            n = 0
            while i + n < len(lines) and lines[i + n][0] == lines[i][0] and lines[j + n][0] == lines[j][0] and lines[i + n][2] == lines[j + n][2]:
                n += 1
            if sum(len(lines[i + k][2].split()) for k in range(n)) >= least:
                gone |= {(lines[i][0], lines[i + k][1]) for k in range(n)}
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_runs_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(d, "\n".join("abcd"[k] * 2 + " " + "abcd"[k] for k in rng.integers(0, 3 + seed % 2, rng.integers(1, 14)))) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = plain_lines(rows, 6)
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in linededup.dedup_lines(docs, 6).collect()}
    for d, t in rows:
        left = [x for p, x in enumerate(t.split("\n")) if (d, p) not in gone]
        assert got[d] == ("\n".join(left), t.count("\n") + 1 - len(left))


def test_line_dedup_awkward(spark, awkward, empty):
    out = linededup.dedup_lines(awkward, counts=("a", "b"))
    assert out.columns == [*awkward.columns, "a", "b"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"] is None and rows[0]["a"] == 0 and rows[1]["a"] == 1
    assert rows[7]["text"] == BLOCK and rows[8]["text"] == "more" and rows[8]["b"] == 6
    assert out.count() == awkward.count()
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_plan_is_native(spark):
    plan = queries.op4_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    name = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    return {d: (len(sets[d]), name[d]) for d in sets}


@pytest.mark.parametrize(("seed", "percent"), [(0, 85), (1, 85), (2, 60)])
def test_jaccard_brute_force(spark, seed, percent):
    """Chains of edits at every size, from a few words up, around the limit."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in [1, 3, 4, 5, 7, 9, 12, 15, 18, 25, 40, 60, 90, 150]:
        base = [f"v{x}" for x in rng.integers(0, 50, n)]
        for _ in range(7):
            w = list(base)
            for _ in range(int(rng.integers(0, 2 + n // 30))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [f"e{rng.integers(0, 9)}"] * int(rng.integers(0, 2))
                w = w or ["z"]
            rows.append((len(rows), " ".join(w)))
            base = w if rng.random() < 0.5 else base
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 4, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_signatures_meet_where_sets_link(percent):
    """Any two linking sets share a signature: small and sparse ones, and ones whose sizes are as far apart as may be."""
    rng, bands, met = np.random.default_rng(5), jaccard.Bands(percent), 0
    for k in range(3000):
        n = int(rng.integers(1, (30, 120, 600)[k % 3]))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        kept = x[int(rng.integers(0, n * (100 - percent) // 100 + 1)) :]
        room = max(0, len(kept) * 100 // percent - n)
        more = room if rng.random() < 0.5 else int(rng.integers(0, room + 1))
        x, y = np.unique(x), np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not np.array_equal(x, y) and 100 * both >= percent * (len(x) + len(y) - both):
            met += 1
            assert len(np.intersect1d(jaccard.signatures(x, bands), jaccard.signatures(y, bands)))
    assert met > 500


def test_jaccard_awkward(spark, awkward, empty):
    rows = jaccard.jaccard_components(awkward).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == awkward.count()
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[4] == (29_997, 4)
    assert got[5] == got[6] and got[5][1] == 5 and got[None][1] is None
    assert jaccard.jaccard_components(empty).count() == 0


def test_model_losses_by_hand(spark):
    rows = [("a b a b", True), ("a c", False), ("b b zz", False), (None, False), ("", True)]
    m = lmscore.fit(spark.createDataFrame(rows, "text string, target boolean"), rare=0.15, rare_pair=0.0, alpha=0.5, mass=2.0)
    words = {"a": 3, "b": 4}
    assert len(m.vocab) == 2
    n, target, back = m.losses(lmscore.WordHashes()("a b qq"))
    uni = {w: (c + 0.5) / (9 + 1.5) for w, c in words.items()} | {"?": (2 + 0.5) / 10.5}
    pairs = Counter([("^", "a"), ("a", "b"), ("b", "a"), ("a", "b"), ("^", "a"), ("a", "?"), ("^", "b"), ("b", "b"), ("b", "?")])
    of = Counter()
    for (c, _), k in pairs.items():
        of[c] += k
    p = [(pairs[g] + 2 * uni[g[1]]) / (of[g[0]] + 2) for g in (("^", "a"), ("a", "b"), ("b", "?"))]
    assert n == 3 and back == pytest.approx(-sum(map(math.log, p)) / 3, rel=1e-5) and target > 0


def test_model_scores_tell_targets(spark, awkward, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    target = docs.where("lang = 'de'")
    rows = lmscore.cross_entropy_difference(docs, target.select("doc_id")).join(docs.select("doc_id", "lang"), "doc_id").where("n_tokens > 20").toPandas()
    assert (rows[rows.lang == "de"].difference < 0).mean() > 0.95 and (rows[rows.lang != "de"].difference > 0).mean() > 0.95
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(awkward, awkward.where("doc_id = 4").select("doc_id")).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["difference"] == 0.0 and len(got) == 13
    assert lmscore.cross_entropy_difference(empty, empty.select("doc_id")).count() == 0


def test_chunks_come_in_parts():
    """A part begins where the chunk or the row of places breaks off."""
    import pyarrow as pa

    rows = [(7, 0), (7, 1), (8, 3), (8, 4), (8, 0), (9, 0)]
    batch = pa.RecordBatch.from_pydict({"chunk": [c for c, _ in rows], "place": [p for _, p in rows], "tokens": [b""] * 6, "target": [True] * 6})
    assert [(c, p, len(t)) for c, p, t, _ in lmscore.parts([batch.slice(0, 1), batch.slice(1)])] == [(7, 0, 2), (8, 3, 2), (8, 0, 1), (9, 0, 1)]


def plain_differences(rows, alpha=0.5, mass=20.0):
    """Whole bigram models, no word or bigram left out."""
    models = []
    for chosen in ([t for _, t, _ in rows], [t for _, t, f in rows if f]):
        texts = [re.findall(r"\w+", t.lower()) for t in chosen if t]
        models.append((Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([None, *t], t)), Counter(c for t in texts for c in [None, *t][: len(t)])))
    words = len(models[0][0])
    out = {}
    for d, t, _ in rows:
        w = re.findall(r"\w+", t.lower()) if t else []
        losses = []
        for uni, pair, context in models:
            n = sum(uni.values())
            losses.append(sum(math.log(context[a] + mass) - math.log(pair[a, b] + mass * (uni[b] + alpha) / (n + alpha * (words + 1))) for a, b in zip([None, *w], w)) / max(1, len(w)))
        out[d] = (len(w), losses[1], losses[0])
    return out


@pytest.mark.parametrize("settings", [{}, {"chunk": 60, "bucket": 100}])
def test_model_keeps_rare_words_in_large_corpora(spark, settings):
    """Two sightings count the same however many other tokens there are, in one chunk and in many."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 40) % 300), i % 3 == 0) for i in range(40)]
    rows += [(40, "rare pearl of w1 w2", True), (41, "rare pearl in w3", False), (42, None, True), (43, "", False)]
    if not settings:
        rows.append((44, "a b c d e f " * 300_000, False))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    target = spark.createDataFrame([(d,) for d, _, f in rows if f], "doc_id long")
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, target, **settings).collect()}
    want = plain_differences(rows)
    assert got.keys() == want.keys()
    for d, (n, t, b) in want.items():
        assert got[d]["n_tokens"] == n
        assert [got[d]["target_loss"], got[d]["background_loss"], got[d]["difference"]] == pytest.approx([t, b, t - b], rel=1e-6, abs=1e-9)


def test_pipeline_stages(spark, awkward, empty):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, awkward, empty):
            out = stage(spark, given, SF)
            assert name == "tokens" or out.columns == given.columns
            assert out.count() <= given.count()
    named = {r["doc_id"] for r in corpus_pipeline.language(spark, awkward, SF).collect()}
    assert not named & {0, 1, 2, 9} and {3, 4, 5} <= named
    once = corpus_pipeline.near_duplicates(spark, awkward, SF)
    assert once.where("doc_id IN (5, 6)").count() == 1
    lines = {r["doc_id"]: r for r in corpus_pipeline.repeated_lines(spark, awkward, SF).collect()}
    assert lines[8]["text"] == "more" and lines[8]["n_chars"] == 4


def test_near_duplicates_brute_force(spark):
    """The stage keeps the smallest id of each component at five words and 0.8, where four words and 0.85 would keep more."""
    rng, rows = np.random.default_rng(8), []
    for n in [1, 4, 6, 20, 49, 50, 51, 60, 100, 102, 104, 150]:
        base = [f"v{x}" for x in rng.integers(0, 400, n)]
        for edits in range(5):
            w = list(base)
            for at in rng.integers(0, n, edits):
                w[at] = f"e{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    want = {name for _, name in plain_components(rows, 5, 80).values()}
    assert len(want) < len({name for _, name in plain_components(rows, 4, 85).values()})
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_stages_begin_with_trimmed_heaps(spark, monkeypatch):
    jvm = spark._jvm
    jvm.java.nio.ByteBuffer.allocate((1 << 30) - 1)  # garbage, for which the heap grows
    gc.collect()
    grown = jvm.java.lang.Runtime.getRuntime().totalMemory()
    trim_executors(spark)
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() < max(grown, 1 << 30)
    calls = []
    monkeypatch.setattr(corpus_pipeline, "trim_executors", calls.append)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table(spark, SF, "documents").limit(20), SF)
    assert calls == [spark] * len(corpus_pipeline.STAGES)


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(len(r["token_ids"]) == r["n_tokens"] for r in rows)


def test_queries_read_whole_tables(spark):
    n = table(spark, SF, "documents").count()
    for name, q in queries.QUERIES.items():
        if name != "op8_decontamination":
            assert q(spark, SF).select("doc_id").agg(F.count_distinct("doc_id")).first()[0] == n

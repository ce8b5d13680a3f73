import pytest
from pyspark.sql import functions as F

from lumenql.operators import fulltext as fts

TEXTS = [(1, "Granite slate granite, io x"), (2, None), (3, "--- !"), (4, "Ärger İstanbul 岩石 K"), (5, "ab a b abab"), (5, "slate zz ab"), (6, "")]
CONFIGS = [fts.FtsConfig(), fts.FtsConfig(levels=(1, 2, 3), synonyms={"slate": ["schist", "ab"], "x": []}), fts.FtsConfig(levels=(2,), min_term=2), fts.FtsConfig(levels=(3,), positions=False), fts.FtsConfig(synonyms={"ab": ["granite"]})]


@pytest.mark.parametrize("config", CONFIGS)
def test_statistics_without_postings(spark, config):
    rows = spark.createDataFrame(TEXTS, "k long, t string")
    for once, some in ((False, rows), (True, rows.dropDuplicates(["k"]))):
        want = fts.postings(some, "k", "t", config).groupBy("k").agg(F.count_distinct("term").alias("n"), F.count(F.lit(1)).alias("all"))
        got = fts.row_stats(some, "k", "t", config, once)
        both = want.join(got, "k", "full").collect()
        assert both and all(r["n"] == r["n_terms"] and r["all"] <= r["n_postings"] for r in both)
    assert "Exchange" not in fts.row_stats(rows, "k", "t", config, True)._jdf.queryExecution().executedPlan().toString()


def test_a_sort_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fts, "SORTED_AT_ONCE", 100, raising=False)
    rows = spark.range(200).select("id", F.lit("the same seven words in each text").alias("t"))
    fts.build(rows, "id", "t", fts.FtsConfig(), str(tmp_path))
    index, stats = fts.load(spark, [str(tmp_path)], "id long")
    per_task = index.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().collect()
    assert sum(r[1] for r in per_task) == 1400 and len(per_task) > 10 and max(r[1] for r in per_task) < 300
    assert stats.count() == 200 and fts.search(index, "id", ["seven", "text"]).count() == 200


@pytest.mark.parametrize("config", CONFIGS)
def test_only_wanted_postings_are_made(spark, config):
    rows = spark.createDataFrame(TEXTS, "k long, t string")
    every = fts.postings(rows, "k", "t", config)
    for terms in (["ab"], ["io", "x"], ["e", "te", "岩石", "k"], ["granite", "slate", "b"], ["schist"]):
        for level in (None, 1, 2, 3):
            want = every.where(F.col("term").isin(terms))
            want = want.where(F.col("level") == level) if level else want
            got = fts.postings(rows, "k", "t", config, terms, level)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

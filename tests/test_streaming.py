from lumenql.operators import fulltext as fts
from lumenql.sources.storage import Files
from lumenql.streaming.fulltext import maintain


def test_segments(spark, tmp_path):
    for i, text in enumerate(["granite granite slate", "slate basalt", "granite basalt"]):
        spark.createDataFrame([(i, text)], "k long, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    config = fts.FtsConfig()
    maintain(stream, "k", "t", config, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    paths = [f"{tmp_path}/index/{n}" for n in Files(spark).list(f"{tmp_path}/index")]
    assert len(paths) == 3
    index, stats = fts.load(spark, paths, "k long", ["granite", "slate"])
    assert {r[0] for r in fts.search(index, "k", ["granite", "slate"]).collect()} == {0}
    best = fts.ranked(index, stats, "k", ["granite"]).orderBy("k").collect()
    assert [(r["k"], r["score"]) for r in best] == [(0, 0.75), (2, 0.75)]

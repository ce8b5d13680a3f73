"""Full-text queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext as fts
from .catalog import query, sql, table

_TERMS = r"SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '')) AS term FROM documents"
_PIECES = r"SELECT doc_id, unnest(list_transform(range(0, CAST(ceil(length(term) / 2.0) AS BIGINT)), lambda i: substring(term, CAST(2 * i + 1 AS BIGINT), 2))) AS term FROM t"
CONFIG = fts.FtsConfig()


def _index(spark: SparkSession, sf_dir: str, config: fts.FtsConfig = CONFIG, terms: list[str] | None = None, level: int | None = None) -> DataFrame:
    return fts.postings(table(spark, sf_dir, "documents"), "doc_id", "text", config, terms, level)


@query(rf"WITH t AS ({_TERMS}) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM t GROUP BY doc_id")
def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fts.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_terms")).where("n_tokens > 0")


@query(rf"WITH t AS ({_TERMS}) SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM t GROUP BY term")
def fts_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(fts.words(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(rf"WITH t AS ({_TERMS}) SELECT DISTINCT doc_id FROM t WHERE term = 'that'")
def fts_match_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.search(_index(spark, sf_dir, terms=["that"]), "doc_id", ["that"])


@query(rf"WITH t AS ({_TERMS}) SELECT doc_id FROM t WHERE term IN ('that', 'with', 'from') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def fts_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fts.query_terms("That WITH, from", CONFIG)
    return fts.search(_index(spark, sf_dir, terms=terms), "doc_id", terms)


@query(rf"WITH t AS ({_TERMS}), p AS ({_PIECES}) SELECT doc_id FROM p WHERE term IN ('id', 'io', 't') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def fts_match_level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = fts.FtsConfig(levels=(1, 2, 3))
    terms = fts.query_terms("idiot", config, 2)
    return fts.search(_index(spark, sf_dir, config, terms, 2), "doc_id", terms, 2)


@query(
    rf"""WITH t AS (SELECT DISTINCT doc_id, term FROM ({_TERMS})), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), size AS (SELECT doc_id, count(*) AS m FROM t GROUP BY doc_id),
    hits AS (SELECT * FROM t WHERE term IN ('that', 'with')), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
    SELECT doc_id, round(sum((CASE term WHEN 'that' THEN 2 ELSE 1 END) * 1.0 / df) * any_value(n) / any_value(m), 9) AS score FROM hits JOIN df USING (term) JOIN size USING (doc_id) CROSS JOIN n
    GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 10"""
)
def fts_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fts.query_terms("that with that", CONFIG)
    stats = fts.row_stats(table(spark, sf_dir, "documents"), "doc_id", "text", CONFIG)
    found = fts.ranked(_index(spark, sf_dir, terms=terms), stats, "doc_id", terms)
    return found.select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(rf"WITH t AS ({_TERMS}) SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM t")
def fts_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.index_stats(_index(spark, sf_dir), "doc_id")


@query(rf"WITH t AS ({_TERMS}), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id) AS r FROM t) SELECT doc_id, CAST(count(*) AS BIGINT) AS times FROM u WHERE term = 'that' GROUP BY doc_id")
def fts_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.positions(_index(spark, sf_dir, terms=["that"]), "doc_id", "that").select("doc_id", F.size("positions").cast("long").alias("times"))


@query("SELECT conv_id, turn, regexp_replace(text, '(?i)((?:the|of)+)', '<b>\\1</b>', 'g') AS marked FROM conversations")
def fts_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fts.highlight(F.col("text"), ["the", "of"]).alias("marked"))


sql("fts_substring_fallback", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), lower('The'))")

"""The registered queries of the training-data operators, thin over the operators' own interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, langid, linededup, lmscore, quality, repetition, toxicity, wordpiece
from .common import fold, table


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


#: Every maximal common run of two documents, or of a document with itself, pair by pair along diagonals.
LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM docs),
pairs AS (
  SELECT a.doc_id AS d, a.pos AS p, b.doc_id AS e, a.pos - b.pos AS shift,
         len(regexp_extract_all(a.line, '[^\x20\x09-\x0D]+')) AS w
  FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))),
stretches AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, shift ORDER BY p) AS run FROM pairs),
gone AS (
  SELECT DISTINCT d, p FROM (SELECT d, p, sum(w) OVER (PARTITION BY d, e, shift, run) AS words FROM stretches) WHERE words >= 50)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.p) AS BIGINT) AS n_deleted,
       sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS text_sha256
FROM lines LEFT JOIN gone g ON lines.doc_id = g.d AND lines.pos = g.p GROUP BY doc_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.classify(table(spark, sf_dir, "documents"), labels, fold(F.col("doc_id"), 3) == 1)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents"), labels, fold(F.col("doc_id"), 4) == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_language_id, op3_token_counts, op4_line_dedup, op5_toxicity, op6_lm_scoring, op7_repetition, op8_decontamination, op9_jaccard_join, op10_quality)
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP_SQL, "op9_jaccard_join": JACCARD_SQL}

"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's result to the shared folder and reads it again.
A stage begins with executors that have given back the heap of the stages before it.

Defined results: rows without an id are never near duplicates of others; rows that repeat id and
text leave one; a document whose text was wholly repeated lines goes; a null text has no language.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenql.llm import bpe, decontaminate, jaccard, langid, linededup
from lumenql.llm.common import Scratch, bits_for, hash_bits, may_occur, table, trim_executors
from lumenql.llm.queries import tokenizer

LEAST_SHARE = 0.4  # a document goes if no language has this share of it
SHINGLE, SIMILAR = 5, 80  # words of a shingle, and per cent of Jaccard similarity from which documents are near copies


def trimmed(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, after the executors' heaps are trimmed: they would else stay as large as any stage before has grown them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_executors(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@trimmed
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the mixture model learns from every row that has a lang. Null langs are filled in."""
    return langid.accepted(docs, langid.fit(docs), LEAST_SHARE)


@trimmed
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; n_chars follows the text."""
    out = linededup.dedup_lines(docs, counts=("__n_lines", "__n_deleted")).where("__n_deleted = 0 or text <> ''")
    size = F.when(F.col("__n_deleted") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*(size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


@trimmed
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of the Jaccard join over shingles of five words, at 0.8 or more."""
    scratch = Scratch(spark, "nearduplicates")
    found = scratch.keep("found", jaccard.jaccard_components(docs.select("doc_id", "text"), SHINGLE, SIMILAR))
    gone = scratch.keep("gone", found.where("doc_id <> component_id").select("doc_id").distinct())
    bits = bits_for(gone.count())
    occurs = scratch.keep("bits", hash_bits(gone.select(F.xxhash64("doc_id").alias("h")), bits))
    may = may_occur(F.xxhash64("doc_id"), occurs, bits)  # only documents that may go take part in the exact join with its exchange of texts
    kept = docs.where(~may).unionByName(docs.where(may).join(gone.hint("merge"), "doc_id", "left_anti"))
    twice = scratch.keep("twice", found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not twice.isEmpty():
        again = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(again)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


@trimmed
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@trimmed
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    return bpe.digest(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language", language), ("line_dedup", repeated_lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("tokens", tokens)]
#: SQL can state neither the language model nor the byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

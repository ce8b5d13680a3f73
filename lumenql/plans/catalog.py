"""All relational queries by name, with the DuckDB SQL of the same result.

A query is a statement of the dialect, rewritten and planned as the engine does it, or a function
over DataFrames where the engine's Python interface is the point.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dialect import rewrite
from ..functions import lenient, register

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_READY: set[int] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Register the dialect's functions, once a session."""
    if id(spark) not in _READY:
        register(spark)
        _READY.add(id(spark))


def statement(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One SELECT of the dialect over the tables of a folder."""
    ready(spark)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    with lenient(spark):
        return spark.sql(rewrite(sql, variables={"version": "'8.0.0-lumenql'"}))


def sql(name: str, text: str, oracle: str | None = None, same: bool = True) -> None:
    """Register a statement; its oracle is the text itself, another text, or none."""
    QUERIES[name] = lambda spark, sf_dir: statement(spark, sf_dir, text)
    if oracle or same:
        ORACLE_SQL[name] = oracle or text


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


from . import engine, fulltext, relational, scalar  # noqa: E402, F401 - they register their queries

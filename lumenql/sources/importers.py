"""Imports from other databases, and from SQL dumps.

Server databases are read by JDBC, partitioned over a numeric column where one is given; SQLite
files by a Python data source whose tasks read disjoint row-id ranges.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import Engine

# Source types by what they become; anything else is text.
_WHOLE = "TINYINT SMALLINT MEDIUMINT INT INTEGER BIGINT INT2 INT4 INT8 BIT YEAR"
_REAL = "FLOAT DOUBLE REAL DECIMAL NUMERIC"
TYPE_MAPS: dict[str, dict[str, str]] = {
    "mysql": {**dict.fromkeys(_WHOLE.split(), "INT"), **dict.fromkeys(_REAL.split(), "FLOAT"), **dict.fromkeys("BLOB TINYBLOB MEDIUMBLOB LONGBLOB BINARY VARBINARY".split(), "BLOB"), **dict.fromkeys("TEXT TINYTEXT MEDIUMTEXT LONGTEXT JSON ENUM SET".split(), "TEXT"), "DATE": "DATE", "TIME": "TIME", "DATETIME": "DATETIME", "TIMESTAMP": "DATETIME", "BOOLEAN": "INT", "BOOL": "INT"},
    "postgresql": {**dict.fromkeys(_WHOLE.split(), "INT"), **dict.fromkeys(_REAL.split(), "FLOAT"), "DOUBLE PRECISION": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "FLOAT", "MONEY": "FLOAT", "SERIAL": "SEQ", "BIGSERIAL": "SEQ", "BYTEA": "BLOB", **dict.fromkeys("TEXT JSON JSONB UUID XML INET".split(), "TEXT"), "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "DATETIME", "TIMESTAMPTZ": "DATETIME", "BOOLEAN": "INT", "BOOL": "INT"},
    "sqlite": {**dict.fromkeys(_WHOLE.split(), "INT"), **dict.fromkeys(_REAL.split(), "FLOAT"), "BLOB": "BLOB", "TEXT": "TEXT", "CLOB": "TEXT", "DATE": "DATE", "DATETIME": "DATETIME", "TIMESTAMP": "DATETIME", "BOOLEAN": "INT"},
    "oracle": {**dict.fromkeys("INTEGER SMALLINT".split(), "INT"), **dict.fromkeys("NUMBER FLOAT BINARY_FLOAT BINARY_DOUBLE".split(), "FLOAT"), **dict.fromkeys("CLOB NCLOB LONG XMLTYPE".split(), "TEXT"), **dict.fromkeys(("BLOB", "RAW", "LONG RAW", "BFILE"), "BLOB"), "DATE": "DATETIME", "TIMESTAMP": "DATETIME"},
    "mssql": {**dict.fromkeys(_WHOLE.split(), "INT"), **dict.fromkeys(f"{_REAL} MONEY SMALLMONEY".split(), "FLOAT"), **dict.fromkeys("TEXT NTEXT XML UNIQUEIDENTIFIER".split(), "TEXT"), **dict.fromkeys("BINARY VARBINARY".split(), "BLOB"), "IMAGE": "IMAGE", "DATE": "DATE", "TIME": "TIME", **dict.fromkeys("DATETIME DATETIME2 SMALLDATETIME DATETIMEOFFSET".split(), "DATETIME")},
}


def convert_type(source: str, name: str) -> str:
    """The dialect's type for a column type of a source database."""
    full = " ".join(name.upper().split())
    base = re.sub(r"\s*\(.*?\)", "", full).replace(" UNSIGNED", "")
    size = re.search(r"\((\d+)", full)
    kinds = TYPE_MAPS[source]
    if base in kinds:
        if source == "oracle" and base == "NUMBER" and re.search(r"\(\d+(,\s*0)?\)", full):
            return "INT"
        return kinds[base]
    if re.fullmatch(r"N?CHAR|CHARACTER|BPCHAR", base):
        return f"CHAR({size[1]})" if size else "CHAR(1)"
    if re.fullmatch(r"N?VARCHAR2?|CHARACTER VARYING", base):
        return f"VARCHAR({size[1]})" if size else "TEXT"
    return "DATETIME" if base.startswith("TIMESTAMP") else "TEXT"


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # an empty table has no ranges
            return
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("table", t).load(path): path is on a file system that all tasks see."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        from ..dialect import spark_type

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kinds = [spark_type(convert_type("sqlite", c[2] or "TEXT")) for c in columns]
        return ", ".join(f"`{c[1]}` {'string' if k in ('date', 'timestamp_ntz') else k}" for c, k in zip(columns, kinds, strict=True))  # SQLite keeps times as text

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("numpartitions", 8)))


def sqlite_tables(path: str) -> dict[str, list[tuple[str, str, bool]]]:
    """Tables of a SQLite file: name, type and whether NOT NULL of each column."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {n: [(c[1], c[2] or "TEXT", bool(c[3])) for c in db.execute(f'PRAGMA table_info("{n}")')] for n in names}


def import_sqlite(engine: Engine, path: str, tables: list[str] | None = None) -> dict[str, int]:
    """Create and fill tables from a SQLite file; rows by table."""
    from ..dialect import quote_name

    engine.spark.dataSource.register(SqliteSource)
    out = {}
    for name, columns in sqlite_tables(path).items():
        if tables is None or name in tables:
            shape = ", ".join(f"{quote_name(c)} {convert_type('sqlite', t)}{' NOT NULL' * required}" for c, t, required in columns)
            engine.execute(f"CREATE TABLE {quote_name(name)} ({shape})")
            rows = engine.spark.read.format("sqlite").option("table", name).load(path)
            out[name] = engine.insert_rows(name, rows).rows_affected
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A server table by JDBC; with a numeric column and its bounds, in parallel ranges. The driver jar is the session's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def import_jdbc(engine: Engine, source: str, url: str, table: str, columns: list[tuple[str, str]], **options) -> int:
    """Create and fill a table from a server table; columns are its names and source types."""
    from ..dialect import quote_name

    engine.execute(f"CREATE TABLE {quote_name(table)} ({', '.join(f'{quote_name(c)} {convert_type(source, t)}' for c, t in columns)})")
    return engine.insert_rows(table, read_jdbc(engine.spark, url, table, **options).select(*(quote_name(c) for c, _ in columns))).rows_affected


_SKIPPED = re.compile(r"^\s*(LOCK|UNLOCK|DELIMITER|FLUSH|ANALYZE|GRANT|USE)\b", re.I)


def import_dump(engine: Engine, text: str) -> dict[str, int]:
    """Run the statements of a SQL dump; counts of statements done, skipped and failed."""
    from ..dialect import DialectError, split_statements

    counts = {"done": 0, "skipped": 0, "failed": 0}
    for tokens in split_statements(text):
        if _SKIPPED.match(tokens[0].text) or tokens[0].upper == "SET":
            counts["skipped"] += 1
            continue
        try:
            engine._statement(_without_table_options(tokens), None)
            counts["done"] += 1
        except (ValueError, KeyError, PySparkException):  # a bad row or statement does not end the import
            counts["failed"] += 1
    return counts


def _without_table_options(tokens: list) -> list:
    """CREATE TABLE without what a dump puts after the closing parenthesis, and without plain KEY entries."""
    if [t.upper for t in tokens[:2]] != ["CREATE", "TABLE"]:
        return tokens
    depth, out, at = 0, [], 0
    while at < len(tokens):
        t = tokens[at]
        depth += (t.kind == "op") * ((t.text == "(") - (t.text == ")"))
        if depth == 1 and t.upper in ("KEY", "INDEX") and out[-1].text == ",":
            inner = 0
            while tokens[at + 1].text not in (",", ")") or inner:
                at += 1
                inner += (tokens[at].text == "(") - (tokens[at].text == ")")
            out.pop()
            at += 1
            continue
        out.append(t)
        at += 1
        if depth == 0 and t.text == ")":
            break
    return out


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write rows as Parquet, CSV, JSON or ORC files of a folder."""
    writer = df.write.mode("errorifexists")
    {"parquet": writer.parquet, "orc": writer.orc, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)

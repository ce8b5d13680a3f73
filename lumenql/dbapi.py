"""A small DB-API shaped face of the engine: connect(), cursors, ? parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .session import Engine

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class NotSupportedError(Exception):
    """Transactions over several statements are not supported."""


class Cursor:
    def __init__(self, engine: Engine):
        self.engine, self.rowcount, self.lastrowid, self.description = engine, -1, None, None
        self._rows: Any = iter(())

    def execute(self, sql: str, parameters: list[Any] | tuple = ()) -> Cursor:
        got = self.engine.execute(sql, list(parameters))
        if isinstance(got, DataFrame):
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in got.schema]
            self._rows, self.rowcount = got.toLocalIterator(), -1  # a partition at a time
        else:
            self.description, self._rows, self.rowcount, self.lastrowid = None, iter(()), got.rows_affected, got.last_insert_id
        return self

    def executemany(self, sql: str, rows: list[list[Any]]) -> Cursor:
        total = 0
        for r in rows:
            total += self.execute(sql, r).rowcount
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self):
        return map(tuple, self._rows)

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self.engine)

    def execute(self, sql: str, parameters: list[Any] | tuple = ()) -> Cursor:
        return self.cursor().execute(sql, parameters)

    def begin(self) -> None:
        raise NotSupportedError("every statement commits by itself")

    def commit(self) -> None:
        """Nothing to do: every statement has committed."""

    def rollback(self) -> None:
        raise NotSupportedError("every statement commits by itself")

    def ping(self) -> bool:
        return self.engine.spark.sql("SELECT 1").first()[0] == 1

    def close(self) -> None:
        self.engine.close()


def connect(spark: SparkSession, root: str, database: str = "main", **settings) -> Connection:
    """Open a database folder."""
    return Connection(Engine(spark, root, database, **settings))

"""The engine: statements of the dialect over one database folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scripts
from .ddl import Cursor, IndexSpec, create_index, create_table, text_of
from .ddl import column as parse_column
from .dialect import DialectError, Rewriter, Token, name_of, quote_name, quote_string, split_statements, string_value
from .functions import lenient, register
from .operators import fulltext as fts
from .sources import folders
from .store import ORDER, ROWID, Catalog, Column, Table, numbered

SCRIPTS = "xxscript"
VARIABLES = {
    "version": "'8.0.0-lumenql'", "version_comment": "'LumenQL on Apache Spark'", "autocommit": "1", "sql_mode": "''", "time_zone": "'UTC'", "system_time_zone": "'UTC'", "character_set_client": "'utf8mb4'",
    "character_set_connection": "'utf8mb4'", "character_set_results": "'utf8mb4'", "character_set_server": "'utf8mb4'", "character_set_database": "'utf8mb4'", "collation_connection": "'utf8mb4_general_ci'", "collation_server": "'utf8mb4_general_ci'",
    "collation_database": "'utf8mb4_general_ci'", "max_allowed_packet": "67108864", "wait_timeout": "28800", "interactive_timeout": "28800", "net_write_timeout": "60", "tx_isolation": "'SNAPSHOT'", "transaction_isolation": "'SNAPSHOT'",
    "net_buffer_length": "16384", "query_cache_size": "0", "query_cache_type": "'OFF'", "auto_increment_increment": "1", "lower_case_table_names": "0", "license": "'Apache-2.0'", "init_connect": "''",
}

#: Words after a table's name that are no alias.
_AFTER_TABLE = set("WHERE JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING GROUP ORDER HAVING LIMIT OFFSET UNION INTERSECT EXCEPT SET INTO".split())


class ConstraintError(ValueError):
    """Rows break a constraint of their table."""


@dataclass
class ExecResult:
    """What a command did."""

    rows_affected: int = 0
    last_insert_id: int | None = None
    message: str = "OK"


class Engine:
    """execute(sql, parameters) returns a DataFrame for queries and an ExecResult for commands.

    root is a folder of any file system that Spark reads; each database is a folder below it.
    enforce switches PRIMARY KEY, UNIQUE, FOREIGN KEY and CHECK on (NOT NULL and lengths always hold).
    """

    def __init__(self, spark: SparkSession, root: str, database: str = "main", enforce: bool = True):
        self.spark, self.root, self.enforce = spark, root.rstrip("/"), enforce
        self.variables = dict(VARIABLES)
        self._stage: str | None = None
        register(spark)
        folders.register(spark)
        self.host = folders.host_functions(spark)
        self.use(database)

    # -- databases and views -------------------------------------------------------------------

    def use(self, database: str) -> ExecResult:
        self.database = database
        self.catalog = Catalog(self.spark, f"{self.root}/{database}")
        for name in self.catalog.tables:
            self._publish(name)
        for name, s in self.catalog.scripts.items():
            self.spark.sql(scripts.create_statement(name, s["script"], s["description"]))
        return ExecResult(message=f"Database changed to {database}")

    def _publish(self, name: str) -> None:
        self.catalog.read(name).drop(ROWID).createOrReplaceTempView(quote_name(name))

    def _commit(self, *names: str) -> None:
        self.catalog.commit()
        for n in names:
            self._publish(n)

    def close(self) -> None:
        for name in self.catalog.tables:
            self.spark.catalog.dropTempView(name)

    # -- queries -------------------------------------------------------------------------------

    def execute(self, sql: str, parameters: list[Any] | None = None) -> DataFrame | ExecResult:
        """One statement, or several between semicolons; the last one's result."""
        result: DataFrame | ExecResult = ExecResult()
        for tokens in split_statements(sql):
            result = self._statement(tokens, parameters)
        return result

    def _statement(self, tokens: list[Token], parameters: list[Any] | None) -> DataFrame | ExecResult:
        if parameters:
            tokens = self._bind(tokens, parameters)
        c = Cursor(tokens)
        word = c.peek().upper
        if word in ("SELECT", "WITH", "VALUES") or c.peek().text == "(":
            return self.query(tokens)
        run = getattr(self, f"_do_{word.lower()}", None)
        if run is None:
            raise DialectError(f"unknown statement {c.peek().text!r}")
        c.next()
        return self._undone_on_error(lambda: run(c))

    def _undone_on_error(self, run: Callable[[], Any]) -> Any:
        """Run a command; if it fails, forget what it changed in memory and delete what it staged."""
        with lenient(self.spark):
            try:
                return run()
            except Exception:
                if self._stage:
                    self._drop_staged()
                before = set(self.catalog.tables)
                self.catalog.reload()
                for name in before - set(self.catalog.tables):
                    self.spark.catalog.dropTempView(name)
                for name in self.catalog.tables:
                    self._publish(name)
                raise

    @staticmethod
    def _bind(tokens: list[Token], parameters: list[Any]) -> list[Token]:
        """Literals in place of ? and $n tokens; never inside strings."""
        left = list(parameters)

        def literal(v: Any) -> list[Token]:
            if v is None:
                return [Token("word", "NULL")]
            if isinstance(v, bool):
                return [Token("word", str(v).upper())]
            if isinstance(v, (int, float)):
                return [Token("number", repr(abs(v)))] if v >= 0 else [Token("op", "-"), Token("number", repr(abs(v)))]
            if isinstance(v, (bytes, bytearray)):
                return [Token("word", "unhex"), Token("op", "("), Token("string", f"'{bytes(v).hex()}'"), Token("op", ")")]
            return [Token("string", quote_string(str(v)))]

        out: list[Token] = []
        for t in tokens:
            if t.kind != "param":
                out.append(t)
            elif t.text == "?":
                if not left:
                    raise DialectError("too few parameters")
                out += literal(left.pop(0))
            else:
                out += literal(parameters[int(t.text[1:]) - 1])
        return out

    def query(self, tokens: list[Token], views: dict[str, str] | None = None) -> DataFrame:
        """A SELECT; analysed at once, so that errors in it show here."""
        words = [t.upper for t in tokens]
        if "OUTFILE" in words and words[words.index("OUTFILE") - 1] == "INTO":
            cut = words.index("OUTFILE")
            rows = self.query(tokens[: cut - 1] + tokens[cut + 2 :])
            path = string_value(tokens[cut + 1])
            rows.write.option("header", True).csv(path) if path.endswith(".csv") else rows.write.parquet(path)
            return rows
        views: list[str] = []
        try:
            tokens, tables = self._searched(self._schema_views(tokens, views), views)
            with lenient(self.spark):
                text = Rewriter(self._matcher(tables, views), self.variables, self.host).rewrite(tokens)
                out = self.spark.sql(text)
                out.schema  # noqa: B018
        finally:
            for view in views:  # the plan holds what they stood for
                self.spark.catalog.dropTempView(view)
        return out.drop(ROWID) if views and ROWID in out.columns else out

    def _table_names(self, tokens: list[Token]) -> list[tuple[int, str, str, bool]]:
        """Where FROM and JOIN name tables: place, table, the name it goes by, and whether that is an alias."""
        out, listing = [], False
        for i, t in enumerate(tokens):
            before = tokens[i - 1] if i else Token("op", "")
            listing = True if t.upper == "FROM" else False if t.upper in ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "ON", "SELECT", "SET") else listing
            if t.kind in ("word", "quoted") and name_of(t) in self.catalog.tables and (before.upper in ("FROM", "JOIN") or listing and before.text == ","):
                at = i + 1 + (i + 1 < len(tokens) and tokens[i + 1].upper == "AS")
                alias = at < len(tokens) and tokens[at].kind in ("word", "quoted") and tokens[at].upper not in _AFTER_TABLE
                out.append((i, name_of(t), name_of(tokens[at]) if alias else name_of(t), alias))
        return out

    def _searched(self, tokens: list[Token], views: list[str]) -> tuple[list[Token], dict[str, str]]:
        """A statement whose searched tables are private views with row ids, and the table of each name."""
        named = self._table_names(tokens)
        tables = {goes_by: name for _, name, goes_by, _ in named}
        if not any(t.upper == "MATCH" for t in tokens):
            return tokens, tables
        out = list(tokens)
        for i, name, _, alias in reversed(named):
            if any(x.get("fulltext") for x in self.catalog.tables[name].indexes.values()):
                view = f"__table_{uuid.uuid4().hex}"
                views.append(view)
                self.catalog.read(name).createOrReplaceTempView(view)
                out[i : i + 1] = [Token("word", view)] if alias else [Token("word", view), Token("word", "AS"), tokens[i]]
        return out, tables

    def _matcher(self, tables: dict[str, str], views: list[str]):
        """What MATCH becomes: membership of the row id in the index's hits, which Catalyst plans as a semi join, or a substring test without an index.

        A qualifier says which table is meant; without one it is the first with an index on a column of the name.
        """

        def match(column: str, query: str, level: int | None, qualifier: str | None = None) -> str:
            for goes_by, name in tables.items():
                if qualifier is not None and qualifier.lower() != goes_by.lower():
                    continue
                for index in self.catalog.tables[name].indexes.values():
                    if index.get("fulltext") and index["columns"][0].lower() == column.lower():
                        view = f"__hits_{uuid.uuid4().hex}"
                        self.search_rows(name, index, query, level).createOrReplaceTempView(view)
                        views.append(view)
                        return f"{quote_name(goes_by)}.{ROWID} IN (SELECT {ROWID} FROM {view})"
            place = f"{quote_name(qualifier)}." if qualifier else ""
            return f"contains(lower({place}{quote_name(column)}), lower({quote_string(query)}))"

        return match

    def _schema_views(self, tokens: list[Token], views: list[str]) -> list[Token]:
        """information_schema.x as a view made for this query."""
        out, i = [], 0
        while i < len(tokens):
            if tokens[i].text.lower() == "information_schema" and i + 2 < len(tokens) and tokens[i + 1].text == ".":
                kind = name_of(tokens[i + 2]).upper()
                view = f"__schema_{kind.lower()}"
                views.append(view)
                self.information_schema(kind).createOrReplaceTempView(view)
                out.append(Token("word", view))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    # -- files ---------------------------------------------------------------------------------

    def save_file(self, path: str, content: bytes | str) -> int:
        """Write one file; a method, since a task that is tried again would write twice."""
        self.catalog.files.write(path, content.encode() if isinstance(content, str) else content)
        return 1

    def load_folder(self, path: str) -> bytes | None:
        return folders.load_folder(self.catalog.files, path)

    def export_folder(self, data: bytes, path: str) -> int:
        return folders.export_folder(self.catalog.files, data, path)

    # -- INSERT, UPDATE, DELETE ----------------------------------------------------------------

    def _do_insert(self, c: Cursor) -> ExecResult:
        c.need("INTO")
        name = c.name()
        t = self.catalog.table(name)
        columns = [t.column(n).name for n in c.names()] if c.peek().text == "(" and c.peek(1).upper not in ("SELECT", "WITH") else None
        if c.take("DEFAULT", "VALUES"):
            return self.insert_rows(name, self.spark.range(1).select(), [])
        if c.take("VALUES") or c.take("VALUE"):
            columns = columns if columns is not None else [x.name for x in t.columns]
            rows = []
            while True:
                cells = self._cells(c.inside())
                if len(cells) != len(columns):
                    raise DialectError(f"{len(cells)} values for {len(columns)} columns")
                rows.append(cells)
                if not c.take(","):
                    break
            c.end()
            return self.insert_rows(name, self._values(t, columns, rows), columns)
        return self.insert_rows(name, self.query(c.tokens[c.at :]), columns)

    @staticmethod
    def _cells(tokens: list[Token]) -> list[list[Token]]:
        out: list[list[Token]] = [[]]
        depth = 0
        for t in tokens:
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if t.text == "," and depth == 0 and t.kind == "op":
                out.append([])
            else:
                out[-1].append(t)
        return out

    def _values(self, t: Table, columns: list[str], rows: list[list[list[Token]]]) -> DataFrame:
        """Literal rows as an inline table, others as a union of one-row queries."""
        rewriter = Rewriter(None, self.variables, self.host)

        def cell(name: str, tokens: list[Token]) -> str:
            if len(tokens) == 1 and tokens[0].upper == "DEFAULT":
                return f"try_cast({self._default(t.column(name))} AS {t.column(name).spark})"
            text = rewriter.rewrite(tokens)
            return f"try_cast({text} AS {t.column(name).spark})" if t.column(name).spark != "binary" else f"cast({text} AS BINARY)"

        plain = all(x.kind in ("number", "string") or x.text == "-" or x.upper in ("NULL", "TRUE", "FALSE") for r in rows for cells in r for x in cells)
        names = ", ".join(map(quote_name, columns))
        made = [[cell(n, x) for n, x in zip(columns, r, strict=True)] for r in rows]
        if plain:
            return self.spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in made)} AS v({names})")
        return self.spark.sql(" UNION ALL ".join("SELECT " + ", ".join(f"{x} AS {quote_name(n)}" for n, x in zip(columns, r, strict=True)) for r in made))

    def _default(self, column: Column) -> str:
        return Rewriter(None, self.variables).rewrite(split_statements(column.default)[0]) if column.default else "NULL"

    def insert_rows(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> ExecResult:
        """Append rows; columns names theirs by place (None: all). Sequences always number anew."""
        return self._undone_on_error(lambda: self._insert_rows(name, rows, columns))

    def _insert_rows(self, name: str, rows: DataFrame, columns: list[str] | None) -> ExecResult:
        t = self.catalog.table(name)
        columns = [x.name for x in t.columns] if columns is None else columns
        if len(rows.columns) != len(columns):
            raise DialectError(f"{len(rows.columns)} values for {len(columns)} columns")
        rows = rows.toDF(*columns) if columns else rows
        made = []
        for x in t.columns:
            if x.name in columns and not x.auto:
                value = F.col(quote_name(x.name)).cast(x.spark) if x.spark == "binary" else F.col(quote_name(x.name)).try_cast(x.spark)
            else:
                value = F.expr("NULL" if x.auto else self._default(x)).cast(x.spark)
            made.append((F.rpad(value, x.length, " ") if x.is_char and x.length else value).alias(x.name))
        self._check_lengths(t, rows, columns)
        staged = self._staged(rows.select(*made).withColumn(ORDER, F.monotonically_increasing_id()))
        out, count = numbered(staged, ROWID, t.next_row)
        for column, start in t.sequences.items():
            out = out.withColumn(column, F.col(ROWID) - t.next_row + start)
        out = out.select(ROWID, *(quote_name(x.name) for x in t.columns))
        self._validate(t, out, appended=True)
        files = self.catalog.write(name, out) if count else []
        last = None
        for column in t.sequences:
            last = t.sequences[column]
            t.sequences[column] += count
        t.files += files
        t.next_row += count
        t.rows += count
        self._extend_indexes(t, files)
        self._drop_staged()
        self._commit(name)
        if name == SCRIPTS:
            self._load_scripts()
        return ExecResult(count, last if count else None, f"{count} row(s) inserted")

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Rows written once, so that every later step reads the same ones."""
        self._stage = f"{self.catalog.root}/.stage-{uuid.uuid4().hex}"
        rows.write.parquet(self._stage)
        return self.spark.read.schema(rows.schema).parquet(self._stage)

    def _drop_staged(self) -> None:
        self.catalog.files.delete(self._stage)
        self._stage = None

    def _check_lengths(self, t: Table, rows: DataFrame, columns: list[str]) -> None:
        for x in (x for x in t.columns if x.length and x.name in columns):
            if not rows.where(F.char_length(F.col(quote_name(x.name)).cast("string")) > x.length).isEmpty():
                raise ConstraintError(f"a value is too long for column {x.name} ({x.type})")

    def _validate(self, t: Table, new: DataFrame, appended: bool) -> None:
        """Check a table's constraints: for new rows against the table, or for a whole new version."""
        required = [x for x in t.columns if not x.nullable and not x.auto]
        if required:
            bad = new.agg(*(F.count_if(F.col(quote_name(x.name)).isNull()).alias(x.name) for x in required)).first()
            for x in required:
                if bad[x.name]:
                    raise ConstraintError(f"column {x.name} cannot be NULL")
        if not self.enforce:
            return
        for rule in t.constraints:
            columns = [quote_name(n) for n in rule.get("columns", [])]
            if rule["kind"] in ("primary", "unique") and not set(rule["columns"]) <= set(t.sequences):
                keys = new.select(*columns).dropna()
                if not keys.groupBy(*columns).count().where("count > 1").isEmpty() or appended and t.files and not keys.join(self.catalog.read(t.name).select(*columns), rule["columns"], "left_semi").isEmpty():
                    raise ConstraintError(f"duplicate key for {', '.join(rule['columns'])}")
            elif rule["kind"] == "foreign" and rule["table"] in self.catalog.tables:
                other = self.catalog.read(rule["table"]).select(*(F.col(quote_name(n)).alias(m) for n, m in zip(rule["others"], rule["columns"], strict=True)))
                if not new.select(*columns).dropna().join(other, rule["columns"], "left_anti").isEmpty():
                    raise ConstraintError(f"no row of {rule['table']} for {', '.join(rule['columns'])}")
            elif rule["kind"] == "check":
                text = Rewriter(None, self.variables).rewrite(split_statements(rule["text"])[0])
                if not new.where(f"NOT ({text})").isEmpty():
                    raise ConstraintError(f"check failed: {rule['text']}")

    def _hits(self, name: str, condition: list[Token], limit: int | None) -> tuple[DataFrame, list[str], int]:
        """Row ids that a condition holds for, the data files that have them, and how many there are."""
        view = f"__target_{uuid.uuid4().hex}"
        has_files = bool(self.catalog.table(name).files)
        self.catalog.read(name).withColumn("__file", F.col("_metadata.file_path") if has_files else F.lit("")).createOrReplaceTempView(view)
        views = [view]
        try:
            text = Rewriter(self._matcher({name: name}, views), self.variables).rewrite(condition) if condition else "true"
            found = self.spark.sql(f"SELECT {ROWID}, __file FROM {view} AS {quote_name(name)} WHERE {text}")
            if limit is not None:
                found = found.orderBy(ROWID).limit(limit)
            found = self._staged(found)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)
        counts = {r[0]: r[1] for r in found.groupBy("__file").count().collect()}  # a row a data file
        names = {"/".join(k.rsplit("/", 2)[1:]) for k in counts}
        touched = [f for f in self.catalog.table(name).files if f.split("/", 1)[1] in names]
        return found.select(ROWID), touched, sum(counts.values())

    def _tail(self, c: Cursor) -> tuple[list[Token], int | None]:
        """WHERE condition and LIMIT."""
        limit = None
        rest = c.tokens[c.at :]
        if len(rest) >= 2 and rest[-2].upper == "LIMIT":
            limit, rest = int(rest[-1].text), rest[:-2]
        if rest and rest[0].upper != "WHERE":
            raise DialectError(f"unexpected {rest[0].text!r}")
        return rest[1:], limit

    def _replace(self, t: Table, touched: list[str], rows: DataFrame) -> None:
        """Put rows in place of the touched files."""
        fresh = self.catalog.write(t.name, rows)
        t.files = [f for f in t.files if f not in set(touched)] + fresh
        for index in t.indexes.values():
            if index.get("fulltext"):
                index["dead"] += touched
        self._extend_indexes(t, fresh)
        self._drop_staged()
        self._commit(t.name)
        if t.name == SCRIPTS:
            self._load_scripts()

    def _do_update(self, c: Cursor) -> ExecResult:
        t = self.catalog.table(c.name())
        c.need("SET")
        changes: dict[str, str] = {}
        while True:
            column = t.column(c.name())
            c.need("=")
            value, depth = [], 0
            while not c.done and (depth or c.peek().upper not in ("WHERE", "LIMIT") and c.peek().text != ","):
                depth += (c.peek().text == "(") - (c.peek().text == ")") if c.peek().kind == "op" else 0
                value.append(c.next())
            text = self._default(column) if len(value) == 1 and value[0].upper == "DEFAULT" else Rewriter(None, self.variables, self.host).rewrite(value)
            changes[column.name] = f"cast({text} AS BINARY)" if column.spark == "binary" else f"try_cast({text} AS {column.spark})"
            if not c.take(","):
                break
        hits, touched, count = self._hits(t.name, *self._tail(c))
        if count:
            view = f"__old_{uuid.uuid4().hex}"
            keys = {m for _, rule in self._children(t.name) for m in rule["others"]}
            self.catalog.read(t.name, touched).join(hits.withColumn("__hit", F.lit(True)), ROWID, "left").createOrReplaceTempView(view)
            try:
                new = self.spark.sql(f"SELECT {ROWID}, coalesce(__hit, false) AS __hit, {', '.join(f'CASE WHEN __hit THEN {changes[x.name]} ELSE {quote_name(x.name)} END AS {quote_name(x.name)}' if x.name in changes else quote_name(x.name) for x in t.columns)} FROM {view} AS {quote_name(t.name)}")
            finally:  # the plan holds what the view stood for
                self.spark.catalog.dropTempView(view)
            changed = new.where("__hit")
            self._check_lengths(t, changed, list(changes))
            for x in t.columns:
                if x.name in changes and x.is_char and x.length:
                    new = new.withColumn(x.name, F.rpad(x.name, x.length, " "))
            self._validate(t, changed, appended=False)
            if self.enforce and any(r["kind"] in ("primary", "unique") and set(r["columns"]) & set(changes) for r in t.constraints):
                rest = self.catalog.read(t.name, [f for f in t.files if f not in set(touched)])
                self._validate(t, new.drop("__hit").unionByName(rest), appended=False)
            if keys & set(changes):
                rest = self.catalog.read(t.name, [f for f in t.files if f not in set(touched)])
                self._keep_parents(t.name, new.drop("__hit").unionByName(rest))
            self._replace(t, touched, new.drop("__hit"))
        else:
            self._drop_staged()
        return ExecResult(count, message=f"{count} row(s) updated")

    def _do_delete(self, c: Cursor) -> ExecResult:
        c.need("FROM")
        t = self.catalog.table(c.name())
        hits, touched, count = self._hits(t.name, *self._tail(c))
        if count:
            t.rows -= count
            self._keep_parents(t.name, self.catalog.read(t.name).join(hits, ROWID, "left_anti"))
            self._replace(t, touched, self.catalog.read(t.name, touched).join(hits, ROWID, "left_anti"))
        else:
            self._drop_staged()
        return ExecResult(count, message=f"{count} row(s) deleted")

    def _children(self, name: str) -> list[tuple[str, dict]]:
        """Tables with a foreign key to a table, and the rule."""
        return [(t.name, r) for t in self.catalog.tables.values() for r in t.constraints if r["kind"] == "foreign" and r["table"] == name]

    def _keep_parents(self, name: str, left: DataFrame) -> None:
        """Raise if the rows ``left`` of a table lack one that another table's rows refer to."""
        for child, rule in self._children(name) if self.enforce else []:
            rows = left if child == name else self.catalog.read(child)
            keys = left.select(*(F.col(quote_name(n)).alias(m) for n, m in zip(rule["others"], rule["columns"], strict=True)))
            if not rows.select(*(quote_name(n) for n in rule["columns"])).dropna().join(keys, rule["columns"], "left_anti").isEmpty():
                raise ConstraintError(f"rows of {child} refer to a row of {name}")

    def _do_truncate(self, c: Cursor) -> ExecResult:
        c.take("TABLE")
        t = self.catalog.table(c.name())
        t.files, t.rows, t.sequences = [], 0, dict.fromkeys(t.sequences, 1)
        for index in t.indexes.values():
            index.update(segments=[], dead=[])
        self._commit(t.name)
        return ExecResult(message="Table truncated")

    # -- definitions ---------------------------------------------------------------------------

    def _do_create(self, c: Cursor) -> ExecResult:
        if c.take("TABLE"):
            table, lenient = create_table(c)
            if table.name in self.catalog.tables:
                if lenient:
                    return ExecResult(message="Table exists")
                raise DialectError(f"table {table.name} exists")
            self.catalog.tables[table.name] = table
            self._commit(table.name)
            return ExecResult(message="Table created")
        if c.take("DATABASE") or c.take("SCHEMA"):
            lenient = c.take("IF", "NOT", "EXISTS")
            path = f"{self.root}/{c.name()}"
            if self.catalog.files.exists(path) and not lenient:
                raise DialectError("database exists")
            self.catalog.files.make(path)
            return ExecResult(1, message="Database created")
        return self._create_index(create_index(c))

    def _create_index(self, spec: IndexSpec) -> ExecResult:
        t = self.catalog.table(spec.table)
        columns = [t.column(n).name for n in spec.columns]
        entry = {"columns": columns, "unique": spec.unique, "fulltext": spec.fulltext, "options": spec.options, "segments": [], "dead": []}
        if spec.unique and self.enforce:
            t.constraints.append({"kind": "unique", "name": spec.name, "columns": columns})
            self._validate(t, self.catalog.read(t.name), appended=False)
        t.indexes[spec.name] = entry
        if spec.fulltext:
            self._extend_indexes(t, t.files, [spec.name])
        self._commit()
        return ExecResult(message="Index created")

    def _extend_indexes(self, t: Table, files: list[str], names: list[str] | None = None) -> None:
        """Index new data files: one more segment of each full-text index."""
        for name, index in t.indexes.items():
            if index["fulltext"] and files and (names is None or name in names):
                rows = self.catalog.read(t.name, files).withColumn("__file", F.col("_metadata.file_name"))
                segment = f"fts/{uuid.uuid4().hex}"
                names = [f.rsplit("/", 1)[-1] for f in files]
                numbers = self.spark.createDataFrame(list(enumerate(names, 1)), "__number int, __file string")
                rows = rows.join(F.broadcast(numbers), "__file").withColumn("key", F.struct(ROWID, "__number"))  # a row a data file
                stored = F.struct(F.col(f"key.{ROWID}"), F.element_at(F.split(F.lit("/".join(names)), "/"), F.col("key.__number")).alias("__file"))
                fts.build(rows, "key", index["columns"][0], fts.FtsConfig.parse(index["options"]), f"{self.catalog.root}/{segment}", once=True, stored=stored)
                index["segments"].append(segment)

    def _index_parts(self, index: dict, terms: list[str] | None) -> tuple[DataFrame, DataFrame]:
        parts = fts.load(self.spark, [f"{self.catalog.root}/{s}" for s in index["segments"]], f"key struct<{ROWID}:bigint,__file:string>", terms)
        dead = [f.rsplit("/", 1)[-1] for f in index["dead"]]
        out = []
        for df in parts:
            live = df.where(~F.col("key.__file").isin(dead)) if dead else df
            out.append(live.withColumn(ROWID, F.col(f"key.{ROWID}")).drop("key"))
        return out[0], out[1]

    def search_rows(self, table: str, index: dict, query: str, level: int | None = None) -> DataFrame:
        """Row ids that have all terms of a query."""
        terms = fts.query_terms(query, fts.FtsConfig.parse(index["options"]), level)
        if not index["segments"] or not terms:
            return self.spark.createDataFrame([], f"{ROWID} long")
        return fts.search(self._index_parts(index, terms)[0], ROWID, terms, level)

    def search(self, table: str, column: str, query: str, limit: int | None = 10, level: int | None = None) -> DataFrame:
        """Ranked search: the table's rows with their score, best first, ties in row order. None: all rows."""
        index = next((x for x in self.catalog.table(table).indexes.values() if x["fulltext"] and x["columns"][0].lower() == column.lower()), None)
        if index is None:
            raise DialectError(f"no full-text index on {table}.{column}")
        terms = fts.query_terms(query, fts.FtsConfig.parse(index["options"]), level)
        rows = self.catalog.read(table)
        if not index["segments"] or not terms:
            return rows.withColumn("score", F.lit(0.0)).limit(0).drop(ROWID)
        found = fts.ranked(self._index_parts(index, terms)[0], self._index_parts(index, None)[1], ROWID, terms, level)
        out = rows.join(found, ROWID).orderBy(F.desc("score"), ROWID)
        return (out if limit is None else out.limit(limit)).drop(ROWID)

    def index_stats(self, table: str, name: str) -> DataFrame:
        return fts.index_stats(self._index_parts(self.catalog.table(table).indexes[name], None)[0], ROWID)

    def _do_drop(self, c: Cursor) -> ExecResult:
        if c.take("TABLE"):
            lenient = c.take("IF", "EXISTS")
            while True:
                name = c.name()
                if name not in self.catalog.tables and not lenient:
                    raise KeyError(f"table {name} does not exist")
                if self.catalog.tables.pop(name, None):
                    self.spark.catalog.dropTempView(name)
                if not c.take(","):
                    break
            self.catalog.commit()
            return ExecResult(message="Table dropped")
        if c.take("DATABASE") or c.take("SCHEMA"):
            lenient = c.take("IF", "EXISTS")
            if not self.catalog.files.delete(f"{self.root}/{c.name()}") and not lenient:
                raise DialectError("database does not exist")
            return ExecResult(message="Database dropped")
        c.take("FULLTEXT")
        c.need("INDEX")
        lenient = c.take("IF", "EXISTS")
        name = c.name()
        owners = [c.name()] if c.take("ON") else list(self.catalog.tables)
        dropped = [t for t in owners if self.catalog.table(t).indexes.pop(name, None) is not None]
        for t in dropped:
            self.catalog.table(t).constraints = [r for r in self.catalog.table(t).constraints if r["name"] != name]
        if not dropped and not lenient:
            raise DialectError(f"index {name} does not exist")
        self.catalog.commit()
        return ExecResult(message="Index dropped")

    def _do_alter(self, c: Cursor) -> ExecResult:
        c.need("TABLE")
        t = self.catalog.table(c.name())
        if c.take("ADD"):
            c.take("COLUMN")
            new = parse_column(c)
            default = f"cast({self._default(new)} AS {new.spark})"
            self._reshape(t, [*t.columns, new], {new.name: default})
        elif c.take("DROP"):
            c.take("COLUMN")
            gone = t.column(c.name())
            t.columns = [x for x in t.columns if x is not gone]
            t.sequences.pop(gone.name, None)
            t.constraints = [r for r in t.constraints if gone.name not in r.get("columns", [])]
            t.indexes = {n: i for n, i in t.indexes.items() if gone.name not in i["columns"]}
            self._commit(t.name)
        elif c.take("MODIFY") or c.take("CHANGE"):
            c.take("COLUMN")
            new = parse_column(c)
            old = t.column(new.name)
            self._reshape(t, [new if x is old else x for x in t.columns], {new.name: f"try_cast({quote_name(old.name)} AS {new.spark})"})
        elif c.take("RENAME"):
            if c.take("COLUMN"):
                old = t.column(c.name())
                c.need("TO")
                new = Column(**{**old.__dict__, "name": c.name()})
                t.sequences = {new.name if k == old.name else k: v for k, v in t.sequences.items()}
                for holder in [*t.constraints, *t.indexes.values()]:
                    holder["columns"] = [new.name if n == old.name else n for n in holder.get("columns", [])]
                self._reshape(t, [new if x is old else x for x in t.columns], {new.name: quote_name(old.name)})
            else:
                c.take("TO")
                old_name, t.name = t.name, c.name()
                self.catalog.tables[t.name] = self.catalog.tables.pop(old_name)
                self.spark.catalog.dropTempView(old_name)
                self._commit(t.name)
        else:
            raise DialectError(f"unexpected {c.peek().text!r}")
        c.end()
        return ExecResult(message="Table altered")

    def _reshape(self, t: Table, columns: list[Column], made: dict[str, str]) -> None:
        """Write a table's rows anew with other columns."""
        rows = self.catalog.read(t.name)
        rows = rows.selectExpr(ROWID, *(f"{made.get(x.name, quote_name(x.name))} AS {quote_name(x.name)}" for x in columns))
        t.columns, had = columns, bool(t.files)
        self._validate(t, rows, appended=False)
        if had:
            t.files = self.catalog.write(t.name, rows)
            for index in t.indexes.values():
                index.update(segments=[], dead=[])
            self._extend_indexes(t, t.files)
        self._commit(t.name)

    # -- session commands ----------------------------------------------------------------------

    def _do_use(self, c: Cursor) -> ExecResult:
        return self.use(c.name())

    def _do_set(self, c: Cursor) -> ExecResult:
        while not c.done:
            for scope in ("GLOBAL", "SESSION"):
                c.take(scope)
            name = c.next().text.lstrip("@").split(".")[-1].lower()
            c.take("=") or c.take(":=") or c.take("TO")
            value = []
            while not c.done and c.peek().text != ",":
                value.append(c.next())
            self.variables[name] = text_of(value) if len(value) != 1 or value[0].kind != "word" or value[0].upper in ("NULL", "TRUE", "FALSE") else quote_string(value[0].text)
            c.take(",")
        return ExecResult()

    def _do_begin(self, c: Cursor) -> ExecResult:
        return ExecResult(message="Every statement commits by itself")

    _do_start = _do_commit = _do_rollback = _do_begin

    def _do_backup(self, c: Cursor) -> ExecResult:
        c.take("DATABASE")
        c.need("TO")
        target = string_value(c.next()).rstrip("/")
        if self.catalog.files.exists(target):
            raise DialectError(f"{target} exists")
        self.catalog.files.copy(self.catalog.root, target)  # nothing in it is deleted, so another writer's files are safe
        return ExecResult(message=f"Backup written to {target}")

    def _do_restore(self, c: Cursor) -> ExecResult:
        c.take("DATABASE")
        c.need("FROM")
        source = string_value(c.next()).rstrip("/")
        old = f"{self.catalog.root}.before-{uuid.uuid4().hex}"
        if not self.catalog.files.is_dir(source):
            raise DialectError(f"{source} does not exist")
        fresh = f"{self.catalog.root}.restored-{uuid.uuid4().hex}"
        try:
            self.catalog.files.copy(source, fresh)
        except Exception:
            self.catalog.files.delete(fresh)
            raise
        self.close()
        self.catalog.files.rename(self.catalog.root, old)
        try:
            self.catalog.files.rename(fresh, self.catalog.root)
        except Exception:
            self.catalog.files.rename(old, self.catalog.root)
            raise
        self.catalog.files.delete(old)
        self.use(self.database)
        return ExecResult(message=f"Restored from {source}")

    def _load_scripts(self) -> None:
        """Compile the script table's rows; changed rows take effect at once."""
        rows = self.catalog.read(SCRIPTS).collect()  # a table of function definitions
        self.catalog.scripts = {r["name"]: {"script": r["script"], "description": r["description"] or "" if "description" in r else ""} for r in rows if r["name"] and r["script"]}
        for name, s in self.catalog.scripts.items():
            self.spark.sql(scripts.create_statement(name, s["script"], s["description"]))
        self.catalog.commit()

    # -- catalog as rows -----------------------------------------------------------------------

    def _rows(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @staticmethod
    def _key(t: Table, x: Column) -> str:
        kinds = {r["kind"] for r in t.constraints if x.name in r.get("columns", [])}
        return "PRI" if x.primary or "primary" in kinds else "UNI" if "unique" in kinds else "MUL" if "foreign" in kinds else ""

    def _do_describe(self, c: Cursor) -> DataFrame:
        c.take("TABLE")
        t = self.catalog.table(c.name())
        return self._rows("Field string, Type string, Null string, Key string, Default string", [(x.name, x.type, "YES" if x.nullable else "NO", self._key(t, x), x.default) for x in t.columns])

    _do_desc = _do_describe

    def _do_show(self, c: Cursor) -> DataFrame:
        full, like, tables = c.take("FULL"), None, self.catalog.tables
        rest = [t.upper or t.text for t in c.tokens[c.at :]]
        if "LIKE" in rest:
            like = string_value(c.tokens[c.at + rest.index("LIKE") + 1])
        word = rest[0] if rest else ""
        if word == "TABLES":
            out = self._rows("Tables string, Table_type string", [(n, "BASE TABLE") for n in sorted(tables)])
            out = (out if full else out.drop("Table_type")).withColumnRenamed("Tables", f"Tables_in_{self.database}")
        elif word in ("COLUMNS", "FIELDS"):
            c.at += 1
            c.take("FROM") or c.take("IN")
            return self._do_describe(c)
        elif word == "CREATE":
            c.at += 2
            t = self.catalog.table(c.name())
            lines = [f"  {quote_name(x.name)} {x.type}{'' if x.nullable else ' NOT NULL'}{f' DEFAULT {x.default}' if x.default else ''}{' AUTO_INCREMENT' if x.auto else ''}" for x in t.columns]
            return self._rows("Table string, `Create Table` string", [(t.name, f"CREATE TABLE {quote_name(t.name)} (\n" + ",\n".join(lines) + "\n)")])
        elif word in ("DATABASES", "SCHEMAS"):
            out = self._rows("Database string", [(n,) for n in self.catalog.files.list(self.root) if self.catalog.files.is_dir(f"{self.root}/{n}")])
        elif word in ("VARIABLES", "GLOBAL", "SESSION"):
            out = self._rows("Variable_name string, Value string", [(k, v.strip("'")) for k, v in sorted(self.variables.items())])
        elif word == "STATUS":
            out = self._rows("Variable_name string, Value string", [("Tables", str(len(tables))), ("Catalog_version", str(self.catalog.version))])
        elif word == "TABLE":
            out = self._rows("Name string, Engine string, Rows long, Data_files long", [(n, "Parquet", t.rows, len(t.files)) for n, t in sorted(tables.items())])
        elif word in ("INDEX", "INDEXES", "KEYS"):
            t = self.catalog.table(c.tokens[-1].text.strip("`"))
            return self.information_schema("STATISTICS").where(F.col("TABLE_NAME") == t.name)
        elif word == "ENGINES":
            out = self._rows("Engine string, Support string, Comment string", [("Parquet", "DEFAULT", "versioned Parquet snapshots")])
        elif word in ("COLLATION", "CHARACTER"):
            out = self._rows("Collation string, Charset string", [("utf8mb4_general_ci", "utf8mb4")])
        elif word == "GRANTS":
            out = self._rows("Grants string", [("GRANT ALL PRIVILEGES ON *.*",)])
        elif word in ("WARNINGS", "ERRORS"):
            out = self._rows("Level string, Code int, Message string", [])
        elif word == "PROCESSLIST":
            out = self.information_schema("PROCESSLIST")
        elif word in ("FUNCTION", "PROCEDURE", "TRIGGERS", "EVENTS", "OPEN"):
            names = [(self.database, f"xx_{n}") for n in sorted(self.catalog.scripts)] if word == "FUNCTION" else [(self.database, n) for n in sorted(tables)] if word == "OPEN" else []
            out = self._rows("Db string, Name string", names)
        else:
            raise DialectError(f"cannot show {word}")
        return out.where(F.col(out.columns[0]).like(like)) if like is not None else out

    def information_schema(self, kind: str) -> DataFrame:
        """A virtual table of the catalog; WHERE, ORDER BY and LIMIT work as on any table."""
        tables, db = self.catalog.tables.values(), self.database
        if kind == "TABLES":
            return self._rows("TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, ENGINE string, TABLE_ROWS long", [("def", db, t.name, "BASE TABLE", "Parquet", t.rows) for t in tables])
        if kind == "COLUMNS":
            return self._rows("TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, COLUMN_DEFAULT string, IS_NULLABLE string, DATA_TYPE string, COLUMN_TYPE string, COLUMN_KEY string, EXTRA string", [(db, t.name, x.name, i, x.default, "YES" if x.nullable else "NO", x.type.split("(")[0].lower(), x.type.lower(), self._key(t, x), "auto_increment" if x.auto else "") for t in tables for i, x in enumerate(t.columns, 1)])
        if kind == "SCHEMATA":
            return self._rows("CATALOG_NAME string, SCHEMA_NAME string, DEFAULT_CHARACTER_SET_NAME string", [("def", n, "utf8mb4") for n in self.catalog.files.list(self.root)])
        if kind == "PROCESSLIST":
            return self._rows("ID long, USER string, DB string, COMMAND string", [(1, self.spark.sparkContext.sparkUser(), db, "Query")])
        rules = [(t, r, r["name"] or f"{r['kind']}_{t.name}_{'_'.join(r.get('columns', []))}") for t in tables for r in t.constraints]
        if kind == "TABLE_CONSTRAINTS":
            return self._rows("TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, CONSTRAINT_TYPE string", [(db, t.name, n, {"primary": "PRIMARY KEY", "unique": "UNIQUE", "foreign": "FOREIGN KEY", "check": "CHECK"}[r["kind"]]) for t, r, n in rules])
        if kind == "KEY_COLUMN_USAGE":
            return self._rows("TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, REFERENCED_TABLE_NAME string, REFERENCED_COLUMN_NAME string", [(db, t.name, n, x, i, r.get("table"), (r.get("others") or [None] * i)[i - 1]) for t, r, n in rules for i, x in enumerate(r.get("columns", []), 1)])
        if kind == "STATISTICS":
            return self._rows("TABLE_SCHEMA string, TABLE_NAME string, INDEX_NAME string, COLUMN_NAME string, SEQ_IN_INDEX int, NON_UNIQUE int, INDEX_TYPE string", [(db, t.name, n, x, i, int(not e["unique"]), "FULLTEXT" if e["fulltext"] else "NONE") for t in tables for n, e in t.indexes.items() for i, x in enumerate(e["columns"], 1)])
        raise DialectError(f"unknown table information_schema.{kind}")

"""Tables over their life: DDL, DML, constraints, full text, scripts, files, imports."""

import sqlite3

import pytest

from lumenql import dbapi
from lumenql.__main__ import command
from lumenql.dialect import DialectError
from lumenql.session import ConstraintError, Engine
from lumenql.sources import importers
from lumenql.store import StaleError


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    yield e
    e.close()


def rows(engine, sql, *parameters):
    return [tuple(r) for r in engine.execute(sql, list(parameters)).collect()]


@pytest.fixture
def users(engine):
    engine.execute("CREATE TABLE users (id SEQ, name VARCHAR(100) NOT NULL, email VARCHAR(100) UNIQUE, age INT DEFAULT 18)")
    engine.execute("INSERT INTO users (name, email, age) VALUES ('Wanda', 'a@x', 30), ('Otto', 'b@x', 25), ('Nils', NULL, 35)")
    return engine


def test_crud(users):
    assert rows(users, "SELECT id, name, age FROM users ORDER BY id") == [(1, "Wanda", 30), (2, "Otto", 25), (3, "Nils", 35)]
    assert users.execute("INSERT INTO users (name) VALUES (upper('zed'))").last_insert_id == 4
    assert users.execute("UPDATE users SET age = age + 1, email = concat(name, '@y') WHERE age > 26").rows_affected == 2
    assert rows(users, "SELECT id, email, age FROM users ORDER BY id") == [(1, "Wanda@y", 31), (2, "b@x", 25), (3, "Nils@y", 36), (4, None, 18)]
    assert users.execute("DELETE FROM users WHERE name LIKE 'O%' OR id IN (SELECT max(id) FROM users)").rows_affected == 2
    assert rows(users, "SELECT count(*), sum(age) FROM users") == [(2, 67)]
    assert users.execute("DELETE FROM users WHERE age > 1000").rows_affected == 0
    assert users.execute("UPDATE users SET age = NULL LIMIT 1").rows_affected == 1
    assert rows(users, "SELECT id FROM users WHERE age IS NULL") == [(1,)]


def test_a_failed_statement_changes_nothing(users):
    for sql in ("INSERT INTO users (name, email) VALUES ('Ok', 'ok@x'), ('D', 'b@x')", "INSERT INTO users (name) VALUES (NULL)", "UPDATE users SET email = 'same'", "INSERT INTO users (name) VALUES (repeat('x', 101))"):
        with pytest.raises(ConstraintError):
            users.execute(sql)
    assert rows(users, "SELECT count(*) FROM users") == [(3,)]


def test_only_touched_files_are_rewritten(users):
    before = set(users.catalog.table("users").files)
    users.execute("INSERT INTO users (name) VALUES ('Dora')")
    added = set(users.catalog.table("users").files) - before
    users.execute("UPDATE users SET age = 1 WHERE name = 'Dora'")
    after = set(users.catalog.table("users").files)
    assert before <= after and not added & after


def test_reopen_and_second_writer(users, spark, tmp_path):
    other = Engine(spark, str(tmp_path / "db"))
    assert rows(other, "SELECT count(*) FROM users") == [(3,)]
    users.execute("DELETE FROM users WHERE id = 1")
    with pytest.raises(RuntimeError):
        other.execute("DELETE FROM users WHERE id = 2")


def test_a_stale_writer_is_told(users, spark, tmp_path):
    """Also if it is several versions behind; it sees the newest afterwards."""
    other = Engine(spark, str(tmp_path / "db"))
    for i in range(3):
        other.execute(f"INSERT INTO users (name) VALUES ('n{i}')")
    with pytest.raises(StaleError):
        users.execute("INSERT INTO users (name) VALUES ('lost')")
    assert users.execute("INSERT INTO users (name) VALUES ('kept')").rows_affected == 1
    assert rows(Engine(spark, str(tmp_path / "db")), "SELECT count(*) FROM users") == [(7,)]


def test_stale_backup_and_vacuum_delete_nothing(users, spark, tmp_path):
    other = Engine(spark, str(tmp_path / "db"))
    other.execute("INSERT INTO users (name) VALUES ('Dora'); UPDATE users SET age = 1")
    users.execute(f"BACKUP TO '{tmp_path}/bk'")
    assert users.catalog.vacuum() == 0
    assert rows(other, "SELECT count(*), min(age) FROM users") == [(4, 1)]
    assert users.catalog.vacuum(keep=0) > 0
    assert rows(Engine(spark, str(tmp_path / "db")), "SELECT count(*), min(age) FROM users") == [(4, 1)]
    users.execute(f"RESTORE FROM '{tmp_path}/bk'")
    assert rows(users, "SELECT count(*) FROM users") == [(4,)]


def test_failed_definitions_leave_nothing(users, tmp_path):
    users.execute("INSERT INTO users (name, age) VALUES ('Eve', 30)")
    with pytest.raises(ConstraintError):
        users.execute("CREATE UNIQUE INDEX u ON users(age)")
    with pytest.raises(ConstraintError):
        users.execute("ALTER TABLE users ADD COLUMN must INT NOT NULL")
    with pytest.raises(ConstraintError):
        users.execute("INSERT INTO users (name) VALUES (NULL)")
    assert users.execute("INSERT INTO users (name, age) VALUES ('Fay', 30)").rows_affected == 1
    users.execute("DELETE FROM users WHERE id = 99")
    assert not [n for n in (tmp_path / "db" / "main").iterdir() if n.name.startswith(".stage")]


def test_parents_stay(users):
    users.execute("CREATE TABLE posts (uid INT, FOREIGN KEY (uid) REFERENCES users(id)); INSERT INTO posts VALUES (1), (NULL)")
    for sql in ("DELETE FROM users WHERE id < 3", "UPDATE users SET id = 50 WHERE id = 1"):
        with pytest.raises(ConstraintError):
            users.execute(sql)
    assert users.execute("DELETE FROM users WHERE id = 2").rows_affected == 1


def test_match_names_its_table(users):
    users.execute("CREATE TABLE p (id INT, body TEXT); INSERT INTO p VALUES (1, 'alpha'), (2, 'beta')")
    users.execute("CREATE TABLE q (pid INT, body TEXT); INSERT INTO q VALUES (1, 'beta'), (2, 'gamma')")
    users.execute("CREATE FULLTEXT INDEX fp ON p(body); CREATE FULLTEXT INDEX fq ON q(body)")
    assert rows(users, "SELECT p.id FROM p JOIN q ON p.id = q.pid WHERE MATCH(q.body) AGAINST('beta')") == [(1,)]
    assert rows(users, "SELECT a.id FROM p AS a JOIN q b ON a.id = b.pid WHERE MATCH(a.body) AGAINST('beta') AND MATCH(b.body) AGAINST('gamma')") == [(2,)]
    assert rows(users, "SELECT * FROM p WHERE MATCH(body) AGAINST('alpha')") == [(1, "alpha")]
    assert users.execute("SELECT * FROM p").columns == ["id", "body"]
    users.execute("CREATE TABLE r (id INT, body TEXT); INSERT INTO r SELECT * FROM p WHERE MATCH(body) AGAINST('beta')")
    assert rows(users, "SELECT * FROM r") == [(2, "beta")]
    assert rows(users, "SELECT id FROM r WHERE MATCH(r.body) AGAINST('ET')") == [(2,)]
    assert rows(users, "SELECT id, MATCH(body) AGAINST('beta') AS hit FROM p ORDER BY id") == [(1, False), (2, True)]
    assert not [v for v in users.spark.catalog.listTables() if v.name.startswith("__")]


def test_failed_statements_leave_no_views(users):
    users.execute("CREATE TABLE posts (uid INT, FOREIGN KEY (uid) REFERENCES users(id)); INSERT INTO posts VALUES (1)")
    users.execute("CREATE FULLTEXT INDEX fn ON users(name)")
    before = {v.name for v in users.spark.catalog.listTables()}
    for sql in ("UPDATE users SET id = 50 WHERE id = 1", "UPDATE users SET age = nowhere WHERE id = 1", "DELETE FROM users WHERE nowhere = 1", "SELECT nowhere FROM users WHERE MATCH(name) AGAINST('alice')"):
        with pytest.raises(Exception):  # noqa: B017
            users.execute(sql)
        assert {v.name for v in users.spark.catalog.listTables()} == before, sql


def test_dumps_go_on_after_bad_rows(engine):
    dump = "CREATE TABLE d (id INT PRIMARY KEY, t VARCHAR(3)); INSERT INTO d VALUES (1, 'a'); INSERT INTO d VALUES (1, 'b'); INSERT INTO d VALUES (2, 'toolong'); INSERT INTO d VALUES (3, 'c')"
    assert importers.import_dump(engine, dump) == {"done": 3, "skipped": 0, "failed": 2}
    assert rows(engine, "SELECT id FROM d ORDER BY id LIMIT 1, 1") == [(3,)]


def test_constraints(users):
    users.execute("CREATE TABLE t (code CHAR(5), uid INT, FOREIGN KEY (uid) REFERENCES users(id), CHECK (uid < 100), PRIMARY KEY (code))")
    users.execute("INSERT INTO t VALUES ('ab', 1)")
    assert rows(users, "SELECT concat('[', code, ']') FROM t") == [("[ab   ]",)]
    for sql in ("INSERT INTO t VALUES ('x', 77)", "INSERT INTO t VALUES ('abcdef', 1)", "INSERT INTO t VALUES ('ab', 2)", "INSERT INTO t VALUES (NULL, 2)"):
        with pytest.raises(ConstraintError):
            users.execute(sql)


def test_insert_forms(users):
    users.execute("CREATE TABLE t (a INT DEFAULT 7, b VARCHAR(10) DEFAULT 'x', d DATE)")
    users.execute("INSERT INTO t DEFAULT VALUES")
    users.execute("INSERT INTO t (b, a) SELECT name, age FROM users WHERE id = 1")
    users.execute("INSERT INTO t VALUES (DEFAULT, 'y', '2024-01-02'), ('12', 3, NULL)")
    assert sorted(rows(users, "SELECT a, b, cast(d AS VARCHAR(10)) FROM t"), key=repr) == sorted([(7, "x", None), (30, "Wanda", None), (7, "y", "2024-01-02"), (12, "3", None)], key=repr)


def test_alter(users):
    users.execute("ALTER TABLE users ADD COLUMN city VARCHAR(10) DEFAULT 'x'; ALTER TABLE users RENAME COLUMN city TO town; ALTER TABLE users MODIFY age FLOAT; ALTER TABLE users DROP COLUMN email")
    assert rows(users, "SELECT * FROM users WHERE id = 1") == [(1, "Wanda", 30.0, "x")]
    users.execute("ALTER TABLE users RENAME TO people")
    assert rows(users, "SELECT count(*) FROM people") == [(3,)]
    users.execute("TRUNCATE TABLE people; INSERT INTO people (name) VALUES ('new')")
    assert rows(users, "SELECT id FROM people") == [(1,)]
    users.execute("DROP TABLE people")
    with pytest.raises(KeyError):
        users.execute("DELETE FROM people")


def test_catalog(users):
    assert [r[0] for r in rows(users, "DESCRIBE users")] == ["id", "name", "email", "age"]
    assert rows(users, "SHOW TABLES LIKE 'us%'") == [("users",)]
    assert rows(users, "SELECT COLUMN_NAME FROM information_schema.columns WHERE COLUMN_KEY = 'UNI'") == [("email",)]
    users.execute("SET names = utf8")
    assert rows(users, "SELECT @@names") == [("utf8",)]
    for what in ("DATABASES", "VARIABLES", "STATUS", "TABLE STATUS", "ENGINES", "INDEX FROM users", "GRANTS", "WARNINGS", "COLLATION", "FUNCTION STATUS", "TRIGGERS", "PROCESSLIST", "COLUMNS FROM users", "CREATE TABLE users", "FULL TABLES"):
        users.execute(f"SHOW {what}").collect()
    for kind in ("TABLES", "SCHEMATA", "PROCESSLIST", "TABLE_CONSTRAINTS", "KEY_COLUMN_USAGE", "STATISTICS"):
        rows(users, f"SELECT * FROM information_schema.{kind}")


def test_databases_and_sessions(users):
    users.execute("CREATE DATABASE other; USE other; CREATE TABLE t (a INT); USE main")
    assert rows(users, "SELECT count(*) FROM users") == [(3,)]
    users.execute("BEGIN; COMMIT; DROP DATABASE other")
    with pytest.raises(DialectError):
        users.execute("EXPLODE users")


def test_names_outside_ascii(engine):
    engine.execute("CREATE TABLE haltestellen (nr SEQ, straße VARCHAR(40), fahrgäste INT)")
    engine.execute("INSERT INTO haltestellen (straße, fahrgäste) VALUES ('Mühlweg', 7), ('Καλλιθέα', 12), ('Mühlweg', 5), ('Öresund', 1)")
    assert sorted(rows(engine, "SELECT straße, sum(fahrgäste) FROM haltestellen GROUP BY straße")) == [("Mühlweg", 12), ("Öresund", 1), ("Καλλιθέα", 12)]
    assert rows(engine, "SELECT nr FROM haltestellen WHERE straße LIKE '_resund'") == [(4,)]


def test_full_text(users):
    users.execute("CREATE FULLTEXT INDEX f ON users(name) WITH (LEVELS='1,2,3')")
    assert rows(users, "SELECT id FROM users WHERE MATCH(name) AGAINST('WANDA')") == [(1,)]
    assert rows(users, "SELECT * FROM users WHERE MATCH(name) AGAINST('otto')") == [(2, "Otto", "b@x", 25)]
    assert sorted(rows(users, "SELECT id FROM users WHERE MATCH(name) AGAINST('wa' LEVEL 2) OR age = 35")) == [(1,), (3,)]
    users.execute("UPDATE users SET name = 'Wanda Cooper' WHERE id = 1; INSERT INTO users (name) VALUES ('Cooper')")
    assert sorted(rows(users, "SELECT id FROM users WHERE MATCH(name) AGAINST('cooper')")) == [(1,), (4,)]
    users.execute("DELETE FROM users WHERE MATCH(name) AGAINST('wanda')")
    assert rows(users, "SELECT id FROM users WHERE MATCH(name) AGAINST('cooper')") == [(4,)]
    assert [r["name"] for r in users.search("users", "name", "cooper").collect()] == ["Cooper"]
    users.execute("DROP INDEX f")
    assert rows(users, "SELECT id FROM users WHERE MATCH(name) AGAINST('oope')") == [(4,)]


def test_scripts(users):
    users.execute("CREATE TABLE xxscript (name VARCHAR(50), script TEXT, description TEXT)")
    users.execute("INSERT INTO xxscript VALUES ('add', '$1 + $2', 'sum'), ('hi', 'Hello ${1}!', '')")
    assert rows(users, "SELECT xx_add(10, 5), xx_hi('you')") == [(15.0, "Hello you!")]
    users.execute("UPDATE xxscript SET script = '$1 * $2' WHERE name = 'add'")
    assert rows(users, "SELECT xx_add(10, 5)") == [(50.0,)]


def test_parameters_and_dbapi(spark, users, tmp_path):
    assert rows(users, "SELECT id FROM users WHERE name = ? AND '?' = '?' AND age > $2", "Wanda", 3) == [(1,)]
    c = dbapi.connect(spark, str(tmp_path / "other"))
    cursor = c.cursor()
    cursor.execute("CREATE TABLE t (a INT, b TEXT)")
    assert cursor.executemany("INSERT INTO t VALUES (?, ?)", [[1, "it's"], [2, None]]).rowcount == 2
    assert cursor.execute("SELECT b FROM t ORDER BY a").fetchall() == [("it's",), (None,)] and c.ping()
    with pytest.raises(dbapi.NotSupportedError):
        c.begin()


def test_backup_and_restore(users, tmp_path):
    users.execute(f"BACKUP TO '{tmp_path}/bk'; DELETE FROM users")
    assert rows(users, "SELECT count(*) FROM users") == [(0,)]
    users.execute(f"RESTORE FROM '{tmp_path}/bk'")
    assert rows(users, "SELECT count(*) FROM users") == [(3,)]


def test_files_and_folders(users, tmp_path):
    assert users.save_file(f"{tmp_path}/in/a.txt", "hello") == 1
    users.save_file(f"{tmp_path}/in/sub/b.bin", b"\x00\x01")
    found = rows(users, f"SELECT file_exists('{tmp_path}/in/a.txt'), file_size('{tmp_path}/in/a.txt'), blob_to_hex(load_file('{tmp_path}/in/a.txt')), load_file('{tmp_path}/none'), folder_files(load_folder('{tmp_path}/in'))")
    assert found == [(1, 5, "68656c6c6f", None, 2)]
    assert "[f] a.txt (5 bytes)" in rows(users, f"SELECT list_folder(load_folder('{tmp_path}/in'))")[0][0]
    users.export_folder(users.load_folder(f"{tmp_path}/in"), f"{tmp_path}/out")
    assert (tmp_path / "out/sub/b.bin").read_bytes() == b"\x00\x01"
    with pytest.raises(ValueError):
        users.export_folder(b'{"name": "x", "entries": [{"name": "..", "entries": []}]}', f"{tmp_path}/out2")


def test_imports_and_exports(engine, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.executescript("CREATE TABLE a (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, x REAL, b BLOB); CREATE TABLE e (k INT)")
        db.executemany("INSERT INTO a VALUES (?, ?, ?, ?)", [(i, f"n{i}", i / 2, bytes([i])) for i in range(100)])
    assert importers.import_sqlite(engine, str(tmp_path / "s.db")) == {"a": 100, "e": 0}
    assert rows(engine, "SELECT count(*), sum(x), min(name) FROM a") == [(100, 2475.0, "n0")]
    dump = "-- dump\nSET NAMES utf8;\nDROP TABLE IF EXISTS `d`;\nCREATE TABLE `d` (`id` int NOT NULL AUTO_INCREMENT, `t` varchar(20) DEFAULT NULL, PRIMARY KEY (`id`), KEY `k` (`t`)) ENGINE=InnoDB DEFAULT CHARSET=utf8;\nLOCK TABLES `d` WRITE;\nINSERT INTO `d` VALUES (1,'a;b'),(2,'c');\nUNLOCK TABLES;"
    assert importers.import_dump(engine, dump) == {"done": 3, "skipped": 3, "failed": 0}
    assert rows(engine, "SELECT t FROM d ORDER BY id") == [("a;b",), ("c",)]
    engine.execute(f"SELECT * FROM d INTO OUTFILE '{tmp_path}/d.csv'")
    assert engine.spark.read.option("header", True).csv(f"{tmp_path}/d.csv").count() == 2
    assert command(engine, f".export d {tmp_path}/d.json json") == "exported" and command(engine, ".version")
    assert command(engine, ".tables").count() == 3


@pytest.mark.parametrize(("source", "kind", "found"), [("mysql", "int(11) unsigned", "INT"), ("mysql", "varchar(30)", "VARCHAR(30)"), ("postgresql", "double precision", "FLOAT"), ("postgresql", "timestamp with time zone", "DATETIME"), ("oracle", "NUMBER(10)", "INT"), ("oracle", "NUMBER(10,2)", "FLOAT"), ("mssql", "nvarchar(max)", "TEXT"), ("sqlite", "CHAR(3)", "CHAR(3)"), ("mssql", "image", "IMAGE")])
def test_type_conversion(source, kind, found):
    assert importers.convert_type(source, kind) == found

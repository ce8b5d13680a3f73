"""Statements that change tables, catalog views, and script functions, run by an engine on a database of its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import Engine
from ..sources.storage import Files
from .catalog import query, table


def _engine(spark: SparkSession) -> Engine:
    """An engine on an empty database in the shared folder (in local mode, one of our own where that is unset), deleted when the interpreter ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        root = f"{shared.rstrip('/')}/lumenql-{uuid.uuid4().hex}"
        atexit.register(lambda: spark.sparkContext._jsc is not None and Files(spark).delete(root))
    elif not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    else:
        root = tempfile.mkdtemp(prefix="lumenql-")
        atexit.register(shutil.rmtree, root, True)
    return Engine(spark, root)


_CUSTOMERS = "CREATE TABLE cust (id INT PRIMARY KEY, name VARCHAR(50) NOT NULL, balance FLOAT, segment CHAR(12) DEFAULT 'NONE')"


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    e = _engine(spark)
    e.execute(_CUSTOMERS)
    e.insert_rows("cust", table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    return e


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, rpad(c_mktsegment, 12, ' ') AS segment FROM customer")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    e = _engine(spark)
    e.execute(_CUSTOMERS)
    e.execute("INSERT INTO cust SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
    return e.execute("SELECT * FROM cust")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.execute("UPDATE cust SET balance = balance * 2, name = upper(name) WHERE balance < 0")
    return e.execute("SELECT id, balance, name FROM cust")


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal > 5000 OR c_mktsegment = 'BUILDING')")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.execute("DELETE FROM cust WHERE balance > 5000 OR trim(segment) = 'BUILDING'")
    return e.execute("SELECT id FROM cust")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name AS name FROM nation")
def dml_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute("CREATE TABLE seen (id SEQ, name VARCHAR(30))")
    nation = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    e.insert_rows("seen", nation.where("n_nationkey < 10").select("n_name"), ["name"])
    e.insert_rows("seen", nation.where("n_nationkey >= 10").select("n_name"), ["name"])
    return e.execute("SELECT id, name FROM seen")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey = 1 THEN 'x' END, 'unknown') AS note, c_acctbal AS money FROM customer WHERE c_custkey <> 2")
def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.execute("ALTER TABLE cust ADD COLUMN note VARCHAR(10) DEFAULT 'unknown'; ALTER TABLE cust DROP COLUMN segment; ALTER TABLE cust RENAME COLUMN balance TO money")
    e.execute("UPDATE cust SET note = 'x' WHERE id = 1; DELETE FROM cust WHERE id = 2")
    return e.execute("SELECT id, note, money FROM cust")


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), 'that') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), 'with') AND doc_id >= 100")
def fts_match_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute("CREATE TABLE docs (doc_id INT, body TEXT)")
    e.insert_rows("docs", table(spark, sf_dir, "documents").select("doc_id", "text"))
    e.execute("CREATE FULLTEXT INDEX body_fts ON docs(body)")
    e.execute("DELETE FROM docs WHERE doc_id < 100")
    return e.execute("SELECT doc_id FROM docs WHERE MATCH(body) AGAINST('that with')")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def script_udf_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute("CREATE TABLE xxscript (name VARCHAR(50), script TEXT, description TEXT)")
    e.execute("INSERT INTO xxscript VALUES ('net', '$1 * (1 - $2)', 'price after discount')")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return e.execute("SELECT l_orderkey, l_linenumber, round(xx_net(l_extendedprice, l_discount), 4) AS net FROM lineitem")


@query("SELECT n_nationkey FROM nation WHERE n_name = 'FRANCE' OR n_nationkey > 20")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return _engine(spark).execute("SELECT n_nationkey FROM nation WHERE n_name = ? OR n_nationkey > $2", ["FRANCE", 20])


@query("SELECT * FROM (VALUES ('cust', 'id', 'int', 'PRI'), ('cust', 'name', 'varchar', ''), ('cust', 'balance', 'float', ''), ('cust', 'segment', 'char', '')) AS t(TABLE_NAME, COLUMN_NAME, DATA_TYPE, COLUMN_KEY)")
def info_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute(_CUSTOMERS)
    return e.execute("SELECT TABLE_NAME, COLUMN_NAME, DATA_TYPE, COLUMN_KEY FROM information_schema.COLUMNS ORDER BY ORDINAL_POSITION")


@query("SELECT 'cust' AS Tables_in_main, 'BASE TABLE' AS Table_type")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute(_CUSTOMERS)
    return e.execute("SHOW FULL TABLES")


@query("""SELECT * FROM (VALUES ('id', 'INT', 'NO', 'PRI', NULL), ('name', 'VARCHAR(50)', 'NO', '', NULL), ('balance', 'FLOAT', 'YES', '', NULL), ('segment', 'CHAR(12)', 'YES', '', chr(39) || 'NONE' || chr(39))) AS t("Field", "Type", "Null", "Key", "Default")""")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.execute(_CUSTOMERS)
    return e.execute("DESCRIBE cust")

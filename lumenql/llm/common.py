"""Shared plumbing of the training-data operators: tables, scratch storage, per-text map operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open is fine."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumenql-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """While a table is written, Spark deletes the shuffle files of the query once it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a re-read, not a re-run.

    ``keep`` replaces the table of the same name and deletes its predecessor. Whatever is left
    when the interpreter ends is deleted then, since lazily returned results may still read it.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", {}
        atexit.register(self.clear)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with dropped_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in filter(None, (self.at.pop(x, None) for x in names)):
            self._delete(path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(x for x in list(self.at) if x not in names))

    def clear(self) -> None:
        if getattr(self.spark.sparkContext, "_jsc", None) is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as e:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clean
            if self.spark.sparkContext._jsc is not None:
                raise RuntimeError(f"cannot delete scratch folder {path}") from e


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def released() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, beside the JVM of the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim_executors(spark: SparkSession) -> None:
    """Have every executor collect its garbage and give the heap that earlier queries grew back to the system, beside the Python workers of what follows."""
    n = 2 * spark.sparkContext.defaultParallelism  # full collections last long enough that all cores get some; an executor missed keeps what it holds
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def sliced(batch: pa.RecordBatch, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and, unless one row is larger, about ``size`` bytes."""
    rows = max(1, min(rows, rows if batch.nbytes <= size else size * batch.num_rows // batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mapper(columns: int, make: Callable[[], Callable[..., dict]], arrow: pa.Schema, rows: int | None) -> Callable:
    """The function over the Arrow batches of one task that ``map_texts`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, part = make(), None
        for batch in batches:
            for part in sliced(batch, rows) if rows else (batch,):
                got = step(*(part.column(i).to_pylist() for i in range(columns)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in zip(arrow, (got[f.name] for f in arrow), strict=True)], schema=arrow)
        if last := getattr(step, "finish", None):
            got = last()
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        if close := getattr(step, "close", None):
            close()
        step = last = close = batch = part = got = None
        released()

    return run


def map_texts(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., dict]], schema: str, rows: int | None = 1000) -> DataFrame:
    """Run ``make()`` once a task and its result on the lists of ``columns`` of each slice of an Arrow batch.

    Slices have ``rows`` rows and about 4 MB at most, so that a worker holds little at once; None leaves
    batches as the session bounds them. The function returns the output columns as lists or arrays, of
    any common length. Its ``finish``, if it has one, gives last rows; its ``close`` frees what a worker
    should not hold after the task.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.select(*columns).mapInArrow(mapper(len(columns), make, to_arrow_schema(out), rows), out)


def bounded_sample(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, the ones whose id hashes lowest: the same rows for any partitioning."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def bits_for(n: int, most: int = 26) -> int:
    """Size of a bitmap for n values that lets one in sixteen others through; 2**most bits (8 MB) at most."""
    return min(most, max(12, (16 * n).bit_length()))


def hash_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: which of the 64-bit values of the only column ``h`` occur, as a bitmap of 2**bits bits by their upper bits.

    At most it lets through more than it should, so what uses it needs an exact step behind.
    """
    word = F.shiftrightunsigned("h", 64 - bits + 6).alias("word")
    bit = F.shiftrightunsigned("h", 64 - bits).bitwiseAND(F.lit(63)).cast("int").alias("bit")
    found = hashes.select(word, bit).distinct().groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word")).join(found, "word", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x")).select(F.col("x.bits").alias("bits"))


def may_occur(h: Column, bitmap: DataFrame, bits: int) -> Column:
    """Whether the bitmap of ``hash_bits`` has a hash; never null."""
    word = F.get(bitmap.scalar(), F.shiftrightunsigned(h, 64 - bits + 6).cast("int"))
    return F.coalesce(F.getbit(word, F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))

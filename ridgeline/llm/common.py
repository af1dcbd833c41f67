"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of one run of the white space that ends a word: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: int = 4 << 20) -> None:
    """Keep Arrow batches small, in rows and in bytes: texts can be long, and a batch is whole in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: In a Python worker: operator -> how what it remembers there from one task to the next is forgotten.
_remembered: dict[str, Callable[[], None]] = {}


def in_worker(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """run, for mapInArrow, in a worker process that lives on after its stage: it remembers what one operator needs, not what all
    that ran there before did, and freed memory goes back to the system when a task starts and ends. forget: for an operator
    that keeps something from one task to the next."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [x for x in _remembered if x != operator]:
            _remembered.pop(other)()
        if forget is not None:
            _remembered[operator] = forget
        release()
        yield from run(batches)
        release()

    return alone


def release() -> None:
    """Give back what Arrow's and the system's allocators hold but nobody uses."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Whether Spark (4.1 and later) deletes a query's shuffle files at its end; earlier ones leave that to discard().
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    With clean, the shuffle files of the writing query are deleted at its end, without waiting for the JVM's collector.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


#: The folders of tables written by staged(), as long as their DataFrames are in use.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Delete tables written by staged() that nothing will read again; None and any other DataFrame is left alone.

    Spark deletes shuffle files once the driver's JVM has collected the finished queries that made
    them, which an idle driver does every half hour; asked for here, a phase's shuffles go with its tables.
    """
    session = None
    for d in tables:
        path = _folders.pop(d, None) if d is not None else None
        if path:
            session = d.sparkSession
            folder = session._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if session is not None:
        session._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key, so the same rows on every run; all of a smaller table."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(1 << 40)) < int((1 << 40) * rows / n)).limit(int(rows * 1.2) + 10)


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n

"""Helpers shared by the corpus operators: shared folder, written cuts, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that the operators split and strip at.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session (a test) that names none gets a temporary folder; on a cluster
    executors could not see that, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayreach-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of :func:`new_path` that nothing reads any more."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/wayreach-{uuid.uuid4().hex}-{name}"
    atexit.register(delete, spark, path)
    return path


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and its path: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bounds of what a fit reads of texts, in code points: of one text, and of all together.
FIT_CHARS, FIT_TOTAL_CHARS = 200_000, 64_000_000


def fit_rows(docs: DataFrame, ids: DataFrame, *also: str):
    """A pandas table of __id, __y, text and ``also`` for a bounded table of labelled ids (__id, __y).

    Ids come in the order of their hash, as long as their texts together have at
    most ``FIT_TOTAL_CHARS`` code points; a text over ``FIT_CHARS`` is not fitted
    on.  Of rows that repeat an id the one with the least text counts.
    """
    found = docs.select("doc_id", "text", *also).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    found = found.where(size <= FIT_CHARS).groupBy("__id", "__y").agg(F.min(F.struct("text", *also)).alias("__r")).select("__id", "__y", "__r.*")
    order = Window.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id")  # as few rows as ids
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("__upto", upto).where(F.col("__upto") <= FIT_TOTAL_CHARS).drop("__upto").orderBy("__id").toPandas()


def crc_mod(doc_id, n: int):
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input, as files hold them, that a task of a document shuffle aims at.
TASK_BYTES = 32 << 20


def task_count(df: DataFrame) -> int:
    """Tasks for a shuffle of ``df``: the session's shuffle partitions, or more where its files are larger.

    The optimizer's size estimate counts; where it has none, the session's number stands.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = shuffle_partitions(df.sparkSession)
    return own if size >= 1 << 60 else max(own, -(-size // TASK_BYTES))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def kept_by_worker(name: str, make):
    """What ``make()`` gives, made once in a Python worker's life and shared by its tasks.

    Functions travel by value, so a module's own globals begin anew with each task.
    One value a name is kept; a value that grows must bound itself.
    """
    home = sys.modules.setdefault("wayreach_worker_values", types.ModuleType("wayreach_worker_values"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]

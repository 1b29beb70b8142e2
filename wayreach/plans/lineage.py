"""Cuts in a plan's lineage that survive a lost executor: tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where a local session names none, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayreach-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return cut_at(df)[0]


_KEPT: dict = {}


def kept(spark: SparkSession, key: str, build) -> tuple[DataFrame, bool]:
    """(the table that ``build()`` gives, whether it was at hand): made once for a key in a session, then read.

    Keys have to name all that the table depends on.
    """
    place = (spark.sparkContext.applicationId, key)
    if place in _KEPT:
        path, schema = _KEPT[place]
        return spark.read.schema(schema).parquet(path), True
    made, path = cut_at(build())
    _KEPT[place] = path, made.schema
    return made, False

"""Results that are written once to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset a local session takes a temporary folder; on a cluster, whose executors would
    not share it, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staging_dir(spark: SparkSession) -> str:
    """Where this application's staged tables are."""
    return f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


#: The tables staged in each of the scopes that are open here.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def staged(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what led here, and later readers
    see one fixed set of rows. Results of the operators read these tables: they stay until the
    ``staging_scope`` ends that they are made in, or else until ``clear_staged``. The shuffles that led here stay until
    the driver collects its garbage; where they are to be ``freed`` they go as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for tables in _SCOPES.get():
        tables.append(path)
    with _freeing_shuffles(spark) if freed else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, so that the driver holds none of it.

    For tables that grow with the input: a staged one's files, and what is exploded from it, are many times smaller by
    Spark's measure than in memory.
    """
    return df.hint("merge")


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is staged within it; for results that are written before it ends."""
    tables: list[str] = []
    outer = _SCOPES.set((*_SCOPES.get(), tables))
    try:
        yield
    finally:
        _SCOPES.reset(outer)
        for path in tables:
            _deleted(spark, path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged; for when its results have been written."""
    _deleted(spark, staging_dir(spark))

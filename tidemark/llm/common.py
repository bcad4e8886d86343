"""What the training-data operators share: tables, staged results and Arrow text access."""

from __future__ import annotations

from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Bytes of text that a numpy kernel handles at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boxed(df: DataFrame) -> DataFrame:
    """``df`` as one column ``row``: what is put beside it clashes with no column of any name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def frugal(scan):
    """``scan``, a generator over a task's Arrow batches, that gives Arrow's free memory back at its end.

    Workers outlive their tasks, several to a core where scans follow each other in a stage, and
    each would keep what its largest batch once took.
    """

    @wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

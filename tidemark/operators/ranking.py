"""Places in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def ranged(rows: DataFrame, *keys: Column) -> DataFrame:
    """``rows`` in the order of ``keys``, with _part and _at: the range they are in and their place there.

    Staged, as another run of the range partitioning might cut elsewhere.
    """
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", at), "ranged")


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, their place from 1 in their group by ``order``; of all rows where ``group`` is empty.

    Rows are dealt out by ranges of group and order; a group's counts in the ranges it spans, which are
    few, are added up.
    """
    dealt = ranged(rows, *[F.col(c) for c in group], *order)
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = (Window.partitionBy(*group) if group else Window).orderBy("_part")
    starts = counts.select(*group, "_part", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_start"))
    return dealt.join(starts, [*group, "_part"]).select(*rows.columns, (F.col("_start") + F.col("_at") + 1).alias("pos"))

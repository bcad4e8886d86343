"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 places. Every shard owns the arcs that end in its virtual nodes. A shard holds
exactly its share of the rows: keys that find their shard full continue clockwise to the next
virtual node of a shard with room. All that is decided on the ring's place counts, which are as many
whatever the input's size; the rows themselves are ranked within their places only.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, staged

PLACES = 1 << 16


def virtual_nodes(shards: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shards that they stand for."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(each):
            step = 0
            while (place := int.from_bytes(hashlib.blake2b(f"{shard}/{k}/{step}".encode(), digest_size=2).digest(), "big")) in taken:
                step += 1
            taken[place] = shard
    places = np.array(sorted(taken))
    return places, np.array([taken[p] for p in places])


def bounded_pieces(counts: np.ndarray, shards: int, each: int) -> list[tuple[int, int, int, int]]:
    """(first rank, end rank, shard, first slot) for every run of ranks, in ring order.

    ``counts`` has the number of keys at each place. Every arc first fills its own shard; then what
    is left of each arc goes clockwise to whoever has room. A shard's room is its exact share.
    """
    ends, owners = virtual_nodes(shards, each)
    total = int(counts.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    before = np.concatenate([[0], np.cumsum(counts)])
    borders = before[ends + 1]
    # The arc that wraps around: what lies after the last node belongs to the first one.
    arcs = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(np.concatenate([[0], borders[:-1]]), borders, strict=True))]
    arcs.append((int(borders[-1]), total, 0))
    pieces, left = [], []
    for a, b, k in arcs:
        take = min(b - a, int(room[owners[k]]))
        if take:
            pieces.append((a, a + take, int(owners[k])))
            room[owners[k]] -= take
        if a + take < b:
            left.append((a + take, b, k))
    for a, b, k in left:
        while a < b:
            k = (k + 1) % len(owners)
            take = min(b - a, int(room[owners[k]]))
            if take:
                pieces.append((a, a + take, int(owners[k])))
                room[owners[k]] -= take
                a += take
    filled, out = np.zeros(shards, np.int64), []
    for a, b, shard in sorted(pieces):
        out.append((a, b, shard, int(filled[shard])))
        filled[shard] += b - a
    return out


def _assigned(rows: DataFrame, shards: int, each: int) -> DataFrame:
    """(row, shard, slot) of rows (row, hash).

    Rows are in the order of their hashes around the ring. Of rows with one hash, which are equal in
    what decides, those of each partition are ranked for themselves; the partitions' counts are added up.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("place", F.shiftrightunsigned("hash", 48).cast("int")).withColumn("part", F.spark_partition_id())
    placed = staged(placed, "ring")
    counted = placed.groupBy("place", "hash", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(PLACES, np.int64)
    for place, n in counted.groupBy("place").agg(F.sum("n")).toLocalIterator():
        counts[place] = n
    pieces = bounded_pieces(counts, shards, each)
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = np.array([p[0] for p in pieces] or [0])
    parts = []
    for place in np.flatnonzero(counts):
        a, b = int(before[place]), int(before[place + 1])
        for first, end, shard, slot in pieces[int(np.searchsorted(starts, a, "right")) - 1 :]:
            if first >= b:
                break
            parts.append((int(place), max(first, a) - a, min(end, b) - a, shard, slot + max(first, a) - first))
    plan = spark.createDataFrame(parts, "at int, low long, high long, shard int, first long")
    earlier = Window.partitionBy("place").orderBy("hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counted.select("hash", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("hash", "part").orderBy("place")) - 1
    ranked = placed.withColumn("rank", rank).join(begin, ["hash", "part"]).withColumn("rank", F.col("begin") + F.col("rank"))
    # The plan has a row for each of the 2**16 places and each piece at most, whatever the input.
    joined = ranked.join(F.broadcast(plan), (F.col("place") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select("row", "shard", (F.col("first") + F.col("rank") - F.col("low")).cast("long").alias("slot"))


def assign(rows: DataFrame, key: str, shards: int = 40, each: int = 64) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; shard sizes in rows are at most one apart.

    A row's place on the ring depends on its ``key`` and on ``text_crc32`` where there is such a
    column, so that rows that share a key spread out. Slots are gapless from 0 in each shard. Null
    keys have a place like any other. Columns may have any names; shard and slot are replaced. An
    empty table gives an empty result.
    """
    salt = ["row.text_crc32"] if "text_crc32" in rows.columns else []
    hashed = boxed(rows.drop("shard", "slot")).withColumn("hash", F.xxhash64(F.col("row").getField(key), *salt))
    return _assigned(hashed, shards, each).select("row.*", "shard", "slot")


def _crc(text) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def shard_documents(docs: DataFrame, shards: int = 40, each: int = 64) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, shard and slot of every document.

    A null text counts as empty. Further columns are ignored; repeated rows get slots of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), _crc(F.col("text")).alias("text_crc32"))
    return assign(rows, "doc_id", shards, each)


def write_shards(docs: DataFrame, path: str, shards: int = 40, each: int = 64) -> None:
    """Writes the documents as one folder of Parquet files for each shard, in slot order.

    All columns are written, but shard and slot are replaced. A shard's files are cut by slot ranges,
    so that no task writes a whole shard.
    """
    hashed = boxed(docs.drop("shard", "slot")).withColumn("hash", F.xxhash64(F.col("row.doc_id").cast("long"), _crc(F.col("row.text"))))
    placed = _assigned(hashed, shards, each).select("row.*", "shard", "slot")
    placed.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Indexes that requests are looked up in: snapshots by path and time, files by path, folders by name.

Snapshots of a path are in chunks, rows of bounded size in order of time, so that a request meets one row
whatever the number of captures. Paths that span several chunks have a head, the times that these begin
with, and each of their chunks knows its neighbours' nearest times. A ``Lookup`` is made for one batch out
of what that batch asks for; a ``ServingIndex`` is kept in a folder, by buckets of paths, takes new captures as
further segments, and gives a batch a ``Lookup`` over those buckets alone that the batch asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import ts_number
from ..sources.captures import visible
from ..sources.staging import staged
from ..sources.versions import Versions
from .index import scan
from .ranking import ranked

#: Times of a path in one chunk, and buckets of an index unless it is made with another number.
CHUNK, BUCKETS = 256, 64

_SNAPSHOT_DIR = r"^\d{4,14}([a-z]{2}_)?$"


def folded(captures: DataFrame, inside: Column) -> DataFrame:
    """Folded path keys of files: the path itself, and the folder that an index.html stands for."""
    path = F.lower(inside)
    keys = F.when(path.endswith("/index.html"), F.array(F.struct(F.lit(0).alias("variant"), path.alias("fold")), F.struct(F.lit(1).alias("variant"), F.regexp_replace(path, "/index\\.html$", "").alias("fold")))).otherwise(F.array(F.struct(F.lit(0).alias("variant"), path.alias("fold"))))
    return captures.withColumn("_k", F.explode(keys)).withColumn("variant", F.col("_k.variant")).withColumn("fold", F.col("_k.fold")).drop("_k")


def snapshots(captures: DataFrame, number=ts_number) -> DataFrame:
    """(fold, ts_dir, ts_num, archive_path) of archived captures: one for each path and folder."""
    stored = scan(captures).filter(F.col("is_wayback") & F.col("archive_path").startswith("https/web.archive.org/web/") & F.col("ts_dir").rlike(_SNAPSHOT_DIR))
    inside = F.regexp_replace("archive_path", r"^https/web\.archive\.org/web/[^/]*/", "")
    keyed = folded(stored.select("archive_path", "ts_dir", number(F.col("ts_dir")).alias("ts_num"), inside.alias("inside")), F.col("inside"))
    return keyed.groupBy("fold", "ts_dir", "ts_num").agg(F.min(F.struct("variant", "archive_path")).alias("v")).select("fold", "ts_dir", "ts_num", F.col("v.archive_path").alias("archive_path"))


def files(captures: DataFrame) -> DataFrame:
    """(fold, variant, archive_path) of all files."""
    return folded(captures.select("archive_path"), F.col("archive_path")).select("fold", "variant", "archive_path")


def entries(captures: DataFrame) -> DataFrame:
    """(dir, name, is_dir, bytes) of every folder's entries; ``dir`` is empty for the root."""
    parts = F.split("archive_path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))
    each = visible(captures).select("size", F.explode(levels).alias("e")).select("e.*", F.when(~F.col("e.is_dir"), F.col("size")).alias("bytes"))
    return each.groupBy("dir", "name", "is_dir").agg(F.max("bytes").alias("bytes"))


def chunked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (fold, chunk, times, before, after) and heads (fold, lows) of ``snapshots``.

    ``times`` are (ts_num, hits) in order, where hits are all (ts_dir, archive_path) of that time; ``before`` and
    ``after`` the nearest times of the chunks beside. Only folds of several chunks have a head. Those are placed by
    ranges of path and time, so that one path may have any share of the captures.
    """
    hits = F.sort_array(F.collect_list(F.struct("ts_dir", "archive_path"))).alias("hits")
    times = staged(found.groupBy("fold", "ts_num").agg(hits), "times")
    long = staged(times.groupBy("fold").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select("fold"), "long")
    gathered = F.sort_array(F.collect_list(F.struct("ts_num", "hits"))).alias("times")
    kind = "struct<ts_num:bigint,hits:array<struct<ts_dir:string,archive_path:string>>>"
    none = F.lit(None).cast(kind)
    several_chunks = not long.isEmpty()
    short = times.join(long, "fold", "left_anti") if several_chunks else times
    chunks = short.groupBy("fold").agg(gathered).select("fold", F.lit(0).cast("long").alias("chunk"), "times", none.alias("before"), none.alias("after"))
    if several_chunks:
        placed = ranked(times.join(long, "fold", "left_semi"), ["fold"], [F.col("ts_num")]).withColumn("chunk", F.expr(f"(pos - 1) div {CHUNK}"))
        several = staged(placed.groupBy("fold", "chunk").agg(gathered), "several")
        beside = Window.partitionBy("fold").orderBy("chunk")
        ends = several.select("fold", "chunk", F.element_at("times", 1).alias("first"), F.element_at("times", -1).alias("last"))
        ends = ends.select("fold", "chunk", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after"))
        chunks = chunks.unionByName(several.join(ends, ["fold", "chunk"]).select("fold", "chunk", "times", "before", "after"))
        heads = several.groupBy("fold").agg(F.sort_array(F.collect_list(F.element_at("times", 1)["ts_num"])).alias("lows"))
    else:
        heads = long.select("fold", F.array().cast("array<bigint>").alias("lows"))
    return chunks, heads


@dataclass(frozen=True)
class Lookup:
    """What one batch is looked up in: a pair of chunks and heads for each segment, files and folder entries."""

    chunks: list[tuple[DataFrame, DataFrame]]
    files: DataFrame
    entries: DataFrame

    def nearest(self, asked: DataFrame) -> DataFrame:
        """(request_id, ts_dir, archive_path, elsewhere) of those of ``asked`` (request_id, req_dir, ts_num, fold) that have captures.

        A capture in the folder req_dir is first, then the nearest, of equal ones the first folder by name.
        """
        found = []
        for chunks, heads in self.chunks:
            at = F.greatest(F.size(F.filter("lows", lambda low: low <= F.col("ts_num"))) - 1, F.lit(0))
            placed = asked.join(heads, "fold", "left").withColumn("chunk", F.when(F.col("lows").isNull(), 0).otherwise(at).cast("long")).drop("lows")
            near = F.concat(*[F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<struct<ts_num:bigint,hits:array<struct<ts_dir:string,archive_path:string>>>>")) for c in ("before", "after")], F.col("times"))
            each = F.flatten(F.transform(near, lambda t: F.transform(t["hits"], lambda h: F.struct((h["ts_dir"] != F.col("req_dir")).alias("elsewhere"), F.abs(t["ts_num"] - F.col("ts_num")).alias("distance"), h["ts_dir"].alias("ts_dir"), h["archive_path"].alias("archive_path")))))
            found.append(placed.join(chunks, ["fold", "chunk"]).select("request_id", F.array_min(each).alias("b")))
        best = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy("request_id").agg(F.min("b").alias("b"))
        return best.select("request_id", "b.ts_dir", "b.archive_path", "b.elsewhere")


def lookup_of(captures: DataFrame, folds: DataFrame) -> Lookup:
    """A lookup in ``captures`` for one batch that asks for ``folds`` (fold): of snapshots, only those are put together."""
    found = snapshots(captures).join(folds.distinct(), "fold", "left_semi")
    return Lookup([chunked(found)], files(captures), entries(captures))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


class ServingIndex:
    """A lookup that is kept in a folder, for archives that many batches ask.

    Each ``add`` writes a segment: chunks and files by buckets of their path and folder entries by buckets of the
    folder's name, and within a bucket in order of path. A batch's folds and folders name the buckets it needs;
    no other is read. ``merge`` makes one segment of all. New versions appear at once, and readers go on with the one
    they have begun with; ``vacuum`` takes older ones away.
    """

    _TABLES = {"chunks": "fold", "files": "fold", "entries": "dir"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(root)

    def _write(self, found: DataFrame, paths: DataFrame, listed: DataFrame, buckets: int) -> str:
        segment = self.versions.new_segment()
        chunks, heads = chunked(found)
        heads.write.parquet(f"{self.versions.path(segment)}/heads")
        for name, table in (("chunks", chunks), ("files", paths), ("entries", listed)):
            key = self._TABLES[name]
            # A bucket may be large: it is dealt out by ranges of path too, so that no task has a bucket of any size.
            dealt = table.withColumn("bucket", _bucket(key, buckets)).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
            dealt.write.partitionBy("bucket").parquet(f"{self.versions.path(segment)}/{name}")
        return segment

    def _buckets(self) -> int:
        return self.versions.current()[1].get("buckets", BUCKETS)

    def add(self, captures: DataFrame, buckets: int | None = None) -> None:
        """Takes in further captures (archive_path, size); the first ones fix the number of buckets."""
        before, now = self.versions.current()
        buckets = now.get("buckets") or buckets or BUCKETS
        captures = captures.select("archive_path", "size")
        segment = self._write(snapshots(captures), files(captures), entries(captures), buckets)
        self.versions.commit(before, [*now["segments"], segment], buckets=buckets)

    def _table(self, segments: list[str], name: str, wanted: list[int] | None = None) -> DataFrame:
        tables = []
        for k, segment in enumerate(segments):
            rows = self.spark.read.parquet(f"{self.versions.path(segment)}/{name}").withColumn("segment", F.lit(k))
            tables.append(rows if wanted is None else rows.filter(F.col("bucket").isin(wanted)))
        return reduce(lambda a, b: a.unionByName(b), tables)

    def merge(self) -> None:
        """One segment in place of all. Of a file's sizes the one taken in last stays."""
        before, now = self.versions.current()
        if len(now["segments"]) > 1:
            chunks = self._table(now["segments"], "chunks").select("fold", F.explode("times").alias("t")).select("fold", "t.ts_num", F.explode("t.hits").alias("h"))
            found = chunks.groupBy("fold", F.col("h.ts_dir").alias("ts_dir"), "ts_num").agg(F.min("h.archive_path").alias("archive_path"))
            paths = self._table(now["segments"], "files").select("fold", "variant", "archive_path").distinct()
            segment = self._write(found, paths, _latest(self._table(now["segments"], "entries")), self._buckets())
            self.versions.commit(before, [segment], buckets=self._buckets())

    def vacuum(self) -> None:
        self.versions.vacuum()

    def lookup(self, folds: DataFrame, dirs: DataFrame) -> Lookup:
        """A lookup for a batch that asks for ``folds`` (fold) and ``dirs`` (dir): only their buckets are read."""
        segments, buckets = self.versions.segments(), self._buckets()
        if not segments:
            raise ValueError(f"no captures have been taken in at {self.versions.root}")
        # At most as many numbers as there are buckets.
        both = folds.select(F.lit(0).alias("of"), _bucket("fold", buckets).alias("b")).union(dirs.select(F.lit(1), _bucket("dir", buckets))).distinct().collect()
        of = lambda k: sorted(r.b for r in both if r.of == k)
        chunks = [(self._table([s], "chunks", of(0)).drop("segment", "bucket"), self.spark.read.parquet(f"{self.versions.path(s)}/heads")) for s in segments]
        return Lookup(chunks, self._table(segments, "files", of(0)).drop("segment", "bucket"), _latest(self._table(segments, "entries", of(1))))


def _latest(listed: DataFrame) -> DataFrame:
    return listed.groupBy("dir", "name", "is_dir").agg(F.max_by("bytes", "segment").alias("bytes"))

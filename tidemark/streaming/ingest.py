"""Resumable ingestion: a stream of URL list lines, fetched once each and recorded when stored.

The record is a versioned table: each batch adds a segment, and a manifest names those that count. Between the
fetch and the record everything a batch has is in a folder of its own, from which a later run goes on: whatever
step a run dies at, nothing that was fetched is fetched again, and nothing that was stored goes unrecorded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import fetch, http_get, load_urls, name_mapping, pending
from ..sources.versions import Versions
from ..sources.writer import file_system, place_of, recover, write_tree

_CAPTURES = "archive_path string, size long"
_DONE = "url string, dest string"

#: Segments of the record from which ``compact`` is worth while.
SEGMENTS = 16


def _marked(plan: DataFrame, root: str) -> DataFrame:
    """``plan`` with ``stored``: whether its file ``dest`` under ``root``, or its index.html, has content; only these two are looked at."""

    def run(frames):
        where, top = file_system(root)
        for frame in frames:
            places = [place_of(top, x) or top for x in frame["dest"]]
            full = [bool(x.size) for x in where.get_file_info([x for p in places for x in (p, f"{p}/index.html")])]
            yield frame.assign(stored=[full[2 * i] or full[2 * i + 1] for i in range(len(places))])

    return plan.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in plan.schema)}, stored boolean")


def recorded(spark: SparkSession, state: str) -> DataFrame:
    """(url, dest) of what has been stored so far; none before the first success."""
    table = Versions(f"{state}/record")
    found = [table.path(s) for s in table.segments()]
    return spark.read.schema(_DONE).parquet(*found) if found else spark.createDataFrame([], _DONE)


def compact(spark: SparkSession, state: str) -> None:
    """Puts the record's segments together; between runs, not during one. Those that aren't needed any more go."""
    table = Versions(f"{state}/record")
    before, now = table.current()
    if len(now["segments"]) > 1:
        rows = recorded(spark, state).dropDuplicates(["url"])
        segment = table.new_segment()
        rows.repartition(max(1, rows.count() // 1_000_000)).write.parquet(table.path(segment))
        table.commit(before, [segment])
    table.vacuum()


def _settled(spark: SparkSession, state: str, root: str, name: str) -> None:
    """Stores and records what the batch ``name`` has fetched; each step may be done again."""
    home = f"{state}/fetched/{name}"
    plan, got = (spark.read.parquet(f"{home}/{x}") for x in ("plan", "got"))
    write_tree(got.filter("error IS NULL").select(F.col("dest").alias("path"), "content"), root)
    # All but the failures count as done: what was stored before, and further URLs of a path that is stored now.
    done = plan.select("url", "dest").join(got.select("url", F.col("dest").alias("new_dest"), "error"), "url", "left").filter("error IS NULL")
    table = Versions(f"{state}/record")
    before, now = table.current()
    if name not in now["segments"]:
        done.select("url", F.coalesce("new_dest", "dest").alias("dest")).coalesce(1).write.mode("overwrite").parquet(table.path(name))
        table.commit(before, [*now["segments"], name])
    _dropped(home)


def _dropped(folder: str) -> None:
    from pyarrow import fs

    where, top = file_system(folder)
    if where.get_file_info(top).type != fs.FileType.NotFound:
        where.delete_dir(top)


def resume(spark: SparkSession, state: str, root: str) -> None:
    """Completes what an earlier run has fetched whole but not recorded; what it was still fetching is dropped."""
    from pyarrow import fs

    recover(spark, root)
    where, top = file_system(f"{state}/fetched")
    for info in where.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if where.get_file_info(f"{info.path}/got/_SUCCESS").type == fs.FileType.File:
            _settled(spark, state, root, info.base_name)
        else:
            where.delete_dir(info.path)


def ingest(spark: SparkSession, lists: str, state: str, root: str, get: Callable[[str], tuple[int, dict, bytes]] = http_get) -> StreamingQuery:
    """Fetches all lines of text files under ``lists`` that are new since the last run, then ends.

    The checkpoint under ``state`` remembers the files read; the record beside it the URLs that are stored. Failures
    aren't recorded, and are tried again when their line comes again. Of URLs with one storage path the first of a
    batch is stored, or the next where it fails, all in one round.
    """

    def batch(lines: DataFrame, batch_id: int) -> None:
        session = lines.sparkSession
        resume(session, state, root)
        urls = load_urls(lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))
        name = uuid.uuid4().hex
        home = f"{state}/fetched/{name}"
        _marked(pending(urls, recorded(session, state), session.createDataFrame([], _CAPTURES)), root).write.parquet(f"{home}/plan")
        plan = session.read.parquet(f"{home}/plan")
        if plan.isEmpty():
            _dropped(home)
            return
        # Fetched once: the results are kept until both the files and the record are written.
        fetch(plan.filter("NOT stored"), get).write.parquet(f"{home}/got")
        _settled(session, state, root, name)

    stream = spark.readStream.text(lists)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def write_state(spark: SparkSession, state: str, folder: str) -> None:
    """The record as JSON files for other tools: under download_state.json arrays of URLs, under filename_mapping.json
    objects from cut names to whole ones; a part each for some of the rows, which ``json_state`` reads as one."""
    urls = recorded(spark, state)

    def arrays(frames):
        for frame in frames:
            yield pd.DataFrame({"value": [json.dumps(frame["url"].tolist(), ensure_ascii=False)]})

    def objects(frames):
        for frame in frames:
            yield pd.DataFrame({"value": [json.dumps(dict(zip(frame["short"], frame["original"], strict=True)), ensure_ascii=False)]})

    urls.select("url").mapInPandas(arrays, "value string").write.mode("overwrite").text(f"{folder}/download_state.json")
    name_mapping(urls.select(F.lit(0).alias("line_no"), "url")).mapInPandas(objects, "value string").write.mode("overwrite").text(f"{folder}/filename_mapping.json")

"""Whole jobs over an archive: ingesting it, flattening it into a standalone tree, its catalogue, and serving it.

``spark-submit tidemark/jobs.py flatten --output-dir=PATH [--archive-dir=PATH | --config=FILE] [--date=YYYY[-MM[-DD]]]``
``spark-submit tidemark/jobs.py ingest --url-lists=PATH --state=PATH --output-dir=PATH``
``spark-submit tidemark/jobs.py catalogue --output-dir=PATH [--archive-dir=PATH | --config=FILE]``
``spark-submit tidemark/jobs.py serve --requests=PATH --index=PATH --state=PATH --output-dir=PATH [--archive-dir=PATH | --config=FILE]``
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import date_number
from tidemark.operators.catalogue import describe, flat_pages, ordered, pages, report
from tidemark.operators.lookup import ServingIndex
from tidemark.operators.rewrite import flatten
from tidemark.operators.serve import serve_files
from tidemark.sources.captures import walk, with_content
from tidemark.sources.config import save_location
from tidemark.sources.staging import clear_staged, staging_scope
from tidemark.sources.writer import write_tree
from tidemark.streaming.ingest import compact, ingest, write_state


def _now() -> str:
    return datetime.datetime.now().isoformat(" ", "seconds")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The files under a folder by name, size and time; folders that can't be read are passed over."""
    return walk(spark, root).filter("kind = 'file'").select("archive_path", "size", "mtime")


def flatten_tree(spark: SparkSession, archive: str, output: str, target: int, generated: str | None = None) -> dict[str, int]:
    """Flattens the files under ``archive`` into ``output`` and writes their report, index.html, beside them; may be run again.

    Returns how many files were rewritten and how many copied byte by byte, how many of those because they could not be
    rewritten (failed), and how many could not be read (errors); counted by the pass that writes them. Folders that can't
    be read are passed over, and counted as unread.
    """
    count = Observation()
    is_ = lambda action: F.count_if(F.col("action") == action)
    with staging_scope(spark):
        walked = walk(spark, archive)
        files = walked.filter("kind = 'file'").select("archive_path", "size")
        done = flatten(files, target, lambda some: with_content(some, archive)).observe(count, is_("rewritten").alias("rewritten"), is_("copied").alias("copied"), F.count_if("failed").alias("failed"), is_("error").alias("errors"))
        write_tree(done.select(F.col("output_path").alias("path"), "content"), output)
        write_tree(report(ordered(describe(flat_pages(_listed(spark, output)), flat=True)), generated or _now(), flat=True), output)
        return count.get | {"unread": walked.filter("kind = 'unread'").count()}


def write_catalogue(spark: SparkSession, archive: str, output: str, generated: str | None = None) -> None:
    """The report of an archive's pages, as index.html in ``output``."""
    with staging_scope(spark):
        write_tree(report(ordered(describe(pages(_listed(spark, archive)))), generated or _now()), output)


def serve_stream(spark: SparkSession, archive: str, requests: str, index: str, state: str, output: str):
    """Answers the requests (JSON lines with request_id and path) in files under ``requests`` that are new since the last run, then ends.

    Each batch has a folder of its own in ``output``: responses (request_id, status, content_type, content_length,
    archive_path) and bodies (request_id, offset, piece). The index is made by the first run; to take in further captures
    is ``ServingIndex.add``.
    """
    kept = ServingIndex(spark, index)
    if not kept.versions.segments():
        kept.add(_listed(spark, archive))

    def batch(asked: DataFrame, batch_id: int) -> None:
        session = asked.sparkSession
        with staging_scope(session):
            heads, bodies = serve_files(asked, ServingIndex(session, index), archive)
            heads.write.mode("overwrite").parquet(f"{output}/responses/batch={batch_id}")
            bodies.write.mode("overwrite").parquet(f"{output}/bodies/batch={batch_id}")

    stream = spark.readStream.schema("request_id long, path string").json(requests)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/requests").trigger(availableNow=True).start()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("job", choices=("flatten", "ingest", "catalogue", "serve"))
    parser.add_argument("--archive-dir")
    parser.add_argument("--config", help="JSON file with currentSaveLocation, for want of --archive-dir")
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--date", default="", help="the date that links are resolved for; today if none is given")
    parser.add_argument("--url-lists", help="folder of URL lists to ingest")
    parser.add_argument("--requests", help="folder of requests to answer, as JSON lines")
    parser.add_argument("--index", help="folder of the serving index; made if there is none")
    parser.add_argument("--state", help="folder for the record of what has been ingested or answered")
    given = parser.parse_args(arguments)
    needed = {"ingest": ("url_lists", "state"), "serve": ("requests", "index", "state")}.get(given.job, ())
    if missing := [n for n in needed if not getattr(given, n)]:
        parser.error(f"{given.job} needs {', '.join('--' + n.replace('_', '-') for n in missing)}")
    if given.job != "ingest" and not (given.archive_dir or given.config):
        parser.error("--archive-dir or --config is required")
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if given.job == "ingest":
        ingest(spark, given.url_lists, given.state, given.output_dir).awaitTermination()
        compact(spark, given.state)
        write_state(spark, given.state, given.state)
        return
    archive = given.archive_dir or save_location(spark, given.config)
    if given.job == "flatten":
        today = datetime.date.today().isoformat()
        target = spark.range(1).select(date_number(F.lit(given.date), today)).first()[0]
        print(flatten_tree(spark, archive, given.output_dir, target))
    elif given.job == "serve":
        serve_stream(spark, archive, given.requests, given.index, given.state, given.output_dir).awaitTermination()
    else:
        write_catalogue(spark, archive, given.output_dir)
    clear_staged(spark)


if __name__ == "__main__":
    main()

"""Captures: the files of an archive tree as rows of archive_path, size, mtime and content."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged
from .writer import file_system, place_of

#: Levels of folders that are listed one by one before tasks go down on their own, and tasks that do.
LEVELS, FOLDERS = 4, 64
#: Bytes of files that a task reads, about.
READ_AT_ONCE = 1 << 26

IGNORED = ("node_modules", "download_state.json", "filename_mapping.json", "__MACOSX", ".DS_Store", "http_", "https_")


def from_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``. Contents are read only where a later step asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = files.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("at"), "length", "modificationTime", "content")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return base.filter(F.col("at").startswith(top)).select(F.col("at").substr(F.lit(len(top) + 1), F.length("at")).alias("archive_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def list_folder(where, folder: str) -> list[tuple[str, bool, int, int]]:
    """(name, whether a folder, size, microseconds since 1970) of a folder's entries."""
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(folder))
    return [(f.base_name, f.type == fs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1000) for f in found if f.type != fs.FileType.NotFound]


_WALKED = "kind string, archive_path string, size long, mtime long, error string"


def walk(spark: SparkSession, root: str, ignored: tuple[str, ...] = ("node_modules",), listed=list_folder) -> DataFrame:
    """(kind, archive_path, size, mtime, error) of the files under ``root``, and of folders that can't be read, whose kind is unread.

    Tasks list folders, level by level until there are enough of them, and then each the whole of what lies below its
    own. Hidden folders and ``ignored`` ones aren't entered. What can't be read is reported, and the rest goes on.
    """

    def run(frames, whole: bool):
        where, top = file_system(root)
        for frame in frames:
            for start in frame["archive_path"]:
                left, rows = [start], []
                while left:
                    folder = left.pop()
                    try:
                        entries = listed(where, f"{top.rstrip('/')}/{folder}".rstrip("/"))
                    except OSError as e:
                        rows.append(("unread", folder, None, None, str(e)))
                        continue
                    for name, is_folder, size, mtime in entries:
                        path = f"{folder}/{name}".lstrip("/")
                        if not is_folder:
                            rows.append(("file", path, size, mtime, None))
                        elif not (name.startswith(".") or name in ignored):
                            if whole:
                                left.append(path)
                            else:
                                rows.append(("folder", path, None, None, None))
                    if len(rows) >= 10_000:
                        yield _walked(rows)
                        rows = []
                yield _walked(rows)

    found, front = [], spark.createDataFrame([("",)], "archive_path string")
    for level in range(LEVELS + 1):
        last = level == LEVELS
        step = staged(front.repartition(FOLDERS).mapInPandas(lambda frames, last=last: run(frames, last), _WALKED), "walk")
        found.append(step.filter("kind <> 'folder'"))
        front = step.filter("kind = 'folder'").select("archive_path")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).withColumn("mtime", F.timestamp_micros("mtime"))


def _walked(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["kind", "archive_path", "size", "mtime", "error"])
    return frame.astype({"size": "Int64", "mtime": "Int64"})


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` (archive_path, size and others) with their content under ``root``; null for a file that can't be read.

    Files are dealt to tasks of some 64 MB each. Nothing is read before the content is asked for, but then for each
    use, and for all rows: filter first.
    """
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(FOLDERS, total // READ_AT_ONCE)

    def run(frames):
        where, top = file_system(root)
        for frame in frames:
            begin, held, contents = 0, 0, []
            for k, path in enumerate(frame["archive_path"]):
                try:
                    with where.open_input_stream(place_of(top, path)) as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held > READ_AT_ONCE // 8:
                    yield frame.iloc[begin : k + 1].assign(content=pd.Series(contents, dtype=object).values)
                    begin, held, contents = k + 1, 0, []
            if contents:
                yield frame.iloc[begin:].assign(content=pd.Series(contents, dtype=object).values)

    columns = files.drop("content").columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*columns).schema)
    return files.select(*columns).repartition(tasks).mapInPandas(run, f"{schema}, content binary")


def from_pages(pages: DataFrame) -> DataFrame:
    """Derived captures of a table of pages (page_id, url, html): a fixture, not observed captures.

    One page in five is a direct capture; of the others there are one to four snapshots at times and
    with flags that follow from page_id.
    """
    rest = F.regexp_replace("url", r"[?#].*$", "")
    several = F.when(F.col("page_id") % 5 == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")))
    each = pages.select("page_id", rest.alias("rest"), F.explode(several).alias("k"), F.col("html").cast("binary").alias("content"))
    days = (F.pmod(F.col("page_id") * 37, F.lit(8000)) + F.col("k") * 101).cast("int")
    moment = F.timestamp_seconds(F.unix_timestamp(F.date_add(F.lit("2001-01-01").cast("date"), days).cast("timestamp")) + F.pmod(F.col("page_id") * 7919, F.lit(86400)))
    ts = F.concat(F.date_format(moment, "yyyyMMddHHmmss"), F.element_at(F.array(*map(F.lit, ("", "id_", "cs_", "im_"))), F.col("k") + 1))
    path = F.when(F.col("k") < 0, F.replace("rest", F.lit("://"), F.lit("/"))).otherwise(F.concat(F.lit("https/web.archive.org/web/"), ts, F.lit("/"), F.regexp_replace("rest", "^[a-z]+://", "")))
    mtime = F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") * 60)
    return each.select(path.alias("archive_path"), F.octet_length("content").cast("long").alias("size"), mtime.alias("mtime"), "content")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a URL list with their numbers, in file order."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def visible(captures: DataFrame, ignored=()) -> DataFrame:
    """Files none of whose path segments starts with a dot or is one of the ignored names."""
    bad = F.exists(F.split("archive_path", "/"), lambda s: s.startswith(".") | s.isin(*ignored, "node_modules"))
    return captures.filter(~bad)


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON state file; none where it is missing or can't be parsed."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    return parse_state(text, schema)


def parse_state(texts: DataFrame, schema: str) -> DataFrame:
    """(state) of JSON texts (value), without those that can't be parsed."""
    return texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("state")).filter("state IS NOT NULL")

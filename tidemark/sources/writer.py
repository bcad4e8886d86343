"""A sink for files: rows of (path, content) as files under a folder that all executors share.

A write is a transaction. Tasks write below a hidden folder of the target; the commit names the tasks whose
files count in one file that appears at once; then the files are moved to their places by a job of their
own, which may be run again at any time. What is written but not committed is never seen outside the hidden
folder, and goes with the abort; what is committed is completed by ``recover`` if the job that moves it dies.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The hidden folder of the target that transactions are in; and in each of those the list of its tasks.
HIDDEN, TASKS = ".tidemark", "tasks.json"


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: int


def place_of(root: str, path: str) -> str | None:
    """Where ``path`` lies under ``root``; no path leaves it."""
    parts = [p for p in path.split("/") if p not in ("", ".", "..")]
    return "/".join([root.rstrip("/"), *parts]) if parts else None


def file_system(root: str):
    """The file system of a folder and the folder's path in it: a URI (hdfs:, s3:, file:), or a plain path that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _is_there(where, path: str) -> bool:
    from pyarrow import fs

    return where.get_file_info(path).type != fs.FileType.NotFound


def replace_file(where, source: str, target: str) -> None:
    """Moves a file over another, also where the file system's move doesn't replace."""
    try:
        where.move(source, target)
    except OSError:
        if not _is_there(where, source) or not _is_there(where, target):
            raise
        where.delete_file(target)
        where.move(source, target)


class _FileWriter(DataSourceWriter):
    """Each task has a folder of its own in the transaction's; an attempt that fails takes its own away."""

    def __init__(self, root: str, transaction: str):
        self.root, self.transaction = root, transaction

    def _home(self):
        where, root = file_system(self.root)
        return where, f"{root.rstrip('/')}/{HIDDEN}/{self.transaction}"

    def write(self, rows):
        where, home = self._home()
        task, n, folders = uuid.uuid4().hex, 0, set()
        try:
            for row in rows:
                place = place_of(f"{home}/{task}", row["path"])
                if place is None or not row["content"]:  # an empty file is never written
                    continue
                folder = place.rsplit("/", 1)[0]
                if folder not in folders:
                    where.create_dir(folder, recursive=True)
                    folders.add(folder)
                with where.open_output_stream(place) as f:
                    f.write(bytes(row["content"]))
                n += 1
        except BaseException:
            if folders:
                where.delete_dir(f"{home}/{task}")
            raise
        return Written(task, n)

    def commit(self, messages):
        where, home = self._home()
        where.create_dir(home, recursive=True)
        with where.open_output_stream(f"{home}/{TASKS}.new") as f:
            f.write(json.dumps([m.task for m in messages if m is not None and m.files]).encode())
        where.move(f"{home}/{TASKS}.new", f"{home}/{TASKS}")

    def abort(self, messages):
        where, home = self._home()
        _dropped(where, home)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], self.options["transaction"])


def _dropped(where, home: str) -> None:
    """Takes a transaction's folder away, and the hidden folder if it was the last."""
    from pyarrow import fs

    if _is_there(where, home):
        where.delete_dir(home)
    hidden = home.rsplit("/", 1)[0]
    if not where.get_file_info(fs.FileSelector(hidden, allow_not_found=True)) and _is_there(where, hidden):
        where.delete_dir(hidden)


def _published(spark: SparkSession, root: str, transaction: str) -> int:
    """Moves the files of a committed transaction to their places, a task for each folder; how many were still to move."""
    where, top = file_system(root)
    home = f"{top.rstrip('/')}/{HIDDEN}/{transaction}"
    with where.open_input_stream(f"{home}/{TASKS}") as f:
        tasks = json.loads(f.read())

    def move(frames):
        from pyarrow import fs

        where, top = file_system(root)
        for frame in frames:
            n = 0
            for task in frame["task"]:
                inside = f"{home}/{task}"
                folders = set()
                for info in where.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=True)):
                    if info.type == fs.FileType.File:
                        place = f"{top.rstrip('/')}/{info.path[len(inside) + 1 :]}"
                        folder = place.rsplit("/", 1)[0]
                        if folder not in folders:
                            where.create_dir(folder, recursive=True)
                            folders.add(folder)
                        replace_file(where, info.path, place)
                        n += 1
            yield pd.DataFrame({"n": [n]})

    moved = 0
    if tasks:
        names = spark.createDataFrame([(t,) for t in tasks], "task string").repartition(len(tasks))
        moved = names.mapInPandas(move, "n long").agg(F.sum("n")).first()[0]
    _dropped(where, home)
    return moved


def write_tree(files: DataFrame, root: str) -> int:
    """Writes rows of (path, content) as files under ``root``: all, or none if a task fails. How many were written.

    Of rows with one path the last to be moved stays. The parts of a path that would lead out of ``root`` don't count;
    rows without a path or content write nothing.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileTree)
    transaction = uuid.uuid4().hex
    files.select("path", "content").write.format("filetree").mode("append").option("path", root).option("transaction", transaction).save()
    return _published(spark, root, transaction)


def recover(spark: SparkSession, root: str) -> int:
    """Completes the committed transactions that a lost job has left under ``root``, and drops those that weren't committed.

    To be run while nothing else writes there. Returns the number of files that were still to move.
    """
    from pyarrow import fs

    where, top = file_system(root)
    hidden, moved = f"{top.rstrip('/')}/{HIDDEN}", 0
    for info in where.get_file_info(fs.FileSelector(hidden, allow_not_found=True)):
        if _is_there(where, f"{info.path}/{TASKS}"):
            moved += _published(spark, root, info.base_name)
        else:
            _dropped(where, info.path)
    return moved

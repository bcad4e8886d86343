"""The file sink: whole trees or nothing, whatever fails."""

import os
import signal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import writer as K

SCHEMA = "path string, content binary"


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def numbered(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("d/"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))


def wanted(n):
    return {f"d/{i % 7}/{i}": str(i).encode() for i in range(n)}


def test_a_tree_is_written_whole_and_over_an_older_one(spark, tmp_path):
    root = tmp_path / "t"
    assert K.write_tree(numbered(spark, 50), str(root)) == 50 and tree(root) == wanted(50)
    again = numbered(spark, 60).withColumn("content", F.concat(F.lit("new").cast("binary"), "content"))
    assert K.write_tree(again, f"file://{root}") == 60
    assert tree(root) == {p: b"new" + c for p, c in wanted(60).items()} and not (root / K.HIDDEN).exists()


def broken(how):
    def run(frames):
        for frame in frames:
            yield frame.iloc[: len(frame) // 2]
            if (frame["path"] == "d/2/44").any():
                if how == "killed":
                    os.kill(os.getpid(), signal.SIGKILL)
                raise RuntimeError("task fails midway")

    return run


@pytest.mark.parametrize("how", ["fails", "killed"])
def test_a_failing_or_killed_task_leaves_the_tree_as_it_was(spark, tmp_path, how):
    root = tmp_path / "t"
    K.write_tree(numbered(spark, 10), str(root))
    with pytest.raises(Exception, match="task|Python worker"):
        K.write_tree(numbered(spark, 50).mapInPandas(broken(how), SCHEMA), str(root))
    assert tree(root) == wanted(10) and not (root / K.HIDDEN).exists()


def test_a_row_that_cannot_be_written_takes_its_tasks_files_away(tmp_path):
    sink = K._FileWriter(str(tmp_path / "t"), "x")

    def rows():
        yield {"path": "a/b", "content": b"1"}
        raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        sink.write(rows())
    assert tree(tmp_path) == {}


def test_a_job_lost_before_its_commit_leaves_nothing(spark, tmp_path):
    root = tmp_path / "t"
    sink = K._FileWriter(str(root), "lost")
    sink.write([{"path": "a/b", "content": b"1"}])
    assert K.recover(spark, str(root)) == 0 and tree(root) == {} and not (root / K.HIDDEN).exists()


@pytest.mark.parametrize("moved", [0, 1, 2, 3])
def test_a_job_lost_after_its_commit_is_completed(spark, tmp_path, moved):
    """Killed after any number of moves: nothing is lost, and what a stray attempt wrote doesn't count."""
    root = tmp_path / "t"
    sink = K._FileWriter(str(root), "lost")
    done = [sink.write([{"path": f"a/{i}", "content": b"%d" % i}, {"path": "a//../b", "content": b""}]) for i in range(3)]
    sink.write([{"path": "a/stray", "content": b"x"}])
    sink.commit([*done, None])
    for i in range(moved):
        (root / "a").mkdir(exist_ok=True)
        (root / K.HIDDEN / "lost" / done[i].task / "a" / str(i)).rename(root / "a" / str(i))
    assert K.recover(spark, str(root)) == 3 - moved
    assert tree(root) == {f"a/{i}": b"%d" % i for i in range(3)} and not (root / K.HIDDEN).exists()
    assert K.recover(spark, str(root)) == 0


def test_moving_replaces_where_the_file_system_does_not(tmp_path):
    from pyarrow import fs

    class Strict:
        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def move(self, a, b):
            if os.path.exists(b):
                raise OSError("target exists")
            self.inner.move(a, b)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("new")
    b.write_text("old")
    K.replace_file(Strict(), str(a), str(b))
    assert b.read_text() == "new" and not a.exists()
    with pytest.raises(OSError):
        K.replace_file(Strict(), str(a), str(b))

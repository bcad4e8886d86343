"""Whole jobs, run twice, and the walk over trees that can't all be read."""

import json

import pytest

from tidemark import jobs
from tidemark.sources import captures as S

WB = "https/web.archive.org/web/20030404183527/www.x.com/"


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode("latin-1"))


def test_flattening_writes_a_tree_and_its_report_and_may_be_run_again(spark, tmp_path):
    archive, out = tmp_path / "in", tmp_path / "out"
    put(archive, {WB + "dir/p.htm": '<a href="/img/c.gif">', WB + "img/c.gif": "GIF", WB + "a.php": "<html>\xe9", "http/x.com/s.css": "p{}"})
    for _ in range(2):
        assert jobs.flatten_tree(spark, str(archive), str(out), 20080101000000, "now") == {"rewritten": 3, "copied": 1, "failed": 0, "errors": 0, "unread": 0}
        assert (out / WB / "dir/p.htm").read_text() == '<a href="../img/c.gif">' and (out / WB / "a.php.html").read_bytes() == b"<html>\xe9"
        text = (out / "index.html").read_text()
        assert text.count("<tr class=") == 2 and "Local Web Archive (2 Pages)" in text and "Generated on now &bull; Standalone archive" in text
        assert f'<td><a href="{WB}dir/p.htm" target="_blank">' in text
        assert sorted(p.name for p in out.rglob("*") if p.is_file()) == ["a.php.html", "c.gif", "index.html", "p.htm", "s.css"]
    jobs.write_catalogue(spark, str(archive), str(tmp_path / "list"), "then")
    assert (tmp_path / "list/index.html").read_text().count("<tr class=") == 2


def test_requests_are_answered_as_a_stream(spark, tmp_path):
    archive, asked = tmp_path / "in", tmp_path / "asked"
    put(archive, {WB + "p.htm": "<p>", WB + "b.bin": "bytes", "http/x.com/d/f.txt": "t"})
    asked.mkdir()
    arguments = ["serve", f"--archive-dir={archive}", f"--requests={asked}", f"--index={tmp_path}/index", f"--state={tmp_path}/state", f"--output-dir={tmp_path}/out"]
    write = lambda name, rows: (asked / name).write_text("\n".join(json.dumps({"request_id": i, "path": p}) for i, p in rows))
    heads = lambda: {r.request_id: (r.status, r.content_length) for r in spark.read.parquet(f"{tmp_path}/out/responses").collect()}
    write("a.json", [(1, "/web/2004/www.x.com/p.htm"), (2, "/web/2004/www.x.com/b.bin")])
    jobs.main(arguments)
    assert heads() == {1: (200, 3), 2: (200, 5)}
    write("b.json", [(3, "/http/x.com/d/f.txt"), (4, "/none")])
    jobs.main(arguments)
    assert heads() == {1: (200, 3), 2: (200, 5), 3: (200, 1), 4: (404, 13)}
    bodies = {r.request_id: bytes(r.piece) for r in spark.read.parquet(f"{tmp_path}/out/bodies").collect()}
    assert bodies == {1: b"<p>", 2: b"bytes", 3: b"t", 4: b"404 Not Found"}


def test_arguments_that_are_missing(capsys):
    for arguments in (["serve", "--output-dir=x", "--archive-dir=y"], ["ingest", "--output-dir=x"], ["flatten", "--output-dir=x"]):
        with pytest.raises(SystemExit):
            jobs.main(arguments)
        assert "--" in capsys.readouterr().err.splitlines()[-1]


def unreadable(names):
    """Lists as usual, but for folders of these names; made here, so that workers get it by value."""

    def listed(where, folder):
        from tidemark.sources.captures import list_folder

        if folder.rsplit("/", 1)[-1] in names:
            raise PermissionError(f"may not read {folder}")
        return list_folder(where, folder)

    return listed


@pytest.mark.parametrize("levels", [0, 1, 4])
def test_a_walk_passes_over_what_cannot_be_read(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(S, "LEVELS", levels)
    monkeypatch.setattr(S, "FOLDERS", 3)
    root = tmp_path / "t"
    put(root, {"a/b/c/d/e/f.txt": "12345", "a/locked/x": "1", "b/y": "", "c/node_modules/z": "1", "c/.git/z": "1", "top": "1", "c/d/locked/z": "1", "c/d/ok": "12"})
    out = S.walk(spark, str(root), listed=unreadable(("locked",))).collect()
    assert {r.archive_path: r.size for r in out if r.kind == "file"} == {"a/b/c/d/e/f.txt": 5, "b/y": 0, "top": 1, "c/d/ok": 2}
    assert {r.archive_path for r in out if r.kind == "unread"} == {"a/locked", "c/d/locked"} and all("may not read" in r.error for r in out if r.kind == "unread")
    assert all(abs(r.mtime.timestamp() - (root / r.archive_path).stat().st_mtime) < 86400 for r in out if r.kind == "file")
    nothing = S.walk(spark, str(tmp_path / "none")).collect()
    assert [r.kind for r in nothing] == ["unread"]


def test_a_walk_gives_what_the_files_are(spark, tmp_path):
    root = tmp_path / "t"
    put(root, {f"d{i % 5}/{i}": "x" * i for i in range(1, 40)})
    walked = {(r.archive_path, r.size) for r in S.walk(spark, str(root)).collect()}
    assert walked == {(r.archive_path, r.size) for r in S.from_files(spark, str(root)).select("archive_path", "size").collect()}


def test_contents_are_read_where_they_can_be(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "READ_AT_ONCE", 800)
    root = tmp_path / "t"
    put(root, {f"d{i % 5}/{i}": "x" * i for i in range(40)})
    files = S.walk(spark, str(root)).filter("kind = 'file'").select("archive_path", "size").cache()
    files.count()
    (root / "d2/7").unlink()
    got = {r.archive_path: (r.size, None if r.content is None else bytes(r.content)) for r in S.with_content(files, str(root)).collect()}
    assert got == {f"d{i % 5}/{i}": (i, None if i == 7 else b"x" * i) for i in range(40)}
    files.unpersist()
    assert S.with_content(files.limit(0), str(root)).collect() == []

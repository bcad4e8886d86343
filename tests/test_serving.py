"""The serving index: chunks of snapshots, segments, buckets, versions, and responses for files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookup as L
from tidemark.operators import resolve as R
from tidemark.operators import serve as V
from tidemark.sources.versions import Versions
from tidemark.sources.writer import write_tree

WB = "https/web.archive.org/web/"


def archive(spark, paths):
    return spark.createDataFrame([(p, 1, b"x") for p in paths], "archive_path string, size long, content binary")


def number(ts):
    return int("".join(c for c in ts if c.isdigit()).ljust(14, "0"))


def by_scan(files, requests):
    """Every request against every capture."""
    out = {}
    for i, ts, url in requests:
        hits = {f.split("/")[3]: f for f in files if f.lower().endswith("/" + url.lower()) and f.startswith(WB) and f.split("/", 4)[4].lower() == url.lower()}
        best = ts if ts in hits else min(hits, key=lambda d: (abs(number(d) - number(ts)), d), default=None)
        out[i] = hits.get(best)
    return out


def case(seed, captures, asked):
    random.seed(seed)
    ts = lambda: "".join(random.choice("0123456789") for _ in range(random.choice([4, 6, 14]))) + random.choice(["", "id_"])
    files = sorted({f"{WB}{ts()}/x.com/{random.choice('aaaaaab')}" for _ in range(captures)})
    requests = [(i, random.choice([ts(), files[i % len(files)].split("/")[3]]), f"X.com/{random.choice('aaabc')}") for i in range(asked)]
    return files, requests


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunks_of_any_size_find_the_nearest(spark, monkeypatch, size):
    monkeypatch.setattr(L, "CHUNK", size)
    files, requests = case(size, 150, 120)
    got = R.nearest_snapshot(spark.createDataFrame(requests, "request_id long, ts string, url string"), archive(spark, files)).collect()
    assert {r.request_id: r.archive_path for r in got} == by_scan(files, requests)
    chunks, heads = L.chunked(L.snapshots(archive(spark, files)))
    assert max(len(r.times) for r in chunks.collect()) <= size and (heads.count() > 0) == (size < 1000)


def ask(spark, index, requests):
    frame = spark.createDataFrame(requests, "request_id long, ts string, url string")
    asked = R.asked_snapshots(frame)
    where = index.lookup(asked.select("fold"), spark.createDataFrame([], "dir string"))
    return {r.request_id: r.archive_path for r in R.snapshots_found(frame, where.nearest(asked)).collect()}, where


def test_segments_give_what_one_index_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 4)
    files, requests = case(7, 120, 80)
    index = L.ServingIndex(spark, str(tmp_path / "index"))
    for k in range(3):
        index.add(archive(spark, files[k::3]), 8)
    want = by_scan(files, requests)
    assert ask(spark, index, requests)[0] == want and len(index.versions.segments()) == 3
    older = ask(spark, index, requests)[1]
    before = older.files.count()
    index.merge()
    index.merge()
    assert ask(spark, index, requests)[0] == want and len(index.versions.segments()) == 1
    assert older.files.count() == before > 0  # readers of the version before go on
    index.vacuum()
    assert ask(spark, index, requests)[0] == want and len(os.listdir(tmp_path / "index/segments")) == 1 == len(os.listdir(tmp_path / "index/manifests"))


def test_a_batch_reads_only_the_buckets_that_it_asks_for(spark, tmp_path):
    index = L.ServingIndex(spark, str(tmp_path / "index"))
    index.add(archive(spark, [f"{WB}2001/x.com/{i}" for i in range(500)] + [f"http/y.com/{i}" for i in range(500)]), 32)
    got, where = ask(spark, index, [(0, "2002", "x.com/7"), (1, "2002", "x.com/none")])
    assert got == {0: WB + "2001/x.com/7", 1: None}
    for table in (where.chunks[0][0], where.files):
        read = [f for s in table._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in s for f in [s]]
        assert read and all("bucket" in s for s in read)
        rows = table.withColumn("file", F.input_file_name()).select("file").distinct().collect()
        assert len({r.file.rsplit("/bucket=", 1)[1].split("/")[0] for r in rows}) <= 2


def test_an_index_without_captures_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no captures"):
        ask(spark, L.ServingIndex(spark, str(tmp_path / "none")), [(0, "2001", "x")])


def test_versions_appear_at_once_and_one_at_a_time(tmp_path):
    a, b = Versions(str(tmp_path / "v")), Versions(f"file://{tmp_path}/v")
    assert a.current() == (0, {"segments": []})
    a.commit(0, ["s"], more=3)
    assert b.current() == (1, {"segments": ["s"], "more": 3})
    with pytest.raises(RuntimeError, match="no longer"):
        b.commit(0, ["t"])
    b.commit(1, ["s", "t"])
    # A writer that died before its manifest was moved has changed nothing.
    (tmp_path / "v/manifests/3.abc").write_text("{half")
    assert a.segments() == ["s", "t"]
    for s in ("s", "t", "lost"):
        (tmp_path / "v/segments" / s).mkdir(parents=True)
    a.vacuum()
    assert a.segments() == ["s", "t"] and sorted(os.listdir(tmp_path / "v/segments")) == ["s", "t"] and os.listdir(tmp_path / "v/manifests") == ["2"]


FILES = {
    "index.html": b"root", WB + "2001/x.com/p.htm": b'<meta charset=x-mac><a href="http://y.com/">', WB + "2001/x.com/big.zip": bytes(range(256)) * 10_000, "http/x.com/s.css": b"a{b:url(http://y/c)}",
    "http/x.com/d/f.txt": b"t", "https/web-static.archive.org/_static/w.js": b"w", "http/x.com/gone.txt": b"gone", "http/x.com/gone.html": b"gone",
}
PATHS = ["/", "/web/2005/x.com/p.htm", "/web/2005/x.com/big.zip", "/http/x.com/s.css", "/http/x.com/d/", "/_static/w.js", "/http/x.com/gone.txt", "/http/x.com/gone.html", "/none", "/web/2001/none", "/%FF"]


def served(spark, root, index, **options):
    requests = spark.createDataFrame(list(enumerate(PATHS)), "request_id long, path string")
    heads, bodies = V.serve_files(requests, index, root, **options)
    pieces = {}
    for r in sorted(bodies.collect(), key=lambda r: (r.request_id, r.offset)):
        assert r.offset == len(pieces.get(r.request_id, b"")) and 0 < len(r.piece) <= V.PIECE
        pieces[r.request_id] = pieces.get(r.request_id, b"") + bytes(r.piece)
    return {r.request_id: (r.status, r.content_type, r.content_length) for r in heads.collect()}, pieces


def test_files_go_out_in_pieces_with_their_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PIECE", 1 << 16)
    root = str(tmp_path / "tree")
    write_tree(spark.createDataFrame(list(FILES.items()), "path string, content binary"), root)
    index = L.ServingIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(p, len(c)) for p, c in FILES.items()], "archive_path string, size long"), 8)
    for gone in ("gone.txt", "gone.html"):
        os.remove(f"{root}/http/x.com/{gone}")
    heads, bodies = served(spark, root, index)
    page = b'<meta charset=x-mac><a href="/web/2001/http://y.com/">'
    assert bodies[4].startswith(b"<html>") and b"f.txt" in bodies[4]
    assert bodies == {0: b"root", 1: page, 2: FILES[WB + "2001/x.com/big.zip"], 3: FILES["http/x.com/s.css"], 4: bodies[4], 5: b"w", 6: b"Server Error", 7: b"Server Error", 8: b"404 Not Found", 9: b"404: Page not found locally.", 10: b"400 Bad Request"}
    assert heads == {
        0: (200, "text/html; charset=iso-8859-1", 4), 1: (200, "text/html; charset=x-mac", len(page)), 2: (200, "application/octet-stream", 2_560_000), 3: (200, "text/css", 20), 4: (200, "text/html; charset=utf-8", len(bodies[4])),
        5: (200, "application/javascript", 1), 6: (500, "text/plain", 12), 7: (500, "text/plain", 12), 8: (404, "text/plain", 13), 9: (404, "text/plain", 28), 10: (400, "text/plain", 15),
    }


def test_a_large_file_is_never_in_one_row(tmp_path):
    """A task holds one piece of a file at a time: it can send more than the file system could lend it memory for."""
    place = tmp_path / "t/big.bin"
    place.parent.mkdir()
    with open(place, "wb") as f:
        f.truncate(1 << 30)
    import pandas as pd

    n = 0
    for frame in V._pieces(str(tmp_path / "t"))(iter([pd.DataFrame({"request_id": [1], "archive_path": ["big.bin"]})])):
        assert len(frame) == 1 and frame["offset"][0] == n and len(frame["piece"][0]) <= V.PIECE
        n += len(frame["piece"][0])
    assert n == 1 << 30


def test_malformed_requests(spark):
    cases = {"/a%zz": True, "/a%": True, "/%FF": True, "/%C3": True, "/%ED%A0%80": True, "/%C3%A9": False, "/%EF%BF%BD": False, "/�%41": False, "/�%FF": True, "/a?%zz": False, "/a+b%20c": False}
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", V.malformed(F.col("p")).alias("bad")).collect()
    assert {r.p: r.bad for r in rows} == cases
    out = V.parse_requests(spark.createDataFrame([(0, "/a+b%20%C3%A9"), (1, "/%FF+")], "request_id long, path string")).collect()
    assert {r.request_id: r.url for r in out} == {0: "a+b é", 1: "%FF+"}

"""Operators on literal captures, requests and pages, and against row-at-a-time versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue as C
from tidemark.operators import index as I
from tidemark.operators import ingest as N
from tidemark.operators import resolve as R
from tidemark.operators import rewrite as W
from tidemark.operators import serve as V
from tidemark.sources import captures as S
from tidemark.sources.writer import write_tree
from tidemark.streaming.ingest import ingest

WB = "https/web.archive.org/web/"


def archive(spark, files):
    """files: path -> content (str), or a list of paths."""
    items = files.items() if isinstance(files, dict) else [(p, "x") for p in files]
    rows = [(p, len(c), c.encode("latin-1")) for p, c in items]
    frame = spark.createDataFrame(rows, "archive_path string, size long, content binary")
    return frame.withColumn("mtime", F.timestamp_seconds(F.lit(1700000000)))


def test_classification(spark):
    cases = {
        WB + "20030404183527/www.x.com/8080/a.htm": (True, "20030404183527", "www.x.com", "8080", "a.htm"),
        "http/X.com/a.htm": (False, None, "x.com", "", "a.htm"),
        WB + "2003id_/X.com": (True, "2003", "X.com", "", ""),
        WB + "abc/x.com/a": (None, None, None, None, None),
        WB + "2003": (None, None, None, None, None),
        "index.html": (None, None, None, None, None),
        "ftp/x.com/21/d/f": (False, None, "x.com", "21", "d/f"),
    }
    got = {r.archive_path: (r.is_wayback, r.ts, r.host, r.port, r.url_path) for r in I.classify(archive(spark, list(cases))).collect()}
    assert got == cases
    keys = {r.archive_path: r.k for r in I.classify(archive(spark, list(cases))).filter("is_wayback IS NOT NULL").select("archive_path", I.url_keys().alias("k")).collect()}
    assert keys[WB + "20030404183527/www.x.com/8080/a.htm"] == [f"{p}://{h}:8080/a.htm" for p in ("http", "https") for h in ("www.x.com", "x.com")]
    assert keys["http/X.com/a.htm"] == ["http://x.com/a.htm", "http://www.x.com/a.htm"]


def test_hidden_files_are_left_out(spark):
    files = archive(spark, ["http/x.com/.a", "http/.b/c.html", "http/node_modules/d.html", "http/x.com/e.html", "http/x.com/http_"])
    assert [r.archive_path for r in S.visible(files, S.IGNORED).collect()] == ["http/x.com/e.html"]


def nearest(spark, files, requests):
    frame = spark.createDataFrame(requests, "request_id long, ts string, url string")
    return {r.request_id: r.archive_path for r in R.nearest_snapshot(frame, archive(spark, files)).collect()}


def test_nearest_snapshot_is_by_number_and_prefers_its_own_folder(spark):
    files = [WB + t + "/x.com/a" for t in ("20001231235959", "20010201000000", "20011215022550", "20011215022550cs_", "2001121502255X")] + [WB + "2005/x.com/d/index.html"]
    got = nearest(spark, files, [(1, "20010101000000", "http://x.com/a"), (2, "20011215022550cs_", "X.COM/A"), (3, "20011215022551im_", "https/x.com/a"), (4, "1999", "x.com/d/"), (5, "1999", "x.com/none")])
    assert got == {1: WB + "20010201000000/x.com/a", 2: WB + "20011215022550cs_/x.com/a", 3: WB + "20011215022550/x.com/a", 4: WB + "2005/x.com/d/index.html", 5: None}


def test_nearest_snapshot_by_elapsed_time(spark):
    files = [WB + t + "/x.com/a" for t in ("20001231235959", "20010201000000", "2005")]
    frame = spark.createDataFrame([(1, "20010101000000", "x.com/a"), (2, "20041220", "x.com/a")], "request_id long, ts string, url string")
    out = R.nearest_snapshot(frame, archive(spark, files), "chronological").collect()
    assert {r.request_id: r.ts_dir for r in out} == {1: "20001231235959", 2: "2005"}


def test_nearest_snapshot_against_a_scan_of_all_folders(spark):
    rng = random.Random(5)
    dirs = sorted({"".join(rng.choice("0123456789") for _ in range(rng.choice([4, 8, 14]))) + rng.choice(["", "id_"]) for _ in range(60)})
    files = [WB + d + f"/x.com/{rng.choice('ab')}" for d in dirs]
    requests = [(i, "".join(rng.choice("0123456789") for _ in range(rng.choice([4, 14]))) + rng.choice(["", "id_"]), f"x.com/{rng.choice('ab')}") for i in range(60)] + [(100, dirs[3], "x.com/a")]
    number = lambda t: int("".join(c for c in t if c.isdigit()).ljust(14, "0"))
    want = {}
    for i, ts, url in requests:
        hits = sorted(f.split("/")[3] for f in files if f.endswith(url))
        best = ts if ts in hits else min(hits, key=lambda d: (abs(number(d) - number(ts)), d))
        want[i] = WB + best + "/" + url
    assert nearest(spark, files, requests) == want
    # Captures farther off than the winner change nothing.
    assert nearest(spark, [*files, WB + "99999999999999js_/x.com/a"], requests[:1])[0] == want[0] or number(requests[0][1]) > 5 * 10**13


def test_links_prefer_their_protocol_then_the_date(spark):
    files = [WB + "20010101/x.com/d/default.asp", WB + "20200101/x.com/d/index.html", "https/x.com/p.html", "http/www.x.com/p.html", WB + "2001/x.com/only.htm"]
    links = [("http://x.com/d/",), ("http://x.com/p",), ("https://www.x.com/p",), ("ftp://x.com/only",), ("//x.com/none/",), ("http://x.com/p#h",)]
    out = R.resolve_links(spark.createDataFrame(links, "url string"), I.url_index(archive(spark, files)), 20020101000000).collect()
    got = {r.url: (r.target_path, r.how) for r in out}
    assert got == {
        "http://x.com/d/": (WB + "20010101/x.com/d/default.asp", "index"), "http://x.com/p": ("http/www.x.com/p.html", "index"), "https://www.x.com/p": ("https/x.com/p.html", "index"),
        "ftp://x.com/only": (WB + "2001/x.com/only.htm", "index"), "//x.com/none/": ("http/x.com/none/index.html", "fallback"), "http://x.com/p#h": ("http/www.x.com/p.html", "index"),
    }


def test_smart_find(spark):
    files = ["http/www.x.com/A/b.htm", "https/y.com/index.html", "http/z.com/8080/p", "index.html", WB + "2001/www.q.com/a"]
    asked = ["http/x.com/a/B.HTM", "https://www.y.com", "z.com:8080/p", "", WB + "2001/q.com/a", WB + "2001/WWW.q.com/./a", "nothing", "x.com/a/b.htm"]
    out = R.smart_find(spark.createDataFrame(list(enumerate(asked)), "request_id long, url string"), archive(spark, files)).collect()
    assert {r.request_id: r.archive_path for r in out} == {0: files[0], 1: files[1], 2: files[2], 3: files[3], 4: None, 5: files[4], 6: None, 7: files[0]}


PAGE = WB + "20030404183527/www.x.com/dir/p.htm"


def flattened(spark, body, path=PAGE, more=None):
    out = W.flatten(archive(spark, {path: body, **(more or {})}), 20080101000000).collect()
    return {r.archive_path: r for r in out}[path].content.decode("latin-1")


REWRITES = [
    ('<a href="/img/c.gif">', '<a href="../img/c.gif">'),
    ('<a href="/dir/q.htm#s">', '<a href="./q.htm#s">'),
    ("<a href = 'q.htm'>", "<a href = 'q.htm'>"),
    ('<a href="#top"><a href="mailto:a@b">', '<a href="#top"><a href="mailto:a@b">'),
    ('p{background:url("/dir/b.png")}', "p{background:url(./b.png)}"),
    ('<a href="/dir/r.asp">', '<a href="./r.asp.html">'),
    ("<img DATA-SRC = '/i.gif'>", "<img DATA-SRC='../i.gif'>"),
    ('@import url("/c.css");', "@import url(../c.css);"),
    ('@import "/c.css" ;', '@import "../c.css";'),
    ('<a href="/web/2001/http://y.com/z.htm?q#h">', '<a href="../../../2001/y.com/z.htm?q#h#h">'),  # a computed path keeps the query
    ('var u = "//web.archive.org/web/2001im_/http://y.com/z.gif";', 'var u = "../../../../../../http/y.com/z.gif";'),
    ("'https://web-static.archive.org/_static/a.css?v=1'", "'../../../../../web-static.archive.org/_static/a.css?v=1'"),
    ("x\x85\xa0\xff y", "x\x85\xa0\xff y"),
]


def test_flattening_rewrites(spark):
    pages = {PAGE.replace("p.htm", f"p{i}.htm"): body for i, (body, _) in enumerate(REWRITES)}
    out = {r.archive_path: r.content.decode("latin-1") for r in W.flatten(archive(spark, pages), 20080101000000).collect()}
    assert [out[PAGE.replace("p.htm", f"p{i}.htm")] for i in range(len(REWRITES))] == [want for _, want in REWRITES]


def test_flattening_of_direct_pages_and_of_what_is_there(spark):
    assert flattened(spark, '<a href="/img/c.gif">', "http/www.x.com/dir/p.htm") == '<a href="/img/c.gif">'
    there = {WB + "20030404183527/www.x.com/a.php": "<HTML>", WB + "2004/www.x.com/b.jpg": "\xff\x00", WB + "2004/www.x.com/s.asp": "p{}"}
    text = flattened(spark, '<a href="/a.php"><img src="http://x.com/b.jpg"><a href="/s.asp">', more=there)
    assert text == '<a href="../a.php.html"><img src="../../../2004/www.x.com/b.jpg"><a href="../../../2004/www.x.com/s.asp.html">'
    out = {r.archive_path: r for r in W.flatten(archive(spark, there), 20080101000000).collect()}
    assert {p: (r.output_path.endswith(".html"), r.action) for p, r in out.items()} == {p: (p.endswith((".php", ".asp")), "copied" if p.endswith(".jpg") else "rewritten") for p in there}
    assert bytes(out[WB + "2004/www.x.com/b.jpg"].content) == b"\xff\x00"


INJECTED = (
    "<!-- BEGIN WAYBACK TOOLBAR INSERT -->\nbar<!-- END WAYBACK TOOLBAR INSERT --><script src='/x/athena.js'></script><script>\nwindow.RufflePlayer = 1;</script><script src=\"//a/ruffle.js\">\n</script>"
    "<!-- End Wayback Rewrite JS Include -->"
)


def texts(spark, text, of):
    return spark.createDataFrame([(text,)], "t string").select(of(F.col("t"))).first()[0]


def test_cleaning(spark):
    assert texts(spark, f"a{INJECTED}b", W.clean_server) == "ab"
    wm = '<script src="/s/wombat.js?v=1"></script><script>__wm.init("https://web.archive.org/web");</script><base  href="x"><BASE><link rel="s" href="https://archive.org/a.css">'
    assert texts(spark, f"a{INJECTED}{wm}b", W.clean_flat) == "ab"
    kept = texts(spark, wm + "https://web-static.archive.org/_static/x", lambda c: W.clean_server(c, "http://h:1"))
    assert '__wm.init("http://h:1/web")' in kept and kept.endswith("/_static/x")


def test_server_rewriting(spark):
    cases = {
        '<a href="https://www.web.archive.org/web/2001/http://x.com/">': '<a href="/web/2001/http://x.com/">',
        "<a HREF='/web/2001/x'>": "<a HREF='/web/2001/x'>",
        "<a href='a.htm'>": "<a href='a.htm'>",
        "<img src='http://archive.org/logo.png'>": '<img src="/archive.org/logo.png">',
        '<img src="http://x.com/a b.png">': '<img src="/web/2005/http://x.com/a b.png">',
        "a{b:url(\"http://x.com/c.png\")}": "a{b:url('/web/2005/http://x.com/c.png')}",
        "a{b:url(/c.png)}": "a{b:url(/c.png)}",
        "var a='//web.archive.org/web/2001/http://x'": "var a='/web/2001/http://x'",
    }
    for text, want in cases.items():
        assert texts(spark, text, lambda c: W.rewrite_server(c, F.lit("2005"))) == want


def test_requests_get_responses(spark):
    files = {
        "index.html": "root", PAGE: '<meta charset="x-mac"><a href="http://y.com/">', WB + "2004/www.x.com/plain.html": "<p>", WB + "2004/www.x.com/s.css": "a{b:url(http://y/c)}", WB + "2004/www.x.com/i.gif": "GIF",
        "https/web-static.archive.org/_static/js/w.js": "w", "http/x.com/f.txt": "t",
    }
    paths = ["/", "/web/2003/http://www.x.com/dir/p.htm?q", "/web/2004/www.x.com/plain.html", "/web/2004cs_/http://www.x.com/s.css", "/web/2004/www.x.com/i.gif", "/_static/js/w.js?v=2", "http://h:80/http/x.com/F.TXT", "/web/2004/none", "/nope%zz", "/http/x.com/?q", "/http://x.com", "/http/none/"]
    out = V.serve(spark.createDataFrame(list(enumerate(paths)), "request_id long, path string"), archive(spark, files))
    got = {r.request_id: (r.status, r.content_type, bytes(r.body)) for r in out.collect()}
    assert got == {
        0: (200, "text/html; charset=iso-8859-1", b"root"),
        1: (200, "text/html; charset=x-mac", b'<meta charset="x-mac"><a href="/web/20030404183527/http://y.com/">'),
        2: (200, "text/html; charset=iso-8859-1", b"<p>"),
        3: (200, "text/css", b"a{b:url('/web/2004/http://y/c')}"),
        4: (200, "image/gif", b"GIF"), 5: (200, "application/javascript", b"w"), 6: (200, "text/plain", b"t"), 7: (404, "text/plain", b"404: Page not found locally."), 8: (400, "text/plain", b"400 Bad Request"),
        9: (200, "text/html; charset=utf-8", got[9][2]), 10: got[9], 11: (404, "text/plain", b"404 Not Found"),
    }
    assert b'<a href="/http">[ Parent Directory ]</a>' in got[9][2] and b'<a href="/http/x.com/f.txt">f.txt</a></td><td class="size">0.0 KB' in got[9][2]


def test_large_folders_are_listed_in_pages(spark, monkeypatch):
    monkeypatch.setattr(C, "LISTED", 2)
    files = archive(spark, [f"d/{i}.txt" for i in range(5)])
    asked = spark.createDataFrame([(0, "/d/"), (1, "/d?page=1"), (2, "/d?page=2"), (3, "/d?page=3"), (4, "/")], "request_id long, path string")
    got = {r.request_id: (r.status, bytes(r.body).decode()) for r in V.serve(asked, files).collect()}
    assert [got[i][1].count("[FILE]") for i in range(3)] == [2, 2, 1] and got[3][0] == 404 and "?page=1" in got[0][1] and "?page" not in got[2][1]
    assert 'href="/d/">d</a>' in got[4][1]


def test_catalogue_rows(spark, tmp_path):
    files = {WB + "20030404183527/www.x.com/a.htm": "x" * 1025, WB + "2003/www.x.com/a.htm": "x", "http/x.com/a.htm": "x" * 1024, "http/x.com/screenshot.html": "x", "http/x.com/e.html": "", "http/x.com/index": "<"}
    rows = C.ordered(C.describe(C.pages(archive(spark, files))))
    assert [(r.pos, r.type, r.date_display, r.domain, r.size) for r in rows.orderBy("pos").collect()] == [
        (1, "Direct", "2023-11-14 22:13", "http", "1KB"), (2, "Direct", "2023-11-14 22:13", "http", "1KB"), (3, "Direct", "2023-11-14 22:13", "https", "1KB"), (4, "Wayback", "2003-04-04 18:35", "www.x.com", "2KB"),
    ]
    (page,) = C.report(rows, "now").collect()
    text = bytes(page.content).decode()
    assert page.path == "index.html" and text.count("<tr class=") == 4 and text.index('"row-norm"') < text.index('"row-alt"') and "<h1>Local Web Archive Index (4 Pages)</h1>" in text and "Generated on now" in text
    assert '\n    <tr class="row-alt">\n        <td align="center"><span class="b-wb">WAYBACK</span></td>\n        <td class="sml">2003-04-04 18:35</td>\n        <td class="dom">www.x.com</td>\n' in text


def test_reports_of_many_pages_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(C, "LISTED", 2)
    rows = C.ordered(C.describe(C.flat_pages(archive(spark, [f"http/x.com/{i}.html" for i in range(5)] + ["index-2.html", "index.html"])), flat=True))
    out = {r.path: bytes(r.content).decode() for r in C.report(rows, "now", flat=True).collect()}
    assert {p: t.count("<tr class=") for p, t in out.items()} == {"index.html": 2, "index-2.html": 2, "index-3.html": 1}
    assert "(5 Pages)" in out["index-3.html"] and 'href="index-3.html">more' in out["index-2.html"] and "more" not in out["index-3.html"]
    (none,) = C.report(rows.limit(0), "now").collect()
    assert none.path == "index.html" and b"(0 Pages)" in bytes(none.content)


def test_listing_has_folders_first(spark):
    out = C.listing(archive(spark, {"d/B.txt": "x" * 1280, "d/a.txt": "x", "d/z/1": "x", "e": "x"})).collect()
    assert [(r.name, r.is_dir, r.size) for r in sorted(out, key=lambda r: r.pos) if r.dir == "d"] == [("z", True, "-"), ("a.txt", False, "0.0 KB"), ("B.txt", False, "1.3 KB")]
    assert [r.name for r in sorted(out, key=lambda r: r.pos) if r.dir == ""] == ["d", "e"]


def test_url_lists(spark):
    lines = [" http://a ", "#c", "", "http://a", "http://b/screenshot/x", "http://b"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert sorted(map(tuple, N.load_urls(frame).collect())) == [(0, "http://a"), (5, "http://b")]
    urls = spark.createDataFrame(list(enumerate(["http://a/1", "http://a/2", "http://a/3", "http://a/4", "httpbin.org/x", "http://a/1?q"])), "line_no long, url string")
    stored = archive(spark, {"http/a/2": "x", "http/a/3/index.html": "x", "http/a/4": ""})
    left = N.pending(urls, urls.filter("url = 'http://a/1'"), stored).collect()
    assert sorted((r.url, r.dest) for r in left) == [("http://a/1?q", "http/a/1"), ("http://a/4", "http/a/4")]
    assert [tuple(r) for r in N.path_collisions(urls).collect()] == [("http/a/1", 2, "http://a/1")]


def fetcher():
    """A getter made here, so that workers get it by value and need no module of the tests."""

    def get(url):
        pages = {"http://a/ok": (200, {"content-type": "text/html"}, b"page"), "http://a/r": (302, {"location": "/ok"}, b""), "http://a/loop": (302, {"location": "/loop"}, b""), "http://a/e": (200, {}, b""), "http://a/d.js": (200, {}, b"js")}
        if url == "http://a/boom":
            raise OSError("no route")
        return pages.get(url, (404, {}, b"no"))

    return get


def test_fetching(spark):
    urls = [f"http://a/{x}" for x in ("ok", "r", "loop", "e", "d.js", "boom", "none")]
    plan = spark.createDataFrame([(u, u.replace("://", "/")) for u in urls], "url string, dest string")
    got = {r.url: (r.dest, r.error, r.content and bytes(r.content)) for r in N.fetch(plan, fetcher()).collect()}
    assert got["http://a/ok"] == ("http/a/ok/index.html", None, b"page") and got["http://a/r"] == ("http/a/r/index.html", None, b"page") and got["http://a/d.js"] == ("http/a/d.js", None, b"js")
    assert {u: e for u, (_, e, _) in got.items() if e} == {"http://a/loop": "too many redirects", "http://a/e": "empty", "http://a/boom": "no route", "http://a/none": "HTTP 404"}


def test_http_getter_and_redirects(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            code, place, body = {"/ok": (200, None, b"page"), "/d/r": (302, "n?x", b"")}.get(self.path, (200, None, self.headers["Accept"].encode()) if self.path == "/d/n?x" else (404, None, b"no"))
            self.send_response(code)
            if place:
                self.send_header("Location", place)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    plan = spark.createDataFrame([(base + p, f"http/a{p}") for p in ("/ok", "/d/r", "/none")], "url string, dest string")
    got = {r.dest: (r.status, r.error, r.content and bytes(r.content)) for r in N.fetch(plan).collect()}
    server.shutdown()
    assert got == {"http/a/ok": (200, None, b"page"), "http/a/d/r": (200, None, N.HEADERS["Accept"].encode()), "http/a/none": (404, "HTTP 404", None)}
    from tidemark.functions.urls import redirect_target

    cases = [(u, t) for u in ("http://x.com/a/b?q", "https://x.com", "http://x.com:8080/a/") for t in ("/c", "c.htm", "http://y.com/d", "//z.com/e")]
    rows = spark.createDataFrame(cases, "u string, t string").select("u", "t", redirect_target(F.col("u"), F.col("t")).alias("to")).collect()
    assert all(N.redirected(r.u, r.t) == r.to for r in rows)


def test_ingestion_resumes(spark, tmp_path):
    lists, state, root = (str(tmp_path / x) for x in ("lists", "state", "root"))
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "one.txt").write_text("http://a/ok\nhttp://a/none\n# no\n")
    ingest(spark, lists, state, root, fetcher()).awaitTermination()
    from tidemark.streaming.ingest import compact, recorded

    done = lambda: sorted(r.url for r in recorded(spark, state).collect())
    assert done() == ["http://a/ok"] and (tmp_path / "root/http/a/ok/index.html").read_bytes() == b"page"
    (tmp_path / "lists" / "two.txt").write_text("http://a/ok\nhttp://a/d.js\n")
    ingest(spark, lists, state, root, fetcher()).awaitTermination()
    assert done() == ["http://a/d.js", "http://a/ok"]
    ingest(spark, lists, state, root, fetcher()).awaitTermination()
    assert done() == ["http://a/d.js", "http://a/ok"]
    compact(spark, state)
    compact(spark, state)
    assert done() == ["http://a/d.js", "http://a/ok"] and len(list((tmp_path / "state/record/segments").iterdir())) == 1 and not list((tmp_path / "state/fetched").iterdir())


def test_ingestion_skips_stored_files_and_keeps_the_first_of_a_path(spark, tmp_path):
    lists, state, root = (str(tmp_path / x) for x in ("lists", "state", "root"))
    calls = tmp_path / "calls"
    for x in (calls, tmp_path / "lists", tmp_path / "root/http/a/_x/page"):
        x.mkdir(parents=True)
    (tmp_path / "root/http/a/d.js").write_bytes(b"kept")
    (tmp_path / "root/http/a/_x/page/index.html").write_bytes(b"kept")
    (tmp_path / "root/http/a/empty.js").write_bytes(b"")

    def get(url):
        name = url.replace("/", "_")
        (calls / name).write_text("")
        return (404, {}, b"no") if "gone" in url else (200, {"content-type": "text/html" if "ok" in url or "page" in url else ""}, url.encode())

    urls = ["http://a/d.js", "http://a/_x/page", "http://a/empty.js", "http://a/ok/index.html", "http://a/ok", "http://a/t.js#gone", "http://a/t.js#1", "http://a/t.js#2"]
    (tmp_path / "lists" / "one.txt").write_text("\n".join(urls))
    ingest(spark, lists, state, root, get).awaitTermination()
    fetched = {x.name for x in calls.iterdir()}
    assert fetched == {u.replace("/", "_") for u in ("http://a/empty.js", "http://a/ok/index.html", "http://a/t.js#gone", "http://a/t.js#1")}
    files = {u: (tmp_path / "root/http/a" / u).read_bytes() for u in ("d.js", "_x/page/index.html", "empty.js", "ok/index.html", "t.js")}
    from tidemark.streaming.ingest import recorded

    assert {r.url for r in recorded(spark, state).collect()} == set(urls) - {"http://a/t.js#gone"}
    assert files == {"d.js": b"kept", "_x/page/index.html": b"kept", "empty.js": b"http://a/empty.js", "ok/index.html": b"http://a/ok/index.html", "t.js": b"http://a/t.js#1"}


def test_a_mark_in_a_page_stays(spark):
    for text in ("<a href=\x00\"http://x.com/\">", "a{b:url\x00('c')}", "x\x01y"):
        assert texts(spark, text, lambda c: W.rewrite_server(c, F.lit("2005"))) == text


def test_pages_that_cannot_be_rewritten_are_copied(spark, monkeypatch):
    rows = spark.createDataFrame([("a.html", None), ("b.html", "<p>")], "archive_path string, text string")
    assert {r.archive_path: r.text for r in W.rewritten(rows, archive(spark, []), 2008).collect()} == {"a.html": None, "b.html": "<p>"}
    files = archive(spark, {"http/x.com/a.html": "<p>", "http/x.com/b.gif": "g"}).withColumn("content", F.when(F.col("archive_path").endswith("gif"), F.lit(None)).otherwise(F.col("content")))
    assert {r.archive_path: r.action for r in W.flatten(files, 2008).collect()} == {"http/x.com/a.html": "rewritten", "http/x.com/b.gif": "error"}

    def broken(frame, known):
        return frame.select("archive_path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("failed"), F.array().cast("array<struct<form:string,matched:string>>").alias("missed"))

    monkeypatch.setattr(W, "_put", broken)
    assert [(r.action, r.failed, bytes(r.content)) for r in W.flatten(archive(spark, {"http/x.com/a.html": "<p>"}), 2008).collect()] == [("copied", True, b"<p>")]


def by_passes(spark, text, path, captures):
    """The passes in their order, each link resolved by itself as it is met."""
    best = R.best_captures(I.url_entries(captures), 20080101000000)
    html = I.sniffed(captures).filter("is_html").select("archive_path")
    for _ in range(200):
        missed = W._replaced(text, known := {} if _ == 0 else known)[1]
        if not missed:
            return W._replaced(text, known)[0]
        form, matched = missed[0]
        one = spark.createDataFrame([(path, form, matched)], "src_path string, form string, matched string")
        known[f"{form} {matched}"] = W.resolved_links(one, best, html, 20080101000000).first().rel


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # The first pass appends .html to the name that the second one meets.
        ('<a data="http://x.com/url(/q.php" )>', '<a data="../../../../../../http/x.com/url(../q.php.html)>'),
        ('<a data="http://x.com/url(/url(/q.php" )>', None),
        ("'https://web-static.archive.org/_static/../a/./b.css'", "'../../../../../web-static.archive.org/a/b.css'"),
        ("x\xa0/web/2001/http://y.com/z\xa0y", "x\xa0../../../2001/y.com/z\xa0y"),
    ],
)
def test_links_that_a_pass_brings_about(spark, body, want):
    got = flattened(spark, body)
    assert got == (want or got) and got == by_passes(spark, body, PAGE, archive(spark, {PAGE: body}))


def test_captures_that_share_a_path_are_rewritten_each_by_itself(spark):
    bodies = ['<a href="/img/a.gif"><a href="/q.php">', '<a href="/img/a.gif"><a href="/b.htm">', '<a data="http://x.com/url(/q.php" )>']
    files = [(PAGE, b) for b in bodies] + [(WB + "20030404183527/www.x.com/q.php", b) for b in ("<html>", "<html>2")]
    rows = spark.createDataFrame([(p, len(b), b.encode()) for p, b in files], "archive_path string, size long, content binary")
    out = sorted((r.output_path, bytes(r.content).decode()) for r in W.flatten(rows, 20080101000000).collect())
    alone = [flattened(spark, b, more={files[-1][0]: "<html>"}) for b in bodies]
    assert out == sorted([(PAGE, a) for a in alone] + [(files[-1][0] + ".html", b) for b in ("<html>", "<html>2")])


def test_no_failing_capture_is_lost_or_doubled(spark, monkeypatch):
    put = W._put

    def broken(frame, known):
        failed = F.col("text").contains("broken")
        return put(frame, known).withColumn("failed", failed).withColumn("text", F.when(~failed, F.col("text")))

    monkeypatch.setattr(W, "_put", broken)
    files = {"http/x.com/a.html": "broken", "http/x.com/b.asp": "broken <html>", "http/x.com/c.html": "<p>", "http/x.com/d.gif": "broken"}
    out = {r.output_path: (r.action, r.failed, bytes(r.content).decode()) for r in W.flatten(archive(spark, files), 2008).collect()}
    assert out == {"http/x.com/a.html": ("copied", True, "broken"), "http/x.com/b.asp.html": ("copied", True, "broken <html>"), "http/x.com/c.html": ("rewritten", False, "<p>"), "http/x.com/d.gif": ("copied", False, "broken")}


def test_tables_that_grow_with_the_pages_are_not_broadcast(spark):
    files = archive(spark, {PAGE: '<a href="/b.asp">', WB + "2003/www.x.com/b.asp": "<html>"})
    best, texts = R.best_captures(I.url_entries(files), 2008), W.cleaned(files)
    known = W.resolved_links(W.page_links(texts), best, I.sniffed(files).filter("is_html").select("archive_path"), 2008)
    for df in (known, W._put(texts, known), R.resolve_links(spark.createDataFrame([("http://x.com/b.asp",)], "url string"), I.url_entries(files), 2008), W.flatten(files, 2008)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan


def test_static_files_share_the_folder_that_the_page_is_in(spark):
    assert flattened(spark, "'https://web-static.archive.org/_static/js/a.js'", "https/x.com/a/p.html") == "'../../web-static.archive.org/_static/js/a.js'"
    assert flattened(spark, "'https://web-static.archive.org/_static/js/a.js'", "p.html") == "'./https/web-static.archive.org/_static/js/a.js'"


def test_configuration(spark, tmp_path):
    from tidemark.sources.config import save_location

    (tmp_path / "c.json").write_text('{"currentSaveLocation": "__USER_DOCUMENTS__/web"}')
    assert save_location(spark, str(tmp_path / "c.json"), "/docs") == "/docs/web"
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(ValueError, match="currentSaveLocation"):
        save_location(spark, str(tmp_path / "d.json"))


def test_staged_tables_are_in_one_folder_of_the_run(spark):
    from tidemark.sources.staging import staged, staging_dir

    kept = staged(spark.range(3), "kept")
    assert kept.count() == 3 and all(staging_dir(spark) in f for f in kept.inputFiles())


def test_shuffles_that_are_to_be_freed_go_once_a_table_is_staged(spark):
    import time

    from tidemark.sources.staging import staged

    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in (found.apply(i).name() for i in range(found.size())) if b.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, before, was = spark.range(1000).repartition(3, "id"), blocks(), spark.conf.get(setting)
    assert staged(rows, "freed", freed=True).count() == 1000 and spark.conf.get(setting) == was
    until = time.time() + 20
    while (left := {b for b in blocks() - before if b.endswith(".data")}) and time.time() < until:
        # The count above has a shuffle of its own, which is one block of one map.
        if len({b.split("_")[1] for b in left}) == 1:
            break
        time.sleep(0.2)
    assert len({b.split("_")[1] for b in left}) <= 1


def test_what_a_scope_has_staged_goes_with_it(spark):
    import os
    from urllib.parse import urlsplit

    from tidemark.sources.staging import staged, staging_scope

    at = lambda df: os.path.exists(urlsplit(df.inputFiles()[0]).path)
    outside = staged(spark.range(3), "outside")
    with staging_scope(spark):
        outer = staged(spark.range(4), "outer")
        with staging_scope(spark):
            inner = staged(outer, "inner")
            assert inner.count() == 4
        assert not at(inner) and at(outer)
    assert not at(outer) and outside.count() == 3
    with pytest.raises(ZeroDivisionError), staging_scope(spark):
        outer = staged(spark.range(4), "outer")
        raise ZeroDivisionError
    assert not at(outer)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as Fake

    from tidemark.sources.staging import checkpoint_dir

    context = Fake(getConf=lambda: Fake(get=lambda *_: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Fake(sparkContext=context, conf=Fake(get=lambda *_: None)))


def test_files_round_trip(spark, tmp_path):
    data = {"http/x.com/a.bin": bytes(range(256)), "b/../../c": b"kept inside", "e": b""}
    write_tree(spark.createDataFrame(list(data.items()), "path string, content binary"), str(tmp_path / "t"))
    back = {r.archive_path: bytes(r.content) for r in S.from_files(spark, str(tmp_path / "t")).collect()}
    assert back == {"http/x.com/a.bin": bytes(range(256)), "b/c": b"kept inside"}


def test_state_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('["http://a", "http://b"]')
    assert S.json_state(spark, str(tmp_path / "s.json"), "array<string>").first().state == ["http://a", "http://b"]
    assert S.json_state(spark, str(tmp_path / "none.json"), "array<string>").count() == 0
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert [r.line for r in S.url_list(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == ["a", "b"]

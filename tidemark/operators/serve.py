"""Requests to an archive server as a batch: routes, lookups and responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import DOT, SERVED_AS_HTML, charset, ext_of, mime_type
from ..functions.urls import decoded_strictly
from ..sources.staging import staged
from ..sources.writer import file_system, place_of
from .catalogue import listing_html, placed
from .lookup import Lookup, ServingIndex, lookup_of
from .resolve import asked_files, asked_snapshots, files_found
from .rewrite import clean_server, latin1, rewrite_server

_ROUTE = rf"^/(?:https?/)?(?:web\.archive\.org/)?web/(\d{{4,14}})([a-z0-9_]+)?/({DOT}*)"

#: Bytes of a body in one row where it goes out in pieces.
PIECE = 1 << 20

# Where static files are, and the texts of responses without a file.
STATIC_ROOT = "https/web-static.archive.org/_static/"
NOT_CAPTURED, NOT_FOUND, BAD_REQUEST, SERVER_ERROR = "404: Page not found locally.", "404 Not Found", "400 Bad Request", "Server Error"


def parse_requests(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, path) with route (root, static, wayback or file), ts and url."""
    return _parsed(requests).drop("bad")


def _parsed(requests: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", r"^https?://[^/]+", "")
    route = F.when(path.isin("/", "/index.html"), "root").when(path.startswith("/_static/"), "static").when(path.rlike(_ROUTE), "wayback").otherwise("file")
    plain = F.regexp_replace(path, rf"\?{DOT}*$", "")
    ts = F.concat(F.regexp_extract(path, _ROUTE, 1), F.regexp_extract(path, _ROUTE, 2))
    cut = requests.select("request_id", "path", route.alias("route"), F.when(route == "wayback", ts).alias("ts"), plain.alias("plain"), F.when(route == "wayback", F.regexp_replace(F.regexp_extract(path, _ROUTE, 3), rf"[?#]{DOT}*$", "")).alias("asked"))
    decoded = cut.withColumn("decoded", decoded_strictly(F.col("plain")))
    url = F.coalesce("asked", F.regexp_replace(F.coalesce("decoded", "plain"), "^/", ""))
    return decoded.select("request_id", "path", "route", "ts", url.alias("url"), ((F.col("route") != "wayback") & F.col("decoded").isNull()).alias("bad"))


def needs_buffer(path: Column, archived: Column) -> Column:
    """Whether a file is read whole before it goes out: for its charset, or to be rewritten."""
    return ext_of(path).isin(*SERVED_AS_HTML) | (ext_of(path).isin(".css", ".js") & archived)


def _static_path(url: Column) -> Column:
    return F.concat(F.lit(STATIC_ROOT), F.regexp_replace(url, "^_static/", ""))


def static_lookup(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """(request_id, archive_path) of parsed static requests; null where there is no such file."""
    asked = requests.filter("route = 'static'").select("request_id", _static_path(F.col("url")).alias("wanted"))
    return asked.join(captures.select("archive_path"), F.col("wanted") == F.col("archive_path"), "left").select("request_id", "archive_path")


def _probes(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What parsed requests ask for: snapshots (req_dir, ts_num, fold), files (attempt, fold) and static files (wanted, fold)."""
    wanted = _static_path(F.col("url"))
    static = parsed.filter("route = 'static'").select("request_id", wanted.alias("wanted"), F.lower(wanted).alias("fold"))
    return asked_snapshots(parsed.filter("route = 'wayback'")), asked_files(parsed.filter("route IN ('root', 'file')")), static


def _dir_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, ":/", "/"), "/+", "/"), "^/|/$", "")


def _lookup(parsed: DataFrame, index: ServingIndex) -> Lookup:
    """What of an index the parsed requests need."""
    snapshots, paths, static = (p.select("fold") for p in _probes(parsed))
    return index.lookup(snapshots.union(paths).union(static), parsed.filter("route IN ('root', 'file')").select(_dir_of(F.col("url")).alias("dir")))


def locate(parsed: DataFrame, where: Lookup) -> DataFrame:
    """``parsed`` with archive_path and ts_dir, null where there is no file."""
    snapshots, paths, static = _probes(parsed)
    none = F.lit(None).cast("string").alias("ts_dir")
    wayback = where.nearest(snapshots).select("request_id", "archive_path", "ts_dir")
    statics = static.join(where.files.filter("variant = 0").select("fold", "archive_path"), "fold").filter("archive_path = wanted").select("request_id", "archive_path", none)
    found = files_found(paths, where.files).select("request_id", "archive_path", none)
    return parsed.join(wayback.unionByName(statics).unionByName(found), "request_id", "left")


def folders(missing: DataFrame, where: Lookup) -> DataFrame:
    """(request_id, listed): listing pages for located requests without a file that name folders; ``?page=`` names the page.

    Only folders that are asked for are put in order.
    """
    page = F.coalesce(F.regexp_extract("path", r"[?&]page=(\d{1,9})", 1).try_cast("long"), F.lit(0))
    asked = missing.filter("route IN ('root', 'file')").select("request_id", _dir_of(F.col("url")).alias("dir"), page.alias("page"))
    listed = staged(where.entries.join(asked.select("dir").distinct(), "dir", "left_semi"), "listed")
    if listed.isEmpty():
        return asked.select("request_id", F.lit(None).cast("string").alias("listed")).limit(0)
    return asked.join(listing_html(placed(listed)), ["dir", "page"]).select("request_id", F.col("html").alias("listed"))


def malformed(path: Column) -> Column:
    """Whether a path has a percent sign that encodes nothing, or bytes that aren't UTF-8."""
    return decoded_strictly(F.regexp_replace(path, rf"\?{DOT}*$", "")).isNull()


def _located(requests: DataFrame, where) -> DataFrame:
    """Requests with bad, archive_path, ts_dir and listed, written once; ``where`` gives a Lookup for parsed requests."""
    parsed = staged(_parsed(requests), "parsed")
    lookup = where(parsed)
    found = staged(locate(parsed, lookup), "found")
    return found.join(folders(found.filter("archive_path IS NULL"), lookup), "request_id", "left")


def _headed(found: DataFrame, body: Column, given: Column | None = None) -> DataFrame:
    """Status, content type, length and body of located requests, with ``body`` for those that have a file.

    ``given`` is the length of bodies that aren't here.
    """
    path, listed = F.col("archive_path"), F.col("listed")
    html = ext_of(path).isin(*SERVED_AS_HTML)
    found = found.withColumn("body", body)
    kind = F.concat(mime_type(path), F.when(html, F.concat(F.lit("; charset="), F.coalesce(charset(F.col("body")), F.lit("iso-8859-1")))).otherwise(""))
    said = F.when(F.col("bad"), BAD_REQUEST).when(F.col("route") == "wayback", NOT_CAPTURED).otherwise(NOT_FOUND)
    fault = F.col("unreadable")
    status = F.when(fault, 500).when(path.isNotNull() | listed.isNotNull(), 200).when(F.col("bad"), 400).otherwise(404)
    sent = F.when(fault, F.encode(F.lit(SERVER_ERROR), "UTF-8")).otherwise(F.coalesce("body", F.when(path.isNull(), F.encode(F.coalesce(listed, said), "UTF-8"))))
    length = F.octet_length(sent).cast("long")
    return found.select(
        "request_id", status.alias("status"), F.when(fault, "text/plain").when(path.isNotNull(), kind).when(listed.isNotNull(), "text/html; charset=utf-8").otherwise("text/plain").alias("content_type"),
        (length if given is None else F.coalesce(length, given)).alias("content_length"), "archive_path", sent.alias("body"),
    )


def _rewritten(content: Column, origin: str | None) -> Column:
    """A file's bytes as they go out: archived pages, style sheets and scripts rewritten for their snapshot's time."""
    text = rewrite_server(clean_server(latin1(content), origin), F.col("ts_dir"))
    archived = F.col("ts_dir").isNotNull() & needs_buffer(F.col("archive_path"), F.lit(True))
    return F.when(archived, F.encode(text, "ISO-8859-1")).otherwise(content)


def serve(requests: DataFrame, captures: DataFrame, origin: str | None = None, index: ServingIndex | None = None) -> DataFrame:
    """(request_id, status, content_type, content_length, archive_path, body) of requests (request_id, path).

    Archived pages, style sheets and scripts are rewritten for their snapshot's time; all else goes
    out as it is. A page without a declared charset is served as ISO-8859-1. A folder without a page
    of its own is listed. What isn't there is 404, a path outside the archived pages that can't be
    decoded 400. ``captures`` has archive_path, size and content. With an ``index`` of them only its
    buckets that the requests ask for are read.
    """
    found = _located(requests, (lambda parsed: _lookup(parsed, index)) if index else lambda parsed: lookup_of(captures, asked_snapshots(parsed.filter("route = 'wayback'")).select("fold")))
    hits = found.join(captures.select("archive_path", "content"), "archive_path", "left").withColumn("unreadable", F.lit(False))
    return _headed(hits, _rewritten(F.col("content"), origin))


def serve_files(requests: DataFrame, index: ServingIndex, root: str, origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses and bodies of requests for the files under ``root``, which only tasks read, and only where asked for.

    The responses are (request_id, status, content_type, content_length, archive_path), the bodies (request_id, offset,
    piece), in pieces of at most PIECE bytes. What must be seen whole, to find its charset or to be rewritten, is read
    whole; all else in pieces, of which a task holds one at a time, whatever the file's size. A file that can't be
    read is a 500.
    """
    found = staged(_located(requests, lambda parsed: _lookup(parsed, index)), "located")
    path = F.col("archive_path")
    whole = path.isNotNull() & needs_buffer(path, F.col("ts_dir").isNotNull())
    read = staged(found.withColumn("whole", whole).filter("archive_path IS NOT NULL").select("request_id", "archive_path", "whole").mapInPandas(_reader(root), "request_id long, content binary, length long"), "read")
    joined = found.withColumn("whole", whole).join(read, "request_id", "left").withColumn("unreadable", path.isNotNull() & F.col("length").isNull())
    heads = staged(_headed(joined, F.when(F.col("whole"), _rewritten(F.col("content"), origin)), F.col("length")), "heads")
    here = in_pieces(heads.filter("body IS NOT NULL"), PIECE)
    away = heads.filter("body IS NULL").select("request_id", "archive_path").mapInPandas(_pieces(root), "request_id long, offset long, piece binary")
    return heads.drop("body"), here.unionByName(away)


def in_pieces(responses: DataFrame, size: int) -> DataFrame:
    """(request_id, offset, piece) of the bodies of responses (request_id, body), in order of offset without gaps; none for an empty one."""
    offsets = F.sequence(F.lit(0).cast("long"), F.octet_length("body").cast("long") - 1, F.lit(size).cast("long"))
    each = responses.filter(F.octet_length("body") > 0).select("request_id", "body", F.explode(offsets).alias("offset"))
    return each.select("request_id", "offset", F.substring("body", F.col("offset").cast("int") + 1, F.lit(size)).alias("piece"))


def _reader(root: str):
    def run(frames):
        from pyarrow import fs

        where, top = file_system(root)
        for frame in frames:
            for request, path, whole in zip(frame["request_id"], frame["archive_path"], frame["whole"], strict=True):
                try:
                    place = place_of(top, path)
                    info = where.get_file_info(place)
                    content, length = None, info.size if info.type == fs.FileType.File else None
                    if whole and length is not None:
                        with where.open_input_stream(place) as f:
                            content = f.read()
                            length = len(content)
                except OSError:
                    content, length = None, None
                yield pd.DataFrame({"request_id": [request], "content": pd.Series([content], dtype=object), "length": pd.Series([length], dtype="Int64")})

    return run


def _pieces(root: str):
    def run(frames):
        where, top = file_system(root)
        for frame in frames:
            for request, path in zip(frame["request_id"], frame["archive_path"], strict=True):
                with where.open_input_stream(place_of(top, path)) as f:
                    offset = 0
                    while piece := f.read(PIECE):
                        yield pd.DataFrame({"request_id": [request], "offset": [offset], "piece": [piece]})
                        offset += len(piece)

    return run
